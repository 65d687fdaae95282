"""Networks: the JSON layer language as checked dataclasses, and training and prediction over cells.

A model's state is tables: weights(src, dst, w, v, vg) and biases(dst, b, v, vg) for each edge.
Every batch is one plan; the new weights are written to the shared folder, which cuts lineage and
survives lost executors.
"""
from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import activations, losses, optimizers
from cellweave.functions.fixed import fixed_sum
from cellweave.functions.generators import weight_init
from cellweave.functions.tables import kept
from cellweave.operators import dense, linked
from cellweave.operators.rank import topk
from cellweave.operators.sparse import denoise

#: The keys of a network and of a layer, in lower case; other layer keys are errors.
LAYER_KEYS = frozenset("name kind type source sources skip n nx ny nz pooling dataset activation weightinit biasinit pdropout sparse weightnorm deltanorm relusslope slope elualpha selulambda kernel kernelx kernely kernelz kernelstride kernelstridex kernelstridey kernelstridez batchnormalization sharedweights attributes".split())
SHARED_KEYS = frozenset("sourceinputlayer sourceoutputlayer inputlayer transposed".split())
KINDS = ("input", "hidden", "output", "target")
TYPES = ("fullyconnected", "convolutional", "pooling")
POOLINGS = ("max", "average", "lrn", "maxout", "dotproduct", "cosine")
ACTIVATIONS = ("sigmoid", "tanh", "relu", "lrelu", "elu", "selu", "softmax", "linear", *sorted(activations.PARSED_ONLY))
LOSSES = ("l1", "l2", "l2hinge", "hinge", "crossentropy", "scaledmarginalcrossentropy", "datascaledmarginalcrossentropy")
SCHEMES = ("caffexavier", "xavier", "uniform", "gaussian", "unitball", "selu", "constant")


class SpecError(ValueError):
    """A network or command that can't be read."""


@dataclass(frozen=True)
class Shared:
    """The edge from `input` to a layer takes the weights of another edge; biases are never shared."""

    input: str
    source: tuple[str, str]
    transposed: bool = False


@dataclass(frozen=True)
class Layer:
    name: str
    kind: str
    type: str = "fullyconnected"
    sources: tuple[str, ...] = ()
    skips: tuple[str, ...] = ()
    n: int | None = None
    dataset: str | None = None
    activation: str = "sigmoid"
    pooling: str | None = None
    scheme: str = "xavier"
    scale: float = 1.0
    bias: float = 0.0
    dropout: float = 0.0
    sparse: bool = False
    weight_norm: float = 0.0
    delta_norm: float = 0.0
    slope: float = activations.SLOPE
    elu_alpha: float = activations.ELU_ALPHA
    selu_lambda: float = activations.SELU_LAMBDA
    batch_norm: bool = False
    shape: tuple[int, ...] = ()
    kernel: tuple[int, ...] = ()
    stride: tuple[int, ...] = ()
    shared: tuple[Shared, ...] = ()


@dataclass(frozen=True)
class Spec:
    name: str
    layers: tuple[Layer, ...]
    loss: str = "l2"
    margin: losses.Margin = field(default_factory=losses.Margin)
    denoise: float = 0.0
    sparseness_p: float = 0.0
    sparseness_beta: float = 0.0
    shuffle: bool = True

    def layer(self, name: str) -> Layer:
        return next(x for x in self.layers if x.name == name)

    def order(self) -> list[Layer]:
        """Layers by their longest distance from the inputs; a cycle or unknown source raises."""
        depth: dict[str, int] = {}
        names = {x.name for x in self.layers}

        def of(x: Layer, above: tuple[str, ...]) -> int:
            if x.name in above:
                raise SpecError(f"layer {x.name} depends on itself")
            if x.name not in depth:
                depth[x.name] = max((1 + of(self.layer(s), (*above, x.name)) for s in (*x.sources, *x.skips)), default=0)
            return depth[x.name]

        for x in self.layers:
            if lost := [s for s in (*x.sources, *x.skips) if s not in names]:
                raise SpecError(f"layer {x.name}: unknown source {lost[0]}")
        return sorted(self.layers, key=lambda x: (of(x, ()), self.layers.index(x)))


def _lower(x):
    return {k.lower(): _lower(v) for k, v in x.items()} if isinstance(x, dict) else [_lower(v) for v in x] if isinstance(x, list) else x


def _one_of(what: str, value: str, known: tuple[str, ...]) -> str:
    if str(value).lower() not in known:
        raise SpecError(f"unknown {what} {value}")
    return str(value).lower()


def _axes(x: dict, key: str, name: str) -> tuple[int, ...]:
    """A value for each axis: a number or a list under key, or key with x, y or z behind it."""
    given = x.get(key, [])
    out = list(given) if isinstance(given, list) else [given]
    for i, axis in enumerate("xyz"):
        if f"{key}{axis}" in x:
            out += [1] * (i + 1 - len(out))
            out[i] = x[f"{key}{axis}"]
    if len(out) > 4 or any(not isinstance(v, int) or isinstance(v, bool) or v < 1 for v in out):
        raise SpecError(f"layer {name}: {key} takes whole numbers from 1")
    return tuple(out)


def _shared(x: dict, name: str, sources: list[str]) -> tuple[Shared, ...]:
    given = x.get("sharedweights", [])
    out = []
    for y in given if isinstance(given, list) else [given]:
        if odd := sorted(set(y) - SHARED_KEYS):
            raise SpecError(f"unknown shared weight field {odd[0]}")
        if y.get("inputlayer") not in sources:
            raise SpecError(f"layer {name}: shared weights of a layer that is no source")
        out.append(Shared(y["inputlayer"], (y.get("sourceinputlayer", ""), y.get("sourceoutputlayer", "")), str(y.get("transposed", False)).lower() == "true"))
    return tuple(out)


def parse_network(text: str) -> Spec:
    """A Spec of the JSON layer language; keys and names of values in any case."""
    raw = _lower(json.loads(text))
    if "layers" not in raw or not raw["layers"]:
        raise SpecError("no layers")
    layers: list[Layer] = []
    for i, x in enumerate(raw["layers"]):
        if odd := sorted(set(x) - LAYER_KEYS):
            raise SpecError(f"unknown layer field {odd[0]}")
        kind = _one_of("kind", x.get("kind", "hidden"), KINDS)
        name = x.get("name") or {"input": "Input", "output": "Output"}.get(kind, f"Layer{i}")
        sources = x.get("source", x.get("sources", []))
        sources = [sources] if isinstance(sources, str) else list(sources)
        if not sources and kind != "input":
            sources = [layers[-1].name] if layers else []
        skips = x.get("skip", [])
        init, binit = x.get("weightinit", {}), x.get("biasinit", {})
        pooling = _one_of("pooling", x["pooling"], POOLINGS) if "pooling" in x else None
        shape = _axes(x, "n", name) if isinstance(x.get("n"), list) or any(f"n{a}" in x for a in "xyz") and not isinstance(x.get("n"), str) else ()
        n = prod(shape) if shape else x.get("n")
        if n is not None and str(n).lower() != "auto" and (not isinstance(n, int) or n < 1):
            raise SpecError(f"layer {name}: N must be a whole number or auto")
        n = None if n is None or str(n).lower() == "auto" else n
        if pooling in ("dotproduct", "cosine"):
            if len(sources) < 2:
                raise SpecError(f"layer {name}: {pooling} needs two sources or more")
            n = len(sources) - 1
        layers.append(Layer(
            name, kind, _one_of("type", x.get("type", "fullyconnected"), TYPES), tuple(sources) if kind != "input" else (), tuple([skips] if isinstance(skips, str) else skips), n, x.get("dataset"),
            _one_of("activation", x.get("activation", "sigmoid"), ACTIVATIONS), pooling, _one_of("weight scheme", init.get("scheme", "xavier"), SCHEMES), float(init.get("scale", 1.0)), float(binit.get("bias", 0.0)),
            float(x.get("pdropout", 0.0)), str(x.get("sparse", "false")).lower() == "true", float(x.get("weightnorm", 0.0)), float(x.get("deltanorm", 0.0)),
            float(x.get("slope", x.get("relusslope", activations.SLOPE))), float(x.get("elualpha", activations.ELU_ALPHA)), float(x.get("selulambda", activations.SELU_LAMBDA)), str(x.get("batchnormalization", "false")).lower() == "true",
            shape, _axes(x, "kernel", name), _axes(x, "kernelstride", name), _shared(x, name, sources),
        ))
    m, s = raw.get("scaledmarginalcrossentropy", raw.get("datascaledmarginalcrossentropy", {})), raw.get("sparsenesspenalty", {})
    out = Spec(
        raw.get("name", "network"), tuple(layers), _one_of("error function", raw.get("errorfunction", "l2"), LOSSES),
        losses.Margin(float(m.get("onetarget", losses.ONE_TARGET)), float(m.get("zerotarget", losses.ZERO_TARGET)), float(m.get("onescale", losses.ONE_SCALE)), float(m.get("zeroscale", losses.ZERO_SCALE))),
        float(raw.get("denoising", {}).get("p", 0.0)), float(s.get("p", 0.0)), float(s.get("beta", 0.0)), bool(raw.get("shuffleindices", True)),
    )
    if not any(x.kind == "input" for x in layers) or not any(x.kind == "output" for x in layers):
        raise SpecError("a network needs an input and an output layer")
    out.order()
    return out


@dataclass(frozen=True)
class Command:
    """What the JSON command language says: a mode and its parameters."""

    mode: str
    network: str
    data: str
    optimizer: str = "sgd"
    epochs: int = 1
    alpha: float = 0.1
    alpha_interval: int = 0
    alpha_multiplier: float = 1.0
    mu: float = 0.5
    l2: float = 0.0
    seed: int = 12134
    checkpoint: str | None = None
    checkpoint_interval: int = 0
    results: str | None = None


def parse_command(text: str) -> Command:
    raw = _lower(json.loads(text))
    mode = _one_of("command", raw.get("command", ""), ("train", "predict", "validate"))
    t = raw.get("trainingparameters", {})
    for key in ("minibatch", "shuffleindices"):
        if key in t:
            raise SpecError(f"unknown training parameter {key}")
    if "predictionparameters" in raw:
        raise SpecError("unknown field PredictionParameters")
    for key in ("network", "data"):
        if key not in raw:
            raise SpecError(f"no {key}")
    c = t.get("checkpoint", {})
    return Command(
        mode, raw["network"], raw["data"], _one_of("optimizer", t.get("optimizer", "sgd"), ("sgd", "nesterov")), int(t.get("epochs", 1)), float(t.get("alpha", 0.1)), int(t.get("alphainterval", 0)), float(t.get("alphamultiplier", 1.0)),
        float(t.get("mu", 0.5)), float(t.get("lambda", 0.0)), int(raw.get("randomseed", 12134)), c.get("name"), int(c.get("interval", 0)), raw.get("results"),
    )


class Network:
    """A feed-forward network over input cells(sample, feature, value).

    Convolutions hold their kernels as weights(src: row, dst: channel) and a bias for each channel; pooling
    layers hold nothing. Batch normalisation uses the batch's moments in training, else the mean of all
    batches' moments. Edges with shared weights are one table, whose gradients add up."""

    def __init__(self, spark: SparkSession, spec: Spec, widths: dict[str, int], seed: int = 12134):
        self.spark, self.spec, self.widths = spark, spec, dict(widths)
        self.shapes: dict[str, tuple[int, ...]] = {}
        self.links: dict[tuple[str, str], DataFrame] = {}
        for x in spec.order():
            self._place(x)
        #: each edge's weights: the edge that owns them, and whether they are transposed
        self.owner = {(s, x.name): ((s, x.name), False) for x in spec.layers if x.type != "pooling" for s in x.sources}
        for x in spec.layers:
            for y in x.shared:
                self._share(x, y)
        self.weights: dict[tuple[str, str], DataFrame] = {}
        self.biases: dict[str, DataFrame] = {}
        self.scales: dict[str, DataFrame] = {}
        self.shifts: dict[str, DataFrame] = {}
        self.moments: dict[str, DataFrame] = {}
        for x in spec.layers:
            if x.kind == "input":
                continue
            channels = self._channels(x)
            for s in x.sources if x.type != "pooling" else ():
                if self.owner[s, x.name][0] != (s, x.name):
                    continue
                rows = self._kernel_rows(s, x) if x.type == "convolutional" else self.widths[s]
                grid = spark.range(rows).select(F.col("id").alias("src")).withColumn("dst", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(channels - 1).cast("bigint"))))
                own = seed + 7919 * len(self.weights)  # layers of one shape don't start alike
                w = weight_init(x.scheme, F.col("src"), F.col("dst"), self.widths[s], self.widths[x.name], x.scale, own)
                self.weights[s, x.name] = kept(grid.select("src", "dst", w.alias("w"), F.lit(0.0).alias("v"), F.lit(0.0).alias("vg")))
            state = lambda w: kept(spark.range(channels).select(F.col("id").alias("dst"), F.lit(w).alias("w"), F.lit(0.0).alias("v"), F.lit(0.0).alias("vg")))  # noqa: B023, E731
            if x.type != "pooling":
                self.biases[x.name] = state(x.bias)
            if x.batch_norm:
                self.scales[x.name], self.shifts[x.name] = state(1.0), state(0.0)
                self.moments[x.name] = kept(spark.range(channels).select(F.col("id").alias("dst"), F.lit(0.0).alias("m"), F.lit(0.0).alias("var"), F.lit(0).cast("bigint").alias("calls")))
        self.batches = 0

    def _place(self, x: Layer) -> None:
        """A layer's shape and width, from its own size or its sources', and its links to them."""
        spatial = x.kernel + (1,) * (4 - len(x.kernel))
        steps = (x.stride or (1,)) + (1,) * (4 - len(x.stride or (1,)))
        if x.pooling and x.type != "pooling" or x.type == "pooling" and not x.pooling:
            raise SpecError(f"layer {x.name}: a pooling function and the type Pooling go together")
        if x.type == "pooling" and x.batch_norm or x.kind == "input" and (x.type != "fullyconnected" or x.batch_norm):
            raise SpecError(f"layer {x.name}: {x.kind} layers of this type take no kernel and no batch normalisation")
        if x.type == "fullyconnected":
            width = self.widths.setdefault(x.name, x.n or 0)
            if not width:
                raise SpecError(f"layer {x.name} has no width")
            self.shapes[x.name] = x.shape if prod(x.shape or (0,)) == width else (width,)
            return
        if x.type == "convolutional" and not (x.kernel and x.n and len(x.kernel) < 4):
            raise SpecError(f"layer {x.name}: a convolution needs a kernel of at most three axes and N")
        found = set()
        for s in x.sources:
            whole = self.shapes[s] + (1,) * (4 - len(self.shapes[s]))
            if x.pooling in ("dotproduct", "cosine"):
                found.add(whole)
            elif x.pooling in ("lrn", "maxout"):
                found.add(whole)
                if x.pooling == "lrn":
                    last = max(i for i, v in enumerate(whole) if v > 1 or not i)  # channels are the last axis
                    self.links[s, x.name] = kept(linked.channel_links(self.spark, prod(whole), prod(whole[:last])))
            elif x.type == "pooling":
                found.add(tuple(linked.places(*axis)[0] for axis in zip(whole, spatial, steps, strict=True)))
                self.links[s, x.name] = kept(linked.window_links(self.spark, whole, spatial, steps))
            else:
                k = len(x.kernel)
                found.add((*(linked.places(*axis)[0] for axis in zip(whole[:k], x.kernel, steps, strict=False)), x.n))
                self.links[s, x.name] = kept(linked.window_links(self.spark, whole[:k], x.kernel, steps[:k], prod(whole[k:])))
        if len(found) != 1:
            raise SpecError(f"layer {x.name}: its sources have different shapes")
        self.shapes[x.name] = (len(x.sources) - 1,) if x.pooling in ("dotproduct", "cosine") else found.pop()
        self.widths[x.name] = prod(self.shapes[x.name])

    def _kernel_rows(self, s: str, x: Layer) -> int:
        return prod(x.kernel) * prod(self.shapes[s][len(x.kernel):])

    def _channels(self, x: Layer) -> int:
        """What has a bias each: the channels of a convolution, else the units."""
        return x.n if x.type == "convolutional" else self.widths[x.name]

    def _size(self, x: Layer) -> int:
        return self.widths[x.name] // self._channels(x)

    def _channel(self, x: Layer) -> Column:
        return F.floor(F.col("unit") / F.lit(self._size(x))) if x.type == "convolutional" else F.col("unit")

    def _units_of(self, x: Layer, of: DataFrame, *more: str) -> DataFrame:
        """of(dst, ...) with a row for each unit of the channel dst."""
        n = self._size(x)
        return of.select(F.explode(F.sequence(F.col("dst") * n, F.col("dst") * n + (n - 1))).alias("unit"), *more)

    def _share(self, x: Layer, y: Shared) -> None:
        if y.source not in self.owner or self.owner[y.source][0] != y.source or y.source == (y.input, x.name):
            raise SpecError(f"layer {x.name}: no edge {y.source} with weights of its own")

        def sides(s: str, layer: Layer) -> tuple[int, int]:
            return (self._kernel_rows(s, layer) if layer.type == "convolutional" else self.widths[s]), self._channels(layer)

        if sides(y.input, x) != sides(y.source[0], self.spec.layer(y.source[1]))[:: -1 if y.transposed else 1]:
            raise SpecError(f"layer {x.name}: shared weights of another shape")
        self.owner[y.input, x.name] = (y.source, y.transposed)

    def _weights(self, s: str, d: str) -> DataFrame:
        edge, turned = self.owner[s, d]
        return self._turned(self.weights[edge], turned)

    @staticmethod
    def _turned(t: DataFrame, turned: bool) -> DataFrame:
        if not turned:
            return t
        return t.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in t.columns if c not in ("src", "dst")])

    def forward(self, cells: DataFrame, train: bool = False, epoch: int = 0, nudged: dict | None = None, copies: int = 1, before: dict | None = None) -> dict[str, DataFrame]:
        """(sample, unit, a) of each layer. Samples without input cells have the biases alone.

        before: takes (sample, unit, x) of the layers with batch normalisation, before it.

        nudged: for an edge (src, dst, by, copy), for a layer's biases (dst, by, copy): what is added to a
        weight for the samples of one copy, which are those with sample % copies = copy."""
        nudged, copy = nudged or {}, F.pmod("sample", F.lit(copies))
        samples = cells.select("sample").distinct()
        out: dict[str, DataFrame] = {}
        for x in self.spec.order():
            if x.kind == "input":
                given = denoise(cells, self.spec.denoise, epoch) if train and self.spec.denoise and x.sparse else cells
                out[x.name] = given.select("sample", F.col("feature").cast("bigint").alias("unit"), F.col("value").alias("a"))
                continue
            if x.type == "pooling":
                sources = [out[s] for s in x.sources]
                z = linked.pooled(x.pooling, sources, [self.links.get((s, x.name)) for s in x.sources])
                every = samples.crossJoin(F.broadcast(self.spark.range(self.widths[x.name]).select(F.col("id").alias("unit"), F.lit(0.0).alias("a"))))
            else:
                z = None
                for s in x.sources:
                    part = self._sent(x, s, out[s], self._weights(s, x.name), "w")
                    z = part if z is None else z.unionByName(part)
                    edge, turned = self.owner[s, x.name]
                    if edge in nudged:
                        z = z.unionByName(self._sent(x, s, out[s].withColumn("copy", copy), self._turned(nudged[edge], turned), "by", ("copy",)))
                every = samples.crossJoin(F.broadcast(self._units_of(x, self.biases[x.name], F.col("w").alias("a"))))
            for s in x.skips:
                z = z.unionByName(out[s].select("sample", "unit", "a"))
            if x.name in nudged:
                every = every.unionByName(samples.withColumn("copy", copy).join(self._units_of(x, nudged[x.name], "copy", F.col("by").alias("a")), "copy").select("sample", "unit", "a"))
            z = z.unionByName(every).groupBy("sample", "unit").agg(fixed_sum(F.col("a")).alias("x"))
            if x.batch_norm:
                z = kept(z) if train else z
                if before is not None:
                    before[x.name] = z
                z = linked.normalised(z, self._channel(x), self._moments(x, z, train), self.scales[x.name], self.shifts[x.name])
            if x.activation == "softmax":
                a = activations.softmax(z).select("sample", "unit", "a")
            else:
                a = z.select("sample", "unit", activations.activation(x.activation, F.col("x"), x.slope, x.elu_alpha, x.selu_lambda).alias("a"))
            if train and x.dropout:
                if x.activation in ("elu", "selu"):
                    a = dense.biased_dropout(a, x.dropout, x.activation, x.elu_alpha, x.selu_lambda, epoch)
                else:
                    a = dense.dropout(a, x.dropout, 0.5 if x.activation == "sigmoid" else 0.0, epoch)
            out[x.name] = kept(a) if train or self._readers(x) > 1 else a
        return out

    def _readers(self, x: Layer) -> int:
        """How often other layers read x in a forward pass; what is read once need not be written."""
        return sum(((1 + (y.pooling in ("dotproduct", "cosine", "lrn"))) * (x.name in y.sources)) + (x.name in y.skips) for y in self.spec.layers)

    def _sent(self, x: Layer, s: str, units: DataFrame, weights: DataFrame, w: str, also: tuple[str, ...] = ()) -> DataFrame:
        """(sample, unit, a): what a source adds to the units of x."""
        if x.type == "convolutional":
            return linked.convolved(units, self.links[s, x.name], weights, self._size(x), w, also)
        cells = units.withColumnRenamed("unit", "src").join(weights, ["src", *also])
        return cells.groupBy("sample", F.col("dst").alias("unit")).agg(fixed_sum(F.col("a") * F.col(w)).alias("a"))

    def _moments(self, x: Layer, z: DataFrame, train: bool) -> DataFrame:
        return linked.moments(z, self._channel(x)) if train else self.moments[x.name]

    def _back(self, y: Layer, s: str, which: int, units: dict[str, DataFrame], deltas: DataFrame) -> DataFrame:
        """(sample, unit, d): what y's deltas send back to its source s, its source number `which`."""
        if y.type == "pooling":
            return linked.pooled_back(y.pooling, [units[q] for q in y.sources], [self.links.get((q, y.name)) for q in y.sources], deltas, which)
        if y.type == "convolutional":
            return linked.convolved_back(deltas, self.links[s, y.name], self._weights(s, y.name), self._size(y))
        return dense.back_delta(deltas, self._weights(s, y.name))

    def _grid(self, layer: Layer, units: dict[str, DataFrame], targets: DataFrame) -> DataFrame:
        t = targets.select("sample", F.col("feature").cast("bigint").alias("unit"), F.col("value").alias("t"))
        return units[layer.name].join(t, ["sample", "unit"], "left").withColumn("t", F.coalesce("t", F.lit(0.0)))

    def error(self, cells: DataFrame, targets: DataFrame) -> float:
        """Mean loss of an example."""
        units, n = self.forward(cells), cells.select("sample").distinct().count()
        return sum(losses.dense_loss(self._loss(x), self._grid(x, units, targets), self.spec.margin).first()["loss"] for x in self.spec.layers if x.kind == "output") / max(1, n)

    def errors_nudged(self, cells: DataFrame, targets: DataFrame, nudged: dict, copies: int) -> dict[int, float]:
        """The mean loss of an example with each copy's nudge, in one pass over copies of the samples."""

        def copied(t: DataFrame) -> DataFrame:
            return t.withColumn("sample", F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: F.col("sample") * copies + c)))

        n, out = cells.select("sample").distinct().count(), dict.fromkeys(range(copies), 0.0)
        units, goal = self.forward(copied(cells), nudged=nudged, copies=copies), copied(targets)
        for x in self.spec.layers:
            if x.kind == "output":
                loss = losses.loss(self._loss(x), F.col("a"), F.col("t"), None, self.spec.margin)
                for r in self._grid(x, units, goal).groupBy(F.pmod("sample", F.lit(copies)).alias("copy")).agg(fixed_sum(loss).alias("loss")).collect():  # a row for each copy
                    out[r["copy"]] += r["loss"] / max(1, n)
        return out

    def _loss(self, x: Layer) -> str:
        multi = x.activation == "softmax" and self.spec.loss in ("crossentropy", "scaledmarginalcrossentropy")
        return ("multinomial" if multi else "") + self.spec.loss

    def gradients(self, cells: DataFrame, targets: DataFrame, train: bool = False, epoch: int = 0) -> tuple[dict[tuple[str, str], DataFrame], dict[str, DataFrame], float]:
        """(src, dst, g) of each edge (negated batch mean), (dst, g) of each layer's biases, mean loss."""
        before: dict[str, DataFrame] = {}
        units = {k: v if train or self.spec.layer(k).kind == "input" else kept(v) for k, v in self.forward(cells, train, epoch, before=before).items()}
        n = cells.select("sample").distinct().count()
        deltas: dict[str, DataFrame] = {}
        error, edges, biases = 0.0, {}, {}
        self.norms: dict[str, tuple[DataFrame, DataFrame, DataFrame]] = {}
        for x in reversed(self.spec.order()):
            if x.kind == "input":
                continue
            if x.kind == "output":
                grid = self._grid(x, units, targets)
                error += losses.dense_loss(self._loss(x), grid, self.spec.margin).first()["loss"] / max(1, n)
                d = grid.select("sample", "unit", losses.output_delta(self._loss(x), x.activation, F.col("a"), F.col("t"), None, self.spec.margin, x.slope, x.elu_alpha, x.selu_lambda).alias("d"))
            else:
                back = None
                for y in self.spec.layers:
                    if y.name not in deltas:
                        continue
                    for i, s in enumerate(y.sources):
                        if s == x.name:
                            part = self._back(y, s, i, units, deltas[y.name])
                            back = part if back is None else back.unionByName(part)
                    if x.name in y.skips:
                        back = deltas[y.name] if back is None else back.unionByName(deltas[y.name])
                if back is None:
                    continue
                back = back.groupBy("sample", "unit").agg(fixed_sum(F.col("d")).alias("d"))
                if self.spec.sparseness_p and x.sparse:
                    pen = losses.sparseness_penalty(units[x.name], self.spec.sparseness_p, self.spec.sparseness_beta)
                    back = back.join(F.broadcast(pen), "unit").select("sample", "unit", (F.col("d") + F.col("penalty")).alias("d"))
                f = activations.derivative(x.activation, F.col("a"), x.slope, x.elu_alpha, x.selu_lambda, x.dropout if train else 0.0)
                d = back.join(units[x.name], ["sample", "unit"]).select("sample", "unit", (F.col("d") * f).alias("d"))
            if x.delta_norm:
                d = losses.clip_norm(d, x.delta_norm)
            if x.batch_norm:
                d, scale, shift = linked.normalised_back(before[x.name], self._channel(x), d, self._moments(x, before[x.name], train), self.scales[x.name], max(1, n), train)
                self.norms[x.name] = kept(scale), kept(shift), kept(linked.moments(before[x.name], self._channel(x)))
            deltas[x.name] = kept(d)
            if x.type == "pooling":
                continue
            for s in x.sources:
                if x.type == "convolutional":
                    g = linked.kernel_gradient(units[s], self.links[s, x.name], deltas[x.name], self._size(x), max(1, n))
                else:
                    src = units[s].select("sample", F.col("unit").alias("src"), "a")
                    g = src.join(deltas[x.name], "sample").groupBy("src", F.col("unit").alias("dst")).agg((fixed_sum(F.col("a") * F.col("d")) * F.lit(-1.0 / max(1, n))).alias("g"))
                edge, turned = self.owner[s, x.name]
                g = self._turned(g, turned).select("src", "dst", "g")
                edges[edge] = edges[edge].unionByName(g).groupBy("src", "dst").agg(fixed_sum(F.col("g")).alias("g")) if edge in edges else g
            biases[x.name] = dense.bias_gradient(deltas[x.name].withColumn("unit", self._channel(x)), max(1, n)).withColumnRenamed("unit", "dst")
        return edges, biases, error

    def train_batch(self, cells: DataFrame, targets: DataFrame, optimizer: str = "sgd", alpha: float = 0.1, mu: float = 0.9, l2: float = 0.0, l1: float = 0.0, epoch: int = 0) -> float:
        edges, biases, error = self.gradients(cells, targets, True, epoch)
        for (s, d), g in edges.items():
            state = self.weights[s, d].join(g, ["src", "dst"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
            new = optimizers.step(optimizer, state, alpha, mu, l2, l1, self.batches)
            if self.spec.layer(d).weight_norm:
                new = optimizers.max_norm(new, self.spec.layer(d).weight_norm)
            self.weights[s, d] = kept(new)
        for d, g in biases.items():
            state = self.biases[d].join(g, "dst", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
            self.biases[d] = kept(optimizers.step(optimizer, state, alpha, mu, t=self.batches, bias=True))
        for d, (scale, shift, batch) in self.norms.items():
            for held, g in ((self.scales, scale), (self.shifts, shift)):
                state = held[d].join(g, "dst", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
                held[d] = kept(optimizers.step(optimizer, state, alpha, mu, t=self.batches, bias=True))
            self.moments[d] = kept(linked.running(self.moments[d], batch))
        self.batches += 1
        return error

    def train(self, cells: DataFrame, targets: DataFrame, epochs: int, batch: int = 1024, optimizer: str = "sgd", alpha: float = 0.1, mu: float = 0.9, l2: float = 0.0, decay: float = 0.0, checkpoint: str | None = None, interval: int = 0, alpha_interval: int = 0, alpha_multiplier: float = 1.0) -> list[float]:
        """Mean errors of the epochs. Samples are dealt into batches by a hash of (sample, epoch); an epoch's
        cells are written once by batch, so a batch reads its own part only. The step size is
        multiplied by alpha_multiplier after every alpha_interval epochs."""
        brake, out = optimizers.Brake(), []
        count = max(1, -(-cells.select("sample").distinct().count() // batch))
        dealt = None
        for epoch in range(epochs):
            if alpha_interval and epoch and epoch % alpha_interval == 0:
                alpha *= alpha_multiplier
            if dealt is None or self.spec.shuffle:
                dealt = [self._by_batch(t, epoch if self.spec.shuffle else 0, count) for t in (cells, targets)]
                # batches that hold samples; at most `count` numbers
                filled = sorted(r["batch"] for r in dealt[0].select("batch").distinct().collect())
            total = 0.0
            for done, b in enumerate(filled):
                part, goal = (t.where(F.col("batch") == b).drop("batch") for t in dealt)
                step = optimizers.decayed(alpha, decay, self.batches) * (brake.factor(total / done) if done and total else 1.0)
                total += self.train_batch(part, goal, optimizer, step, mu, l2, 0.0, epoch)
            out.append(total / max(1, len(filled)))
            if checkpoint and interval and (epoch + 1) % interval == 0:
                self.save(f"{checkpoint}{epoch + 1}")
        return out

    @staticmethod
    def _by_batch(rows: DataFrame, epoch: int, count: int) -> DataFrame:
        number = F.pmod(F.xxhash64("sample", F.lit(epoch)), F.lit(count)).cast("int")
        rows = rows.withColumn("batch", number)
        return kept(rows.repartition("batch") if count > 1 else rows, "batches", by="batch")

    def predict(self, cells: DataFrame, k: int, layer: str | None = None, filters: DataFrame | None = None) -> DataFrame:
        """(sample, rank, idx, score): the k best units of a layer (the output layer), after filters; the
        whole layer for k <= 0."""
        from cellweave.operators.rank import apply_filter

        name = layer or next(x.name for x in self.spec.layers if x.kind == "output")
        if k > min(128, self.widths[name]):
            raise ValueError("k must be at most 128 and the layer's width")
        scores = self.forward(cells)[name].select("sample", F.col("unit").alias("idx"), F.col("a").alias("score"))
        if filters is not None:
            scores = apply_filter(scores, filters)
        return topk(scores, k if k > 0 else self.widths[name]).select("sample", "rank", "idx", "score")

    def _tables(self) -> list[tuple[dict, object, str]]:
        """Where each table of the model's state is held, and its folder."""
        out: list[tuple[dict, object, str]] = [(self.weights, e, f"weights/{e[0]}-{e[1]}") for e in self.weights]
        for name in ("biases", "scales", "shifts", "moments"):
            held = getattr(self, name)
            out += [(held, d, f"{name}/{d}") for d in held]
        return out

    def save(self, path: str) -> None:
        for held, key, name in self._tables():
            held[key].write.mode("overwrite").parquet(f"{path}/{name}")

    def load(self, path: str) -> Network:
        for held, key, name in self._tables():
            held[key] = self.spark.read.parquet(f"{path}/{name}")
        return self


def resized(spec: Spec, **n: int) -> Spec:
    """spec with other layer sizes."""
    return replace(spec, layers=tuple(replace(x, n=n.get(x.name, x.n)) for x in spec.layers))
