import json
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import linked
from cellweave.plans import commands
from cellweave.plans import network as nn

INIT = {"WeightInit": {"Scheme": "Uniform", "Scale": 0.5}, "BiasInit": {"Bias": 0.1}}


def net(spark, *layers, n=(4, 4), out=2):
    first = {"Name": "Input", "Kind": "Input", "N": list(n), "DataSet": "in"}
    last = {"Name": "Output", "Kind": "Output", "N": out, "DataSet": "out", "Activation": "Sigmoid", **INIT}
    text = {"Layers": [first, *[{"Kind": "Hidden", "Activation": "Tanh", **INIT, **x} for x in layers], last]}
    return nn.Network(spark, nn.parse_network(json.dumps(text)), {})


def data(spark, width=16, rows=3):
    x = np.random.default_rng(5).normal(size=(rows, width)).round(3)
    x[0, 3] = 0.0
    cells = spark.createDataFrame([(s, f, float(x[s, f])) for s in range(rows) for f in range(width) if x[s, f]], "sample bigint, feature bigint, value double")
    targets = spark.createDataFrame([(s, s % 2, 1.0) for s in range(rows)], "sample bigint, feature bigint, value double")
    return x, cells, targets


def grid(units, rows, width):
    out = np.full((rows, width), np.nan)
    for r in units.collect():
        out[r["sample"], r["unit"]] = r["a"]
    return out


def windows(size, kernel, stride):
    """By axis: for each window the positions inside of the axis and their tap."""
    if size <= kernel:
        n, pad = 1, (kernel - size + 1) // 2
    else:
        n, pad = (size, kernel // 2) if stride == 1 else ((size - kernel) // stride + 1, 0)
    return [[(w * stride - pad + k, k) for k in range(kernel) if 0 <= w * stride - pad + k < size] for w in range(n)]


@pytest.mark.parametrize(("kernel", "stride"), [((3, 2), (1, 2)), ((5, 3), (1, 1))])
def test_convolution_and_pooling_against_loops(spark, kernel, stride):
    x, cells, _ = data(spark, 32)
    shape = {"Kernel": list(kernel), "KernelStride": list(stride)}
    m = net(
        spark, {"Name": "C", "Type": "Convolutional", "N": 3, "Activation": "Linear", **shape}, {"Name": "M", "Type": "Pooling", "Pooling": "Max", "Source": "Input", "Activation": "Linear", **shape},
        {"Name": "A", "Type": "Pooling", "Pooling": "Average", "Source": "Input", "Activation": "Linear", **shape}, {"Name": "H", "Source": ["C", "M", "A"], "N": 2}, n=(4, 4, 2),
    )
    w = {(r["src"], r["dst"]): r["w"] for r in m.weights["Input", "C"].collect()}
    wx, wy = windows(4, kernel[0], stride[0]), windows(4, kernel[1], stride[1])
    at = lambda s, c, i, j: x[s, c * 16 + j * 4 + i]
    conv, most, mean = [], [], []
    for s in range(3):
        spots = [(i, j) for j in wy for i in wx]
        conv.append([0.1 + sum(at(s, c, i, j) * w[c * kernel[0] * kernel[1] + b * kernel[0] + a, o] for c in range(2) for (i, a), (j, b) in product(p, q)) for o in range(3) for p, q in spots])
        boxes = [[at(s, c, i, j) for (i, _), (j, _) in product(p, q)] for c in range(2) for p, q in spots]
        most.append([max(b) for b in boxes])
        mean.append([sum(b) / len(b) for b in boxes])
    out = m.forward(cells)
    for name, want in (("C", conv), ("M", most), ("A", mean)):
        assert m.widths[name] == len(want[0])
        np.testing.assert_allclose(grid(out[name], 3, m.widths[name]), want, atol=1e-6)


def test_lrn_and_products_against_numpy(spark):
    x, cells, _ = data(spark, 32)
    m = net(
        spark, {"Name": "L", "Type": "Pooling", "Pooling": "LRN", "Activation": "Linear"}, {"Name": "P", "Source": "Input", "N": 4}, {"Name": "Q", "Source": "Input", "N": 4}, {"Name": "R", "Source": "Input", "N": 4},
        {"Name": "D", "Type": "Pooling", "Pooling": "DotProduct", "Source": ["P", "Q", "R"], "Activation": "Linear"}, {"Name": "S", "Type": "Pooling", "Pooling": "Cosine", "Source": ["P", "Q", "R"], "Activation": "Linear"},
        {"Name": "X", "Type": "Pooling", "Pooling": "Maxout", "Source": ["P", "Q", "R"], "Activation": "Linear"}, {"Name": "H", "Source": ["L", "D", "S", "X"], "N": 2}, n=(2, 2, 8),
    )
    out = m.forward(cells)
    c = x.reshape(3, 8, 4)
    base = np.stack([2 + 1e-4 / 5 * (c[:, max(0, i - 2) : i + 3] ** 2).sum(1) for i in range(8)], 1)
    np.testing.assert_allclose(grid(out["L"].where("a <> 0"), 3, 32)[x != 0], (c / base**0.75).reshape(3, 32)[x != 0], atol=1e-7)
    p, q, r = (grid(out[k], 3, 4) for k in "PQR")
    dots = np.stack([(p * v).sum(1) for v in (q, r)], 1)
    np.testing.assert_allclose(grid(out["D"], 3, 2), dots, atol=1e-6)
    np.testing.assert_allclose(grid(out["S"], 3, 2), dots / np.stack([np.linalg.norm(p, axis=1) * np.linalg.norm(v, axis=1) for v in (q, r)], 1), atol=1e-6)
    np.testing.assert_allclose(grid(out["X"], 3, 4), np.maximum(np.maximum(p, q), r), atol=1e-6)


@pytest.mark.parametrize("layers", [
    ({"Name": "C", "Type": "Convolutional", "N": 2, "Kernel": [3, 3], "KernelStride": [1, 1]}, {"Name": "M", "Type": "Pooling", "Pooling": "Max", "Kernel": [2, 2], "KernelStride": [2, 2], "Activation": "Linear"}, {"Name": "L", "Type": "Pooling", "Pooling": "LRN", "Activation": "Linear"}, {"Name": "D", "Type": "Convolutional", "N": 2, "Kernel": [1, 1], "KernelStride": [1, 1], "Activation": "Sigmoid"}, {"Name": "A", "Type": "Pooling", "Pooling": "Average", "Kernel": [2, 1], "KernelStride": [1, 1], "Activation": "Linear"}),
    ({"Name": "P", "N": 3}, {"Name": "Q", "N": 3, "Source": "Input"}, {"Name": "R", "N": 3, "Source": "Input"}, {"Name": "S", "Type": "Pooling", "Pooling": "Cosine", "Source": ["P", "Q", "R"], "Activation": "Linear"}, {"Name": "D", "Type": "Pooling", "Pooling": "DotProduct", "Source": ["Q", "P", "R"], "Activation": "Linear"}, {"Name": "X", "Type": "Pooling", "Pooling": "Maxout", "Source": ["P", "Q", "R"], "Activation": "Linear"}, {"Name": "H", "Source": ["S", "D", "X"], "N": 2}),
    ({"Name": "E", "N": 3}, {"Name": "B", "N": 4, "SharedWeights": {"InputLayer": "E", "SourceInputLayer": "Input", "SourceOutputLayer": "E", "Transposed": True}}, {"Name": "F", "N": 3, "SharedWeights": [{"InputLayer": "B", "SourceInputLayer": "Input", "SourceOutputLayer": "E"}]}),
])
def test_gradients_of_linked_layers_against_differences(spark, layers):
    side = 4 if layers[0]["Name"] == "C" else 2
    _, cells, targets = data(spark, side * side, rows=2)
    m = net(spark, *layers, n=(side, side))
    assert commands.validate(m, cells, targets, within=2.0) == []


def test_batch_normalisation_trains(spark):
    x, cells, targets = data(spark, rows=4)
    m = net(spark, {"Name": "C", "Type": "Convolutional", "N": 2, "Kernel": [3, 3], "KernelStride": [2, 2], "Activation": "Linear", "BatchNormalization": True}, {"Name": "H", "N": 3, "BatchNormalization": True})
    edges, _, base = m.gradients(cells, targets, train=True)
    norms = dict(m.norms)
    for held, key, g, sign in ((m.weights, ("C", "H"), edges["C", "H"].where("src = 1 AND dst = 2"), -1), (m.weights, ("Input", "C"), edges["Input", "C"].where("src = 4 AND dst = 0"), -1), (m.scales, "H", norms["H"][0].where("dst = 1"), 1), (m.shifts, "C", norms["C"][1].where("dst = 1"), 1)):
        r = g.first().asDict()
        here = F.lit(True)
        for c in ("src", "dst"):
            here = here & (F.col(c) == r[c]) if c in r else here
        kept = held[key]
        held[key] = kept.withColumn("w", F.when(here, F.col("w") + 0.001).otherwise(F.col("w")))
        assert abs((m.gradients(cells, targets, train=True)[2] - base) / 0.001 - sign * r["g"]) < 2e-3
        held[key] = kept
    a = grid(m.forward(cells, train=True)["C"], 4, m.widths["C"]).reshape(4, 2, -1)
    np.testing.assert_allclose(a.mean((0, 2)), 0, atol=1e-6)
    before = {}
    m.forward(cells, train=True, before=before)
    z = np.array([[r["x"] for r in before["H"].where(f"sample = {s}").orderBy("unit").collect()] for s in range(4)])
    m.train(cells, targets, epochs=1, alpha=0.1)
    got = {r["dst"]: (r["m"], r["var"], r["calls"]) for r in m.moments["H"].collect()}
    assert all(abs(got[i][0] - z[:, i].mean()) < 1e-6 and abs(got[i][1] - z[:, i].var(ddof=1)) < 1e-6 and got[i][2] == 1 for i in range(3))


def test_linked_models_round_trip(spark, tmp_path):
    _, cells, targets = data(spark)
    layers = ({"Name": "C", "Type": "Convolutional", "N": 2, "Kernel": [3, 3], "KernelStride": [1, 1], "BatchNormalization": True}, {"Name": "M", "Type": "Pooling", "Pooling": "Max", "Kernel": [2, 2], "KernelStride": [2, 2]})
    m = net(spark, *layers)
    m.train(cells, targets, epochs=1, alpha=0.5)
    m.save(str(tmp_path / "m"))
    assert abs(net(spark, *layers).load(str(tmp_path / "m")).error(cells, targets) - m.error(cells, targets)) < 1e-12


def test_refused_layers(spark):
    for bad, why in (
        ({"Name": "H", "N": 2, "Pooling": "Max"}, "go together"), ({"Name": "H", "Type": "Pooling"}, "go together"), ({"Name": "H", "Type": "Convolutional", "N": 2}, "kernel"),
        ({"Name": "H", "N": 2, "Kernel": [0]}, "whole numbers"), ({"Name": "H", "N": 2, "SharedWeights": {"InputLayer": "Lost"}}, "no source"),
        ({"Name": "H", "N": 2, "SharedWeights": {"InputLayer": "Input", "SourceInputLayer": "H", "SourceOutputLayer": "Output"}}, "another shape"),
        ({"Name": "H", "N": 2, "SharedWeights": {"InputLayer": "Input", "Colour": 1}}, "field"),
    ):
        with pytest.raises(nn.SpecError, match=why):
            net(spark, bad)


def test_empty_window_and_missing_cells_are_zero(spark):
    cells = spark.createDataFrame([(0, 0, -1.0), (1, 0, -2.0), (1, 1, -3.0)], "sample bigint, unit bigint, a double")
    links = linked.window_links(spark, (4,), (2,), (2,))
    assert sorted(map(tuple, linked.pooled("max", [cells], [links]).collect())) == [(0, 0, 0.0), (1, 0, -2.0)]
