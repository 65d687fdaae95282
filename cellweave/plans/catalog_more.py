"""Further queries: backward passes of pooling and convolution, sparse softmax and boosted forms, indexed data."""
from __future__ import annotations

import json

from pyspark.sql import functions as F

from cellweave.functions import losses
from cellweave.functions.fixed import fixed_sum
from cellweave.operators import dense, rank, sparse
from cellweave.plans import network
from cellweave.plans.catalog import _NX, _PAIR, _deltas, _pairs, _u, query, r6
from cellweave.plans.fixtures import cells, class_grid, embedding_units, fixed, formula, plane, table, w_sql, with_, x_grid

for _act, _low in (("elu", -0.8), ("selu", -1.050701 * 0.8)):
    _a = 1.0 / (0.7 + _low * _low * 0.3 * 0.7) ** 0.5
    _b = -_a * 0.3 * _low
    query(with_("grid") + f"SELECT sample, unit, round(CASE WHEN {_u('sample', 'unit', '0')} < 0.3 THEN {_a * _low + _b!r}::DOUBLE ELSE {_a!r}::DOUBLE * a + {_b!r}::DOUBLE END, 6) AS a FROM grid", f"dropout_{_act}")(
        lambda spark, d, x=_act: dense.biased_dropout(class_grid(spark, d).select("sample", "unit", "a"), 0.3, x, alpha=0.8).select("sample", "unit", *r6("a"))
    )

# several targets of a sample: the label and its two followers
_T = ", s AS (SELECT vec_id AS sample, ((label + k) % 10)::INT AS unit FROM embeddings, range(3) r(k) WHERE k <= vec_id % 3), n AS (SELECT sample, count(*) AS n FROM s GROUP BY 1) "
_LN = "ln(greatest(1e-12::DOUBLE, a))"


def _several(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), "label").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return e.where(F.col("k") <= F.pmod("sample", F.lit(3))).select("sample", F.pmod(F.col("label") + F.col("k"), F.lit(10)).cast("int").alias("unit"))


def _weights(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), (F.lit(1.0) + F.pmod("label", F.lit(3)) / F.lit(10.0)).alias("weight"))


@query(with_("grid") + _T + f"SELECT round({fixed('-(1::DOUBLE / n) * ' + _LN)}, 5) AS loss FROM grid JOIN s USING (sample, unit) JOIN n USING (sample)")
def sparse_softmax_loss(spark, d):
    return losses.sparse_softmax_loss(class_grid(spark, d), _several(spark, d)).select(*r6("loss", digits=5))


@query(with_("grid") + _T + f"SELECT round({fixed('-w * ' + _LN)}, 5) AS loss FROM grid JOIN s USING (sample, unit)")
def sparse_softmax_loss_weighted(spark, d):
    return losses.sparse_softmax_loss(class_grid(spark, d), _several(spark, d), _weights(spark, d)).select(*r6("loss", digits=5))


@query(with_("grid") + _T + f"SELECT round({fixed('CASE WHEN a < 0.9 THEN -0.5::DOUBLE * (1::DOUBLE / n) * ' + _LN + ' ELSE 0 END')}, 5) AS loss FROM grid JOIN s USING (sample, unit) JOIN n USING (sample)")
def sparse_softmax_loss_margin(spark, d):
    return losses.sparse_softmax_loss(class_grid(spark, d), _several(spark, d), margin=losses.Margin(0.9, 0.1, 0.5, 1.0)).select(*r6("loss", digits=5))


@query(with_("grid") + _T + "SELECT sample, unit, round(CASE WHEN s.unit IS NULL THEN a ELSE a - 1::DOUBLE / n END, 6) AS d FROM grid LEFT JOIN s USING (sample, unit) JOIN n USING (sample)")
def sparse_softmax_delta(spark, d):
    return losses.sparse_softmax_delta(class_grid(spark, d), _several(spark, d)).select("sample", "unit", *r6("d"))


@query(with_("grid") + _T + "SELECT sample, unit, round(CASE WHEN s.unit IS NULL THEN w * a ELSE a - w END, 6) AS d FROM grid LEFT JOIN s USING (sample, unit)")
def sparse_softmax_delta_weighted(spark, d):
    return losses.sparse_softmax_delta(class_grid(spark, d), _several(spark, d), _weights(spark, d)).select("sample", "unit", *r6("d"))


for _act, _f in (("sigmoid", "a * (1 - a)"), ("tanh", "(1 - a * a)"), ("linear", "1"), ("relu", "CASE WHEN a > 0 THEN 1 ELSE 0 END")):
    for _ignore in (False, True):
        query(with_("grid") + _T + f"SELECT sample, unit, round(CASE WHEN s.unit IS NULL THEN {0.0 if _ignore else 0.25}::DOUBLE * a * ({_f}) ELSE 2::DOUBLE * (a - 1) * ({_f}) END, 6) AS d FROM grid LEFT JOIN s USING (sample, unit)", f"delta_boosted_{_act}{'_ignore_zero' * _ignore}")(
            lambda spark, d, x=_act, i=_ignore: losses.sparse_boosted_delta(x, class_grid(spark, d), _several(spark, d), 2.0, 0.25, i).select("sample", "unit", *r6("d"))
        )

# examples point at shared rows of targets: sample -> sample // 2
for _name, _e in (("l1", "abs(a - t)"), ("l2", "0.5::DOUBLE * (a - t) * (a - t)"), ("crossentropy", "-t * ln(greatest(1e-12::DOUBLE, a)) - (1 - t) * ln(greatest(1e-12::DOUBLE, 1 - a))")):
    query(with_("grid") + f"SELECT round({fixed(_e)}, 5) AS loss FROM (SELECT g.sample, g.unit, g.a, h.t FROM grid g JOIN grid h ON h.sample = g.sample // 2 AND h.unit = g.unit)", f"sparse_loss_indexed_{_name}")(
        lambda spark, d, n=_name: losses.sparse_loss(n, class_grid(spark, d).select("sample", "unit", "a"), sparse.gather(class_grid(spark, d).select("sample", F.floor(F.col("sample") / 2).alias("unique_id")).distinct(), class_grid(spark, d).where("t = 1").select("sample", F.col("unit").alias("feature"), F.col("t").alias("value"))).select("sample", F.col("feature").alias("unit"))).select(*r6("loss", digits=5))
    )


@query(_PAIR + "SELECT vec_id, (i - 1)::INT AS unit, round(0.5 * y[i]::DOUBLE, 6) AS dx, round(0.5 * x[i]::DOUBLE, 6) AS dy FROM p, range(1, 65) r(i)")
def dot_product_delta(spark, d):
    x, y = dense.dot_delta(F.col("x"), F.col("y"), F.lit(0.5))
    return _pairs(spark, d).select("vec_id", F.posexplode(F.arrays_zip(x.alias("x"), y.alias("y"))).alias("unit", "z")).select("vec_id", "unit", F.round("z.x", 6).alias("dx"), F.round("z.y", 6).alias("dy"))


@query(with_("xs", "grid") + "SELECT x.sample, x.unit, CASE WHEN x >= a THEN t ELSE 0 END AS d FROM xs x JOIN grid g ON x.sample = g.sample AND x.unit = g.unit")
def maxout_delta(spark, d):
    x, g = x_grid(spark, d).withColumnRenamed("x", "a"), class_grid(spark, d)
    return dense.maxout_delta(x, dense.maxout(x, g.select("sample", "unit", "a")), g.select("sample", "unit", F.col("t").alias("d")))


_PD = with_("units", "plane") + ", w AS (SELECT sample, channel, x, y, a, x // 2 AS px, y // 2 AS py, ((channel + x // 2 + 2 * (y // 2)) % 5)::DOUBLE / 5 AS d FROM plane) "


def _pool_deltas(spark, d):
    return dense.pool(plane(spark, d), 2, 2, "max", 4, 4).select("sample", "channel", "x", "y", (F.pmod(F.col("channel") + F.col("x") + 2 * F.col("y"), F.lit(5)) / F.lit(5.0)).alias("d"))


@query(_PD + "SELECT sample, channel, x, y, round(CASE WHEN row_number() OVER (PARTITION BY sample, channel, px, py ORDER BY a DESC, y, x) = 1 THEN d ELSE 0 END, 6) AS d FROM w")
def max_pool_delta(spark, d):
    return dense.pool_delta(plane(spark, d), _pool_deltas(spark, d), 2, 2, "max", 4, 4).select("sample", "channel", "x", "y", *r6("d"))


@query(_PD + "SELECT sample, channel, x, y, round(d / 4, 6) AS d FROM w")
def avg_pool_delta(spark, d):
    return dense.pool_delta(plane(spark, d), _pool_deltas(spark, d), 2, 2, "average", 4, 4).select("sample", "channel", "x", "y", *r6("d"))


_CD = with_("units", "plane") + ", ds AS (SELECT vec_id AS sample, o::INT AS out, i::INT AS x, j::INT AS y, ((vec_id + o * 3 + i * 2 + j) % 11)::DOUBLE / 11 - 0.5 AS d FROM embeddings, range(2) r(o), range(2) s(i), range(2) t(j)) "
_KW = "((out * 5 + channel * 3 + dx * 2 + dy) % 7)::DOUBLE / 7 - 0.5"


def _grid_of(spark, **sizes):
    out = spark.range(1)
    for c, n in sizes.items():
        out = out.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.drop("id")


def _conv_deltas(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"))
    for c in ("out", "x", "y"):
        e = e.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(1))))
    return e.withColumn("d", F.pmod(F.col("sample") + F.col("out") * 3 + F.col("x") * 2 + F.col("y"), F.lit(11)) / F.lit(11.0) - F.lit(0.5))


@query(_CD + f"SELECT sample, c::INT AS channel, (x + dx)::INT AS x, (y + dy)::INT AS y, round({fixed('d * (' + _KW.replace('channel', 'c') + ')')}, 6) AS d FROM ds, range(4) q(c), range(3) u(dx), range(3) v(dy) GROUP BY 1, 2, 3, 4")
def convolution_delta(spark, d):
    k = _grid_of(spark, out=2, channel=4, dx=3, dy=3).withColumn("w", F.pmod(F.col("out") * 5 + F.col("channel") * 3 + F.col("dx") * 2 + F.col("dy"), F.lit(7)) / F.lit(7.0) - F.lit(0.5))
    return dense.convolution_delta(_conv_deltas(spark, d), k).select("sample", "channel", "x", "y", *r6("d"))


@query(_CD + f"SELECT out, channel, dx::INT AS dx, dy::INT AS dy, round({fixed('a * d')} * (-1::DOUBLE / 64), 6) AS g FROM ds, range(3) u(dx), range(3) v(dy) JOIN plane p ON p.sample = ds.sample AND p.x = ds.x + dx AND p.y = ds.y + dy GROUP BY 1, 2, 3, 4".replace("FROM ds, range(3) u(dx), range(3) v(dy) JOIN plane p ON", "FROM (SELECT * FROM ds, range(3) u(dx), range(3) v(dy)) ds JOIN plane p ON"))
def convolution_gradient(spark, d):
    return dense.convolution_gradient(plane(spark, d), _conv_deltas(spark, d), 3, 64).select("out", "channel", "dx", "dy", *r6("g"))


@query(with_("grid") + f", m AS (SELECT unit, {fixed('a')} / count(*) AS m, {fixed('a * a')} / count(*) AS q, {fixed('t')} / count(*) AS md, {fixed('t * a')} / count(*) AS mda FROM grid GROUP BY 1), s AS (SELECT *, sqrt(greatest(0, q - m * m) + 1e-5::DOUBLE) AS s FROM m) SELECT sample, unit, round(1 / s * (t - md - (a - m) / s * ((mda - m * md) / s)), 5) AS d FROM grid JOIN s USING (unit)")
def batch_norm_delta(spark, d):
    g = class_grid(spark, d)
    return dense.batch_norm_delta(g.select("sample", "unit", "a"), g.select("sample", "unit", F.col("t").alias("d"))).select("sample", "unit", *r6("d", digits=5))


@query(with_("grid") + "SELECT sample, unit, CASE WHEN row_number() OVER (PARTITION BY sample ORDER BY a DESC, unit) <= 3 THEN a ELSE 0 END AS a FROM grid")
def k_sparse(spark, d):
    return rank.k_sparse(class_grid(spark, d).select("sample", "unit", "a"), 3)


@query("WITH e AS (SELECT vec_id, embedding AS x FROM embeddings) SELECT vec_id AS sample, (i - 1)::INT AS unit, round(x[i]::DOUBLE / sqrt(" + _NX + "), 6) AS a FROM e, range(1, 65) r(i)")
def l2_normalise(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode(dense.l2_normalised(F.col("embedding"))).alias("unit", "a")).select("sample", "unit", *r6("a"))


@query("WITH x AS (SELECT c_custkey AS sample, u::INT AS unit, ((c_custkey * 11 + u * 5) % 37)::DOUBLE / 37 - 0.5 AS a FROM customer, range(8) r(u)), w AS (SELECT s AS src, t AS dst, " + w_sql("s", "t") + " AS w FROM range(8) a(s), range(8) b(t)) " + f"SELECT sample, src::INT AS unit, round({fixed('a * w')}, 6) AS z FROM x JOIN w ON unit = dst GROUP BY 1, 2")
def tied_weights(spark, d):
    """A decoder that uses its encoder's weights transposed."""
    x = _deltas(spark, d).withColumnRenamed("d", "a")
    return dense.dense_z(x, dense.transpose(_grid_of(spark, src=8, dst=8).select("src", "dst", formula(F.col("src"), F.col("dst")).alias("w")))).select("sample", "unit", *r6("z"))


_SEED = 12134


def _dense_w(src: int, dst: int, edge: int) -> str:
    return f"(SELECT src, dst, ({_u('src', 'dst', seed=_SEED + 7919 * edge)} * 2 - 1) * 0.25::DOUBLE AS w FROM range({src}) r(src), range({dst}) q(dst))"


def _network(spark, d, *hidden: dict, out: int):
    init = {"WeightInit": {"Scheme": "Uniform", "Scale": 0.25}}
    layers = [{"Name": "Input", "Kind": "Input", "N": [4, 4, 4]}, *[{"Kind": "Hidden", "Activation": "Tanh", **init, **x} for x in hidden], {"Name": "Output", "Kind": "Output", "N": out, "Activation": "Sigmoid", **init}]
    net = network.Network(spark, network.parse_network(json.dumps({"Layers": layers})), {}, _SEED)
    return net, embedding_units(spark, d).select("sample", F.col("unit").alias("feature"), F.col("a").alias("value"))


_CONV = f", c AS (SELECT sample, o, x, y, tanh({fixed('a * w')}) AS a FROM (SELECT p.sample, k.dst AS o, p.unit % 4 - k.src % 3 + 1 AS x, p.unit // 4 % 4 - k.src // 3 % 3 + 1 AS y, p.a, k.w FROM units p JOIN {_dense_w(36, 2, 0)} k ON k.src // 9 = p.unit // 16) WHERE x BETWEEN 0 AND 3 AND y BETWEEN 0 AND 3 GROUP BY 1, 2, 3, 4), m AS (SELECT sample, o * 4 + y // 2 * 2 + x // 2 AS src, max(a) AS a FROM c GROUP BY 1, 2)"


@query(with_("units") + _CONV + f" SELECT sample, dst AS unit, round(1 / (1 + exp(-{fixed('a * w')})), 6) AS a FROM m JOIN {_dense_w(8, 4, 1)} USING (src) GROUP BY 1, 2")
def network_forward(spark, d):
    """A convolution, max pooling and a sigmoid output over planes of 4 x 4 with 4 channels."""
    square = lambda k, s: {"Kernel": [k, k], "KernelStride": [s, s]}
    net, c = _network(spark, d, {"Name": "C", "Type": "Convolutional", "N": 2, **square(3, 1)}, {"Name": "M", "Type": "Pooling", "Pooling": "Max", "Activation": "Linear", **square(2, 2)}, out=4)
    return net.forward(c)["Output"].select("sample", "unit", *r6("a"))


_BACK = f", h AS (SELECT sample, dst AS j, tanh({fixed('a * w')}) AS h FROM units JOIN {_dense_w(64, 8, 0)} ON unit = src GROUP BY 1, 2), o AS (SELECT sample, dst AS k, 1 / (1 + exp(-{fixed('h * w')})) AS o FROM h JOIN {_dense_w(8, 10, 1)} ON j = src GROUP BY 1, 2), e AS (SELECT sample, k, (o - (k = label)::INT) * (o * (1 - o)) AS e FROM o JOIN embeddings ON vec_id = sample), b AS (SELECT sample, src AS j, {fixed('e * w')} AS b FROM e JOIN {_dense_w(8, 10, 1)} ON k = dst GROUP BY 1, 2), d AS (SELECT sample, j, b * (1 - h * h) AS d FROM b JOIN h USING (sample, j))"


@query(with_("units") + _BACK + f" SELECT unit::BIGINT AS src, j AS dst, round({fixed('a * d')} * (-1::DOUBLE / (SELECT count(*) FROM embeddings)), 6) AS g FROM units JOIN d USING (sample) GROUP BY 1, 2")
def network_backward(spark, d):
    """The gradient of the first weights of two fully connected layers, squared error against labels."""
    net, c = _network(spark, d, {"Name": "H", "N": 8}, out=10)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").cast("bigint").alias("feature"), F.lit(1.0).alias("value"))
    return net.gradients(c, labels)[0]["Input", "H"].select("src", "dst", *r6("g"))


@query("SELECT o_custkey AS sample, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, count(*) AS n FROM orders GROUP BY 1")
def sample_dates(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"), F.count("*").alias("n"))


@query(with_("cells") + "SELECT sample, count(*) AS stored, min(feature) AS first_feature, max(value) AS largest FROM cells GROUP BY 1")
def point_counts(spark, d):
    return cells(spark, d).groupBy("sample").agg(F.count("*").alias("stored"), F.min("feature").alias("first_feature"), F.max("value").alias("largest"))


@query(with_("units") + f"SELECT unit, round({fixed('a')} / count(*), 6) AS mean, round(sqrt({fixed('a * a')}), 6) AS magnitude FROM units GROUP BY 1")
def unit_statistics(spark, d):
    return embedding_units(spark, d).groupBy("unit").agg((fixed_sum(F.col("a")) / F.count("*")).alias("mean"), F.sqrt(fixed_sum(F.col("a") * F.col("a"))).alias("magnitude")).select("unit", *r6("mean", "magnitude"))
