"""One query for each operator, with the SQL that an oracle can run on the same tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions import activations, generators, losses, optimizers
from cellweave.functions.fixed import fixed_sum, padded_width
from cellweave.operators import dense, evaluate, knn, rank, sparse
from cellweave.plans.fixtures import UNITS, cells, class_grid, edges, embedding_units, fixed, formula, plane, raw_cells, table, w_sql, wide_weights, with_, x_grid
from cellweave.sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def r6(*columns: str, digits: int = 6):
    return [F.round(c, digits).alias(c) for c in columns]


# ------------------------------------------------------------------ text and indexes

_LISTS = with_("cells") + ", lists AS (SELECT sample, string_agg(feature || ',' || CAST(value AS BIGINT), ':' ORDER BY feature) AS l FROM cells GROUP BY 1)"


def _sample_lines(spark: SparkSession, d: str, values: bool = True) -> DataFrame:
    item = F.concat_ws(",", F.col("feature").cast("string"), *([F.col("value").cast("bigint").cast("string")] if values else []))
    lists = cells(spark, d).groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("feature", item.alias("s")))).alias("l"))
    return lists.select(F.concat(F.col("sample").cast("string"), F.lit("\t"), F.array_join(F.transform("l", lambda x: x["s"]), ":")).alias("value"))


@query(with_("cells") + "SELECT sample::VARCHAR AS sample, feature::VARCHAR AS feature, value::DOUBLE AS value, (row_number() OVER (PARTITION BY sample ORDER BY feature) - 1)::INT AS pos FROM cells")
def parse_analog(spark, d):
    return text.parse_samples(_sample_lines(spark, d), order=None)


@query(with_("cells") + "SELECT sample::VARCHAR AS sample, feature::VARCHAR AS feature, 0::DOUBLE AS value, (row_number() OVER (PARTITION BY sample ORDER BY feature) - 1)::INT AS pos FROM cells")
def parse_samples(spark, d):
    return text.parse_samples(_sample_lines(spark, d, values=False), order=None)


@query("WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) SELECT o_custkey::VARCHAR AS sample, o_orderkey::VARCHAR AS feature, 1::DOUBLE AS value, 0 AS pos FROM o WHERE r = 1")
def last_line_wins(spark, d):
    o = table(spark, d, "orders")
    lines = o.select(F.concat(F.col("o_custkey").cast("string"), F.lit("\t"), F.col("o_orderkey").cast("string"), F.lit(",1")).alias("value"), F.col("o_orderkey").alias("ord"))
    return text.parse_samples(lines)


@query("SELECT p_name AS label, (row_number() OVER (ORDER BY k, p_name) - 1)::BIGINT AS idx FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1)")
def index_build(spark, d):
    return text.build_index(table(spark, d, "part").select(F.col("p_name").alias("label"), "p_partkey"), "p_partkey")


@query("WITH o AS (SELECT DISTINCT p_brand AS label FROM part), a AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM o), n AS (SELECT p_type AS label, min(p_partkey) AS k FROM part GROUP BY 1) SELECT label, idx::BIGINT AS idx FROM a UNION ALL SELECT label, ((SELECT max(idx) FROM a) + row_number() OVER (ORDER BY k, label))::BIGINT FROM n WHERE label NOT IN (SELECT label FROM a)")
def index_merge(spark, d):
    p = table(spark, d, "part")
    old = text.build_index(p.select(F.col("p_brand").alias("label")).withColumn("s", F.col("label")), "s")
    return text.build_index(p.select(F.col("p_type").alias("label"), "p_partkey"), "p_partkey", old)


@query("SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def index_duplicate_check(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT r_name AS label, r_regionkey::BIGINT AS idx FROM region")
def index_parse(spark, d):
    lines = table(spark, d, "region").select(F.concat_ws("\t", "r_name", F.col("r_regionkey").cast("string")).alias("value"))
    return text.parse_index(lines)


@query("SELECT p_partkey AS n, (((p_partkey + 127) // 128) * 128)::BIGINT AS width FROM part")
def width_align(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), padded_width(F.col("p_partkey")).alias("width"))


@query("WITH s AS (SELECT o_custkey AS sample, o_orderkey AS label, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT sample || chr(9) || string_agg(label || ',' || printf('%.3f', score) || ':', '' ORDER BY rank) AS value FROM s WHERE rank <= 5 GROUP BY sample")
def recs_format(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("score"))
    return text.format_recs(rank.topk(s, 5), label="idx")


@query("SELECT o_custkey || chr(9) || string_agg(o_orderkey || ',' || substr(o_orderpriority, 1, 1), ':' ORDER BY o_orderkey) AS value FROM orders GROUP BY o_custkey")
def ratings_to_text(spark, d):
    o = table(spark, d, "orders")
    return text.ratings_to_lines(o.select(F.col("o_custkey").alias("userId"), F.col("o_orderkey").alias("movieId"), F.substring("o_orderpriority", 1, 1).alias("rating")))


@query("SELECT sample, feature, value FROM (SELECT o_custkey AS sample, l_partkey AS feature, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) JOIN part ON feature = p_partkey JOIN customer ON sample = c_custkey")
def label_lookup(spark, d):
    c = cells(spark, d).select(F.col("sample").cast("string").alias("sample"), F.col("feature").cast("string").alias("feature"), "value")
    s = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("label"), F.col("c_custkey").alias("idx"))
    f = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("label"), F.col("p_partkey").alias("idx"))
    return text.index_cells(c, s, f)


@query("SELECT vec_id::VARCHAR AS key, len(embedding)::INT AS n, round(embedding[1]::DOUBLE, 4) AS first, round(embedding[64]::DOUBLE, 4) AS last FROM embeddings")
def parse_vectors(spark, d):
    e = table(spark, d, "embeddings")
    lines = e.select(F.concat(F.col("vec_id").cast("string"), F.lit("\t"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"))
    v = text.parse_vectors(lines)
    return v.select("key", F.size("vec").alias("n"), F.round(F.get("vec", F.lit(0)).cast("double"), 4).alias("first"), F.round(F.get("vec", F.lit(63)).cast("double"), 4).alias("last"))


# ------------------------------------------------------------------ sparse data


@query(with_("cells") + ", n AS (SELECT sample, count(*) AS k FROM cells GROUP BY 1) SELECT sample, (sum(k) OVER (ORDER BY sample) - k)::BIGINT AS \"start\", (sum(k) OVER (ORDER BY sample))::BIGINT AS \"end\" FROM n")
def csr_row_ranges(spark, d):
    return sparse.row_ranges(cells(spark, d))


@query(with_("raw") + ", k AS (SELECT feature, sample, count(*) AS k FROM raw GROUP BY 1, 2) SELECT feature, sum(k)::BIGINT AS n, max(k) AS most_repeats, count(*) FILTER (WHERE k > 1) AS repeating FROM k GROUP BY 1")
def feature_counts(spark, d):
    return sparse.feature_counts(raw_cells(spark, d))


@query(with_("raw") + ", k AS (SELECT feature, sample, count(*) AS k FROM raw GROUP BY 1, 2) SELECT max(k) AS most_repeats, count(DISTINCT sample) FILTER (WHERE k > 1) AS samples_with_repeats FROM k")
def duplicate_stats(spark, d):
    k = raw_cells(spark, d).groupBy("feature", "sample").agg(F.count("*").alias("k"))
    return k.groupBy("sample").agg(F.max("k").alias("k")).agg(F.max("k").alias("most_repeats"), F.count_if(F.col("k") > 1).alias("samples_with_repeats"))


@query(with_("cells") + "SELECT count(*) AS nnz, count(*)::DOUBLE / ((SELECT count(*) FROM customer)::DOUBLE * (SELECT count(*) FROM part)) AS density FROM cells")
def sparse_density(spark, d):
    return sparse.density(cells(spark, d), table(spark, d, "customer").count(), table(spark, d, "part").count())


@query(with_("cells") + "SELECT o_orderkey AS sample, feature, value FROM orders JOIN cells ON o_custkey = sample")
def indexed_gather(spark, d):
    index = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("unique_id"))
    return sparse.gather(index, cells(spark, d))


@query(with_("cells") + "SELECT sample, feature, value * (1::DOUBLE + c_nationkey::DOUBLE / 10) AS value FROM cells JOIN customer ON sample = c_custkey")
def weighted_cells(spark, d):
    w = table(spark, d, "customer").select(F.col("c_custkey").alias("sample"), (F.lit(1.0) + F.col("c_nationkey").cast("double") / F.lit(10.0)).alias("weight"))
    return sparse.weighted(cells(spark, d), w).select("sample", "feature", (F.col("value") * F.col("weight")).alias("value"))


def _u(*keys: str, seed: int = 12134) -> str:
    h = str(seed)
    for k in keys:
        h = f"((((({h})::BIGINT * 48271 + ({k})::BIGINT % 2147483647 * 69621 + 12345) % 2147483647) * 40692 + 67891) % 2147483647)"
    return f"((({h} * 48271) % 2147483647 + 1)::DOUBLE / 2147483647::DOUBLE)"


@query(with_("cells") + f"SELECT sample, feature, value * 1.25::DOUBLE AS value FROM cells WHERE {_u('sample', 'feature', '3')} >= 0.2")
def denoise(spark, d):
    return sparse.denoise(cells(spark, d), 0.2, epoch=3)


@query("SELECT vec_id AS sample, u::INT AS feature, CASE WHEN label = u THEN 1::DOUBLE ELSE 0::DOUBLE END AS value FROM embeddings, range(10) r(u)")
def one_hot(spark, d):
    return sparse.one_hot(table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), "label"), "label", 10)


_Z = "SELECT sample, u::INT AS unit, round({sum}, 6) AS z FROM {c}, range(8) r(u) GROUP BY 1, 2"


def _z(value: str, name: str = "cells") -> str:
    return _Z.format(sum=fixed(f"{value} * ({w_sql('feature', 'u')})"), c=name)


@query(with_("cells") + _z("value"))
def sparse_z_analog(spark, d):
    return sparse.sparse_z(cells(spark, d), wide_weights(spark, d), UNITS).select("sample", "unit", *r6("z"))


@query(with_("cells") + _z("1::DOUBLE"))
def sparse_z_bool(spark, d):
    return sparse.sparse_z(cells(spark, d), wide_weights(spark, d), UNITS, boolean=True).select("sample", "unit", *r6("z"))


@query(with_("cells") + ", g AS (SELECT o_orderkey AS sample, feature, value FROM orders JOIN cells ON o_custkey = sample) " + _z("value", "g"))
def sparse_z_indexed(spark, d):
    index = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("unique_id"))
    # the product once for each stored row, then gathered: linear in the stored cells
    z = sparse.sparse_z(cells(spark, d), wide_weights(spark, d), UNITS)
    return index.join(z.withColumnRenamed("sample", "unique_id"), "unique_id").select("sample", "unit", *r6("z"))


@query(with_("cells") + f", g AS (SELECT sample, feature, value * 1.25::DOUBLE AS value FROM cells WHERE {_u('sample', 'feature', '0')} >= 0.2) " + _z("value", "g"))
def sparse_z_denoised(spark, d):
    return sparse.sparse_z(sparse.denoise(cells(spark, d), 0.2), wide_weights(spark, d), UNITS).select("sample", "unit", *r6("z"))


@query(with_("units") + f"SELECT sample, u::INT AS unit, round({fixed('a * (' + w_sql('unit', 'u') + ')')}, 6) AS z FROM units, range(8) r(u) GROUP BY 1, 2")
def dense_z(spark, d):
    w = spark.range(64).select(F.col("id").alias("src")).withColumn("dst", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return dense.dense_z(embedding_units(spark, d), w.select("src", "dst", formula(F.col("src"), F.col("dst")).alias("w"))).select("sample", "unit", *r6("z"))


@query(with_("xs") + "SELECT sample, unit, round(x + (unit::DOUBLE / 8) + (unit::DOUBLE / 16) + 0.5, 6) AS z FROM xs")
def bias_multi_source(spark, d):
    units = spark.range(10).select(F.col("id").cast("int").alias("unit"))
    b = [units.select("unit", (F.col("unit") / F.lit(8.0)).alias("b")), units.select("unit", (F.col("unit") / F.lit(16.0)).alias("b")), units.select("unit", F.lit(0.5).alias("b"))]
    return dense.add_bias(x_grid(spark, d).withColumnRenamed("x", "z"), *b).select("sample", "unit", *r6("z"))


@query(with_("xs", "grid") + "SELECT x.sample, x.unit, round(x + a, 6) AS a FROM xs x JOIN grid g ON x.sample = g.sample AND x.unit = g.unit")
def skip_add(spark, d):
    return dense.skip_add(x_grid(spark, d).withColumnRenamed("x", "a"), class_grid(spark, d).select("sample", "unit", "a")).select("sample", "unit", *r6("a"))


@query(with_("xs") + "SELECT sample, unit, 0.5::DOUBLE * x - 0.25::DOUBLE AS a FROM xs")
def scale_bias(spark, d):
    return x_grid(spark, d).select("sample", "unit", dense.scale_and_bias(F.col("x"), 0.5, 0.25).alias("a"))


_ACT = {
    "sigmoid": ("1 / (1 + exp(-x))", {}), "tanh": ("tanh(x)", {}), "relu": ("greatest(x, 0)", {}), "lrelu": ("greatest(x, x * 0.1::DOUBLE)", {"slope": 0.1}),
    "elu": ("CASE WHEN x > 0 THEN x ELSE 0.8::DOUBLE * (exp(x) - 1) END", {"alpha": 0.8}), "selu": ("CASE WHEN x > 0 THEN 1.050701::DOUBLE * x ELSE 1.050701::DOUBLE * 1.673263::DOUBLE * (exp(x) - 1) END", {"alpha": 1.673263}), "linear": ("x", {}),
}
for _name, (_expr, _args) in _ACT.items():
    query(with_("xs") + f"SELECT sample, unit, round({_expr}, 6) AS a FROM xs", f"act_{_name}")(lambda spark, d, n=_name, k=_args: x_grid(spark, d).select("sample", "unit", activations.activation(n, F.col("x"), **k).alias("a")).select("sample", "unit", *r6("a")))


@query(with_("xs") + "SELECT sample, unit, round(least(1, exp(x - max(x) OVER w) / sum(exp(x - (SELECT max(x) FROM xs y WHERE y.sample = xs.sample))) OVER w), 6) AS a FROM xs WINDOW w AS (PARTITION BY sample)")
def act_softmax(spark, d):
    return activations.softmax(x_grid(spark, d)).select("sample", "unit", *r6("a"))


@query(with_("grid") + f"SELECT sample, unit, round(CASE WHEN {_u('sample', 'unit', '1')} < 0.3 THEN 0 ELSE a * (1 / 0.7::DOUBLE) END, 6) AS a FROM grid")
def dropout(spark, d):
    return dense.dropout(class_grid(spark, d).select("sample", "unit", "a"), 0.3, epoch=1).select("sample", "unit", *r6("a"))


@query(with_("grid") + f", m AS (SELECT unit, {fixed('a')} / count(*) AS m, {fixed('a * a')} / count(*) AS q FROM grid GROUP BY 1) SELECT sample, unit, round((a - m) / sqrt(greatest(0, q - m * m) + 1e-5::DOUBLE), 5) AS a FROM grid JOIN m USING (unit)")
def batch_norm(spark, d):
    return dense.batch_norm(class_grid(spark, d)).select("sample", "unit", *r6("a", digits=5))


# ------------------------------------------------------------------ pooling

_DOT = "list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_PAIR = "WITH e AS (SELECT vec_id, embedding AS x, lead(embedding) OVER (ORDER BY vec_id) AS y FROM embeddings), p AS (SELECT * FROM e WHERE y IS NOT NULL) "


def _pairs(spark, d):
    # ids are consecutive, so a vector's follower is an equi-join away
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")


_D, _NX, _NY = _DOT.format(x="x", y="y"), _DOT.format(x="x", y="x"), _DOT.format(x="y", y="y")


@query(_PAIR + f"SELECT vec_id, round({_D}, 6) AS a FROM p")
def dot_product(spark, d):
    return _pairs(spark, d).select("vec_id", dense.dot(F.col("x"), F.col("y")).alias("a")).select("vec_id", *r6("a"))


@query(_PAIR + f"SELECT vec_id, round({_D} / ((sqrt({_NX}) + 1e-8) * (sqrt({_NY}) + 1e-8)), 6) AS a FROM p")
def cosine(spark, d):
    return _pairs(spark, d).select("vec_id", dense.cosine(F.col("x"), F.col("y")).alias("a")).select("vec_id", *r6("a"))


@query(_PAIR + f", n AS (SELECT vec_id, x, y, sqrt({_NX}) + 1e-8 AS a, sqrt({_NY}) + 1e-8 AS b, {_D} AS dp FROM p) SELECT vec_id, (i - 1)::INT AS unit, round(0.5 * (y[i]::DOUBLE / (a * b) - x[i]::DOUBLE * dp / (a * a * a * b)), 6) AS d FROM n, range(1, 65) r(i)")
def cosine_delta(spark, d):
    return _pairs(spark, d).select("vec_id", F.posexplode(dense.cosine_delta(F.col("x"), F.col("y"), F.lit(0.5))).alias("unit", "d")).select("vec_id", "unit", *r6("d"))


@query(with_("xs", "grid") + "SELECT x.sample, x.unit, greatest(x, a) AS a FROM xs x JOIN grid g ON x.sample = g.sample AND x.unit = g.unit")
def maxout(spark, d):
    return dense.maxout(x_grid(spark, d).withColumnRenamed("x", "a"), class_grid(spark, d).select("sample", "unit", "a"))


_WIN = with_("units", "plane") + "SELECT sample, channel, i::INT AS x, j::INT AS y, {v} AS a FROM plane, range(2) r(i), range(2) q(j) WHERE x >= i * 2 AND x < i * 2 + 2 AND y >= j * 2 AND y < j * 2 + 2 GROUP BY 1, 2, 3, 4"


@query(_WIN.format(v="max(a)"))
def max_pool(spark, d):
    return dense.pool(plane(spark, d), 2, 2, "max", 4, 4)


@query(_WIN.format(v=f"round({fixed('a')} / 4, 6)"))
def avg_pool(spark, d):
    return dense.pool(plane(spark, d), 2, 2, "average", 4, 4).select("sample", "channel", "x", "y", *r6("a"))


@query(with_("units", "plane") + "SELECT sample, channel, x, y, round(a / pow(2 + (1e-4::DOUBLE / 5) * sum(a * a) OVER (PARTITION BY sample, x, y ORDER BY channel RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0.75), 6) AS a FROM plane")
def lrn(spark, d):
    return dense.lrn(plane(spark, d)).select("sample", "channel", "x", "y", *r6("a"))


@query(with_("units", "plane") + f"SELECT sample, o::INT AS out, (x - dx)::INT AS x, (y - dy)::INT AS y, round({fixed('a * (((o * 5 + channel * 3 + dx * 2 + dy) % 7)::DOUBLE / 7 - 0.5)')}, 6) AS z FROM plane, range(2) r(o), range(3) s(dx), range(3) t(dy) WHERE x - dx BETWEEN 0 AND 1 AND y - dy BETWEEN 0 AND 1 GROUP BY 1, 2, 3, 4")
def convolution(spark, d):
    n = lambda c, k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(c)
    k = spark.range(1).select(n("out", 2)).select("out", n("channel", 4)).select("out", "channel", n("dx", 3)).select("out", "channel", "dx", n("dy", 3))
    k = k.withColumn("w", F.pmod(F.col("out") * 5 + F.col("channel") * 3 + F.col("dx") * 2 + F.col("dy"), F.lit(7)).cast("double") / F.lit(7.0) - F.lit(0.5))
    return dense.convolve(plane(spark, d), k, 4, 4).select("sample", "out", "x", "y", *r6("z"))


# ------------------------------------------------------------------ losses

_M = losses.Margin(0.9, 0.1, 1.0, 0.5)
_LN = "ln(greatest(1e-12::DOUBLE, {x}))"
_LA, _LB = _LN.format(x="a"), _LN.format(x="1 - a")
_H = "(CASE WHEN t > 0 THEN least(0, a - abs(t)) ELSE greatest(0, a - abs(t)) END)"
_LOSS = {
    "l1": "w * abs(a - t)", "l2": "0.5::DOUBLE * w * (a - t) * (a - t)", "l2hinge": f"0.5::DOUBLE * w * {_H} * {_H}", "hinge": "w * greatest(0, 1 - t * a)",
    "crossentropy": f"w * (-t * {_LA} - (1 - t) * {_LB})", "multinomialcrossentropy": f"-w * t * {_LA}",
    "scaledmarginalcrossentropy": f"w * CASE WHEN t = 1 AND a < 0.9 THEN -{_LA} WHEN t = 0 AND a > 0.1 THEN -0.5::DOUBLE * {_LB} ELSE 0 END",
    "multinomialscaledmarginalcrossentropy": f"CASE WHEN t <> 0 AND a < 0.9 THEN -w * t * {_LA} ELSE 0 END",
    "datascaledmarginalcrossentropy": f"CASE WHEN t <> 0 AND a < 0.9 THEN -t * {_LA} WHEN t = 0 AND a > 0.1 THEN -0.5::DOUBLE * {_LB} ELSE 0 END",
}
_SIGNED = "(SELECT sample, unit, a, 2 * t - 1 AS t, w FROM grid)"


def _targets(name: str, g: DataFrame) -> DataFrame:
    return g.withColumn("t", F.lit(2.0) * F.col("t") - F.lit(1.0)) if name in ("hinge", "l2hinge") else g


for _name, _expr in _LOSS.items():
    _from = _SIGNED if _name in ("hinge", "l2hinge") else "grid"
    query(with_("grid") + f"SELECT round({fixed(_expr)}, 5) AS loss FROM {_from}", f"loss_{_name}")(lambda spark, d, n=_name: losses.dense_loss(n, _targets(n, class_grid(spark, d)), _M).select(*r6("loss", digits=5)))
    if _name not in ("hinge",):
        # stored targets only: the oracle spreads them over the whole grid
        query(with_("grid") + f"SELECT round({fixed(_expr)}, 5) AS loss FROM grid", f"sparse_loss_{_name}")(lambda spark, d, n=_name: losses.sparse_loss(n, class_grid(spark, d).drop("t"), class_grid(spark, d).where("t = 1").select("sample", "unit"), margin=_M).select(*r6("loss", digits=5)))
        query(with_("grid") + f"SELECT round({fixed(_expr)}, 5) AS loss FROM grid WHERE t = 1", f"sparse_loss_ignore_zero_{_name}")(lambda spark, d, n=_name: losses.sparse_loss(n, class_grid(spark, d).drop("t"), class_grid(spark, d).where("t = 1").select("sample", "unit"), ignore_zero=True, margin=_M).select(*r6("loss", digits=5)))


@query(with_("edges") + f"SELECT round({fixed('0.5 * 0.01::DOUBLE * w * w + 0.001::DOUBLE * abs(w)')}, 5) AS loss FROM edges")
def regularization(spark, d):
    return losses.regularization(edges(spark, d), 0.01, 0.001).select(*r6("loss", digits=5))


#: Stored targets that hold any value, spread over the grid by the oracle.
_ANALOG = "(SELECT sample, unit, a, w, CASE WHEN t = 1 THEN 0.25::DOUBLE + (sample % 7) / 4::DOUBLE ELSE 0 END AS t FROM grid)"


def analog_targets(spark, d):
    return class_grid(spark, d).where("t = 1").select("sample", "unit", (F.lit(0.25) + F.pmod("sample", F.lit(7)) / F.lit(4.0)).alias("t"))


for _name in ("l1", "l2", "l2hinge", "hinge", "multinomialcrossentropy", "multinomialscaledmarginalcrossentropy", "datascaledmarginalcrossentropy"):
    query(with_("grid") + f"SELECT round({fixed(_LOSS[_name])}, 5) AS loss FROM {_ANALOG}", f"sparse_loss_analog_{_name}")(lambda spark, d, n=_name: losses.sparse_loss(n, class_grid(spark, d).drop("t"), analog_targets(spark, d), boolean=False, margin=_M).select(*r6("loss", digits=5)))
    query(with_("grid") + f"SELECT round({fixed(_LOSS[_name])}, 5) AS loss FROM {_ANALOG} WHERE t <> 0", f"sparse_loss_analog_ignore_zero_{_name}")(lambda spark, d, n=_name: losses.sparse_loss(n, class_grid(spark, d).drop("t"), analog_targets(spark, d), ignore_zero=True, boolean=False, margin=_M).select(*r6("loss", digits=5)))


# ------------------------------------------------------------------ deltas

_DER = {"sigmoid": "a * (1 - a)", "tanh": "(1 - a * a)", "relu": "CASE WHEN a > 0 THEN 1 ELSE 0 END", "lrelu": "CASE WHEN a > 0 THEN 1 ELSE 0.1::DOUBLE END", "elu": "CASE WHEN a > 0 THEN 1 ELSE a + 0.8::DOUBLE END", "selu": "CASE WHEN a > 0 THEN 1.050701::DOUBLE ELSE {selu} END", "linear": "1", "softmax": "1"}
_OUT_SELU, _HIDDEN_SELU = "1.050701::DOUBLE * 0.8::DOUBLE * exp(a)", "a + 1.050701::DOUBLE * 0.8::DOUBLE"
_AGRID = with_("grid") + ", c AS (SELECT sample, unit, 2 * a - 1 AS a, t, w FROM grid) "


def _centred(spark, d):
    return class_grid(spark, d).withColumn("a", F.lit(2.0) * F.col("a") - F.lit(1.0))


for _act, _f in _DER.items():
    _of = _f.format(selu=_OUT_SELU)
    for _name, _e in (("l1", "w * sign(a - t)"), ("l2", "w * (a - t)"), ("l2hinge", f"w * {_H}")):
        query(_AGRID + f"SELECT sample, unit, round({_e} * ({_of}), 6) AS d FROM c", f"delta_{_name}_{_act}")(lambda spark, d, n=_name, x=_act: _centred(spark, d).select("sample", "unit", losses.output_delta(n, x, F.col("a"), F.col("t"), F.col("w"), slope=0.1, alpha=0.8).alias("d")).select("sample", "unit", *r6("d")))
    if _act != "softmax":
        query(_AGRID + f"SELECT sample, unit, round((0.5::DOUBLE - t) * ({_f.format(selu=_HIDDEN_SELU)}), 6) AS d FROM c", f"hadamard_{_act}")(lambda spark, d, x=_act: _centred(spark, d).select("sample", "unit", ((F.lit(0.5) - F.col("t")) * activations.derivative(x, F.col("a"), slope=0.1, alpha=0.8)).alias("d")).select("sample", "unit", *r6("d")))
_SM = "CASE WHEN t = 1 AND a < 0.9 THEN w * (a - t) WHEN t = 0 AND a > 0.1 THEN w * 0.5::DOUBLE * (a - t) ELSE 0 END"
for _name, _act, _e in (
    ("crossentropy", "sigmoid", "w * (a - t)"), ("multinomialcrossentropy", "softmax", "w * (a - t)"), ("scaledmarginalcrossentropy", "sigmoid", _SM), ("multinomialscaledmarginalcrossentropy", "softmax", _SM),
    ("datascaledmarginalcrossentropy", "sigmoid", "CASE WHEN t <> 0 AND a < 0.9 THEN t * (a - 1) WHEN t = 0 AND a > 0.1 THEN 0.5::DOUBLE * a ELSE 0 END"), ("hinge", "linear", "w * CASE WHEN a < 0 THEN -t ELSE 0 END"),
):
    query(with_("grid") + f"SELECT sample, unit, round({_e}, 6) AS d FROM grid", f"delta_{_name}_{_act}")(lambda spark, d, n=_name, x=_act: class_grid(spark, d).select("sample", "unit", losses.output_delta(n, x, F.col("a"), F.col("t"), F.col("w"), _M).alias("d")).select("sample", "unit", *r6("d")))


@query(with_("grid") + f", q AS (SELECT unit, least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, {fixed('a')} / count(*))) AS q FROM grid GROUP BY 1) SELECT unit, round(2 * (-0.1::DOUBLE / q + 0.9::DOUBLE / (1 - q)), 6) AS penalty FROM q")
def sparseness_penalty(spark, d):
    return losses.sparseness_penalty(class_grid(spark, d), 0.1, 2.0).select("unit", *r6("penalty"))


@query(with_("grid") + f", n AS (SELECT sample, sqrt({fixed('a * a')}) AS n FROM grid GROUP BY 1) SELECT sample, unit, round(CASE WHEN n > 1.5 THEN a * 1.5::DOUBLE / n ELSE a END, 6) AS a FROM grid JOIN n USING (sample)")
def delta_norm(spark, d):
    return losses.clip_norm(class_grid(spark, d).select("sample", "unit", "a"), 1.5, "a").select("sample", "unit", *r6("a"))


# ------------------------------------------------------------------ gradients

_DELTA = with_("cells") + ", deltas AS (SELECT c_custkey AS sample, u::INT AS unit, ((c_custkey * 11 + u * 5) % 37)::DOUBLE / 37 - 0.5 AS d FROM customer, range(8) r(u)) "


def _deltas(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample")).withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return c.select("sample", "unit", (F.pmod(F.col("sample") * 11 + F.col("unit") * 5, F.lit(37)).cast("double") / F.lit(37.0) - F.lit(0.5)).alias("d"))


for _name, _v in (("analog", "value"), ("bool", "1::DOUBLE")):
    query(_DELTA + f"SELECT feature AS src, unit AS dst, round({fixed(_v + ' * d')} * (-1::DOUBLE / 256), 6) AS g FROM cells JOIN deltas USING (sample) GROUP BY 1, 2", f"weight_gradient_{_name}")(lambda spark, d, b=_name == "bool": sparse.weight_gradient(cells(spark, d), _deltas(spark, d), 256, boolean=b).select("src", "dst", *r6("g")))


@query(_DELTA + f"SELECT unit, round({fixed('d')} / 256, 6) AS g FROM deltas GROUP BY 1")
def bias_gradient(spark, d):
    return dense.bias_gradient(_deltas(spark, d), 256).select("unit", *r6("g"))


@query(_DELTA + f"SELECT sample, s::INT AS unit, round({fixed('d * (' + w_sql('s', 'unit') + ')')}, 6) AS d FROM deltas, range(16) r(s) GROUP BY 1, 2")
def back_delta(spark, d):
    w = spark.range(16).select(F.col("id").cast("int").alias("src")).withColumn("dst", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return dense.back_delta(_deltas(spark, d), w.select("src", "dst", formula(F.col("src"), F.col("dst")).alias("w"))).select("sample", "unit", *r6("d"))


@query(with_("edges") + "SELECT dst AS src, src AS dst, w FROM edges")
def transpose(spark, d):
    return dense.transpose(edges(spark, d).select("src", "dst", "w"))


# ------------------------------------------------------------------ optimizers

_G = "(g - (0.01::DOUBLE * w + 0.001::DOUBLE * sign(w)))"
_STEP = {
    "sgd": (f"w + 0.1::DOUBLE * {_G}", "v", "vg"),
    "momentum": (f"w + 0.9::DOUBLE * v + 0.1::DOUBLE * {_G}", f"0.9::DOUBLE * v + 0.1::DOUBLE * {_G}", "vg"),
    "nesterov": (f"w + (0.9::DOUBLE * v + 0.1::DOUBLE * {_G}) + 0.9::DOUBLE * ((0.9::DOUBLE * v + 0.1::DOUBLE * {_G}) - v)", f"0.9::DOUBLE * v + 0.1::DOUBLE * {_G}", "vg"),
    "adagrad": (f"w + 0.1::DOUBLE * {_G} / sqrt(greatest(1e-9, v + {_G} * {_G}))", f"v + {_G} * {_G}", "vg"),
    "rmsprop": (f"w + 0.1::DOUBLE * {_G} / sqrt(greatest(1e-9, 0.9::DOUBLE * v + 0.1::DOUBLE * {_G} * {_G}))", f"0.9::DOUBLE * v + 0.1::DOUBLE * {_G} * {_G}", "vg"),
    "adadelta": (f"w + sqrt(greatest(1e-9, v) / greatest(1e-9, 0.9::DOUBLE * vg + 0.1::DOUBLE * {_G} * {_G})) * {_G}", f"0.9::DOUBLE * v + 0.1::DOUBLE * pow(sqrt(greatest(1e-9, v) / greatest(1e-9, 0.9::DOUBLE * vg + 0.1::DOUBLE * {_G} * {_G})) * {_G}, 2)", f"0.9::DOUBLE * vg + 0.1::DOUBLE * {_G} * {_G}"),
    "adam": (f"w + 0.1::DOUBLE * ((0.9::DOUBLE * v + 0.1::DOUBLE * {_G}) / (1 - pow(0.9::DOUBLE, 4))) / (sqrt((0.999::DOUBLE * vg + 0.001::DOUBLE * {_G} * {_G}) / (1 - pow(0.999::DOUBLE, 4))) + 1e-8)", f"0.9::DOUBLE * v + 0.1::DOUBLE * {_G}", f"0.999::DOUBLE * vg + 0.001::DOUBLE * {_G} * {_G}"),
}
for _name, (_w, _v, _vg) in _STEP.items():
    query(with_("edges") + f"SELECT src, dst, round({_w}, 9) AS w, round({_v}, 9) AS v, round({_vg}, 9) AS vg FROM edges", f"opt_{_name}")(lambda spark, d, n=_name: optimizers.step(n, edges(spark, d), 0.1, 0.9, 0.01, 0.001, 3).select("src", "dst", *r6("w", "v", "vg", digits=9)))
    _bw = {k: x.replace(_G, "(-g)") for k, x in (("w", _w), ("v", _v), ("vg", _vg))}
    query(with_("edges") + f"SELECT src, dst, round({_bw['w']}, 9) AS w, round({_bw['v']}, 9) AS v, round({_bw['vg']}, 9) AS vg FROM edges", f"opt_bias_{_name}")(lambda spark, d, n=_name: optimizers.step(n, edges(spark, d), 0.1, 0.9, t=3, bias=True).select("src", "dst", *r6("w", "v", "vg", digits=9)))


@query(with_("edges") + "SELECT src, dst, round(w + 0.9::DOUBLE * v, 6) AS w FROM edges")
def nesterov_shift(spark, d):
    return optimizers.look_ahead(edges(spark, d), 0.9).select("src", "dst", *r6("w"))


@query(with_("edges") + f", n AS (SELECT dst, sqrt({fixed('w * w')}) AS n FROM edges GROUP BY 1) SELECT src, dst, round(CASE WHEN n > 2 THEN w * 2::DOUBLE / n ELSE w END, 6) AS w FROM edges JOIN n USING (dst)")
def weight_norm(spark, d):
    return optimizers.max_norm(edges(spark, d).select("src", "dst", "w"), 2.0).select("src", "dst", *r6("w"))


@query("SELECT p_partkey AS batch, round(0.1::DOUBLE / (1 + 0.01::DOUBLE * p_partkey), 9) AS alpha FROM part")
def lr_decay(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("batch"), F.round(F.lit(0.1) / (F.lit(1.0) + F.lit(0.01) * F.col("p_partkey")), 9).alias("alpha"))


_UU, _U2 = _u("src", "dst"), _u("src", "dst", seed=12135)
_NORMAL = f"sqrt(-2 * ln({_UU})) * cos(2 * pi() * {_U2})"
for _name, _e in (("caffexavier", f"({_UU} * 2 - 1) * sqrt(3::DOUBLE / 8)"), ("xavier", f"({_UU} * 2 - 1) * (0.5 * sqrt(6::DOUBLE / (100 + 8)))"), ("uniform", f"{_UU} * 2 - 1"), ("unitball", _UU), ("constant", "-1::DOUBLE"), ("gaussian", _NORMAL), ("selu", f"{_NORMAL} * (1 / 100::DOUBLE)")):
    query(with_("edges") + f"SELECT src, dst, round({_e}, 6) AS w FROM edges", f"init_{_name}")(lambda spark, d, n=_name: edges(spark, d).select("src", "dst", generators.weight_init(n, F.col("src"), F.col("dst"), 100, 8).alias("w")).select("src", "dst", *r6("w")))


# ------------------------------------------------------------------ ranking

_RANK = "row_number() OVER (PARTITION BY sample ORDER BY score DESC, idx)"
_SCORES = with_("cells") + ", scores AS (SELECT sample, feature AS idx, value * ((feature * 7) % 13 + 1) AS score FROM cells) "


def _scores(spark, d):
    return cells(spark, d).select("sample", F.col("feature").alias("idx"), (F.col("value") * (F.pmod(F.col("feature") * 7, F.lit(13)) + 1)).alias("score"))


@query(_SCORES + f"SELECT * FROM (SELECT sample, idx, score, ({_RANK})::INT AS rank FROM scores) WHERE rank <= 10")
def topk(spark, d):
    return rank.topk(_scores(spark, d), 10)


@query(_SCORES + f"SELECT * FROM (SELECT sample, idx, score, (idx::DOUBLE / 4) AS payload, ({_RANK})::INT AS rank FROM scores) WHERE rank <= 10")
def topk_payload(spark, d):
    return rank.topk(_scores(spark, d).withColumn("payload", F.col("idx") / F.lit(4.0)), 10)


@query(_SCORES + f"SELECT * FROM (SELECT sample, idx, score, (idx % 32)::BIGINT AS payload, ({_RANK})::INT AS rank FROM scores) WHERE rank <= 128")
def topk_uint_payload(spark, d):
    return rank.topk(_scores(spark, d).withColumn("payload", F.pmod(F.col("idx"), F.lit(32))), 128)


@query(_SCORES + f"SELECT * FROM (SELECT sample, idx, score, ({_RANK})::INT AS rank FROM scores) WHERE rank <= 10")
def topk_two_level(spark, d):
    return rank.topk_two_level(_scores(spark, d), 10, 4)


_FILTER = ", f AS (SELECT o_custkey AS sample, l_partkey AS idx, min((l_linenumber % 2)::DOUBLE / 2) AS factor FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) "


def _filters(spark, d):
    o, i = table(spark, d, "orders"), table(spark, d, "lineitem")
    return i.join(o, i["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_custkey").alias("sample"), F.col("l_partkey").alias("feature")).agg(F.min(F.pmod("l_linenumber", F.lit(2)) / F.lit(2.0)).alias("factor"))


@query(_SCORES + _FILTER + "SELECT sample, idx, score * coalesce(factor, 1) AS score FROM scores LEFT JOIN f USING (sample, idx)")
def filter_multiply(spark, d):
    return rank.apply_filter(_scores(spark, d), _filters(spark, d))


@query(_SCORES + _FILTER + "SELECT sample, idx, score * CASE WHEN idx >= 50 AND idx < 150 THEN coalesce(factor, 1) ELSE 1 END AS score FROM scores LEFT JOIN f USING (sample, idx)")
def filter_shard(spark, d):
    return rank.apply_filter(_scores(spark, d), _filters(spark, d), lo=50, hi=150)


@query("SELECT o_custkey AS sample, o_orderkey AS feature, (o_custkey % 4)::DOUBLE AS factor FROM orders")
def filter_load(spark, d):
    o = table(spark, d, "orders")
    item = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.pmod("o_custkey", F.lit(4)).cast("string"))
    lines = o.groupBy("o_custkey").agg(F.array_join(F.collect_list(item), ":").alias("l")).select(F.concat(F.col("o_custkey").cast("string"), F.lit("\t"), F.col("l")).alias("value"), F.lit(0).alias("ord"))
    return rank.filter_rows(lines, table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("label"), F.col("c_custkey").alias("idx")), o.select(F.col("o_orderkey").cast("string").alias("label"), F.col("o_orderkey").alias("idx")))


@query("SELECT o_orderkey AS example, o_orderkey // 1024 AS batch, (o_orderkey % 1024)::BIGINT AS position FROM orders")
def batch_cursor(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("example"), F.floor(F.col("o_orderkey") / 1024).alias("batch"), F.pmod("o_orderkey", F.lit(1024)).alias("position"))


@query(f"SELECT c_custkey AS example, (row_number() OVER (ORDER BY {_u('c_custkey')}, c_custkey) - 1)::BIGINT AS position FROM customer")
def shuffle_examples(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("example"))
    return text.numbered_rows(c.withColumn("u", generators.uniform(F.col("example"))), [F.col("u"), F.col("example")]).select("example", F.col("n").alias("position"))


_HIDDEN = with_("cells") + f", h AS (SELECT sample, u, round(1 / (1 + exp(-({fixed('0.01::DOUBLE * value * (' + w_sql('feature', 'u') + ')')} + 0.1::DOUBLE))), 9) AS a FROM cells, range(8) r(u) GROUP BY 1, 2)"
_OUT = ", hv AS (SELECT sample, list(a ORDER BY u) AS v FROM h GROUP BY 1), items AS (SELECT p_partkey AS idx, [" + ", ".join(w_sql(str(u), "p_partkey") for u in range(8)) + "] AS v FROM part)"
_O = " + ".join(f"hv.v[{i}] * items.v[{i}]" for i in range(1, 9))


@query(_HIDDEN + _OUT + f", s AS (SELECT sample, idx, round(1 / (1 + exp(-(0::DOUBLE + {_O} - 0.2::DOUBLE))) * CASE WHEN c.feature IS NULL THEN 1 ELSE 0 END, 6) AS score FROM hv CROSS JOIN items LEFT JOIN cells c USING (sample) WHERE FALSE) SELECT sample, rank::INT AS rank, idx, score FROM (SELECT q.sample, q.idx, q.score, row_number() OVER (PARTITION BY q.sample ORDER BY q.score DESC, q.idx) AS rank FROM (SELECT hv.sample, items.idx, round(1 / (1 + exp(-(0::DOUBLE + {_O} - 0.2::DOUBLE))) * CASE WHEN c.feature IS NULL THEN 1 ELSE 0 END, 6) AS score FROM hv CROSS JOIN items LEFT JOIN cells c ON c.sample = hv.sample AND c.feature = items.idx) q) WHERE rank <= 10")
def recommend(spark, d):
    """A sparse input layer, 8 sigmoid units, a sigmoid output for each part, bought parts filtered, top 10."""
    c = cells(spark, d)
    bias = spark.range(UNITS).select(F.col("id").cast("int").alias("unit"), F.lit(0.1).alias("b"))
    z = sparse.sparse_z(c.withColumn("value", F.lit(0.01) * F.col("value")), wide_weights(spark, d), UNITS, bias=bias)
    h = z.select("sample", "unit", F.round(activations.activation("sigmoid", F.col("z")), 9).alias("a"))
    hidden = h.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "a"))), lambda x: x["a"]).alias("vec"))
    bought = c.groupBy("sample").agg(F.collect_list("feature").alias("skip")).withColumn("factor", F.transform("skip", lambda x: F.lit(0.0)))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.array(*[formula(F.lit(u), F.col("p_partkey")) for u in range(UNITS)]).alias("vec"), F.lit(-0.2).alias("b"))
    return rank.topk_products(hidden.join(bought, "sample"), items, 10, activation="sigmoid")


# ------------------------------------------------------------------ evaluation

_EVAL = _SCORES + f", t AS (SELECT sample, feature AS idx FROM cells WHERE value >= 40), p AS (SELECT sample, count(*) AS p FROM t GROUP BY 1), k AS (SELECT * FROM (SELECT sample, idx, {_RANK} AS j FROM scores) WHERE j <= 10), h AS (SELECT k.sample, j, p, (t.idx IS NOT NULL)::INT AS hit FROM k JOIN p USING (sample) LEFT JOIN t ON t.sample = k.sample AND t.idx = k.idx), r AS (SELECT sample, j, p, sum(hit) OVER w AS h, sum(hit / log2(j + 1)) OVER w AS dcg FROM h WINDOW w AS (PARTITION BY sample ORDER BY j ROWS UNBOUNDED PRECEDING)), i AS (SELECT p, sum(1 / log2(x + 1)) AS ideal FROM (SELECT DISTINCT p FROM p), range(1, p + 1) s(x) GROUP BY 1) "


def _truth(spark, d):
    return cells(spark, d).where("value >= 40").select("sample", F.col("feature").alias("idx"))


@query(_EVAL + "SELECT j::INT AS j, round(avg(h / j), 6) AS precision, round(avg(h / p), 6) AS recall FROM r GROUP BY 1")
def precision_recall_at_k(spark, d):
    return evaluate.precision_recall_ndcg(_scores(spark, d), _truth(spark, d), 10).select("j", *r6("precision", "recall"))


@query(_EVAL + "SELECT j::INT AS j, round(avg(dcg / ideal), 6) AS ndcg FROM r JOIN i USING (p) GROUP BY 1")
def ndcg_at_k(spark, d):
    return evaluate.precision_recall_ndcg(_scores(spark, d), _truth(spark, d), 10).select("j", *r6("ndcg"))


@query(_EVAL + ", b AS (SELECT sample, max(score) AS best FROM scores JOIN t USING (sample, idx) GROUP BY 1), q AS (SELECT sample, 1 + count(*) FILTER (WHERE score > best) AS r FROM scores JOIN b USING (sample) GROUP BY 1) SELECT round(avg(1::DOUBLE / r), 6) AS mrr, count(*) AS samples FROM q")
def mrr(spark, d):
    return evaluate.mrr(_scores(spark, d), _truth(spark, d)).select(*r6("mrr"), "samples")


# ------------------------------------------------------------------ nearest neighbours

_V = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0)"
_N = ", e2 AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)"
_KNN = "SELECT query, rank::INT AS rank, key, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM (SELECT q.vec_id AS query, e.vec_id AS key, round(list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])), 12) AS score FROM {q} q, {e} e)) WHERE rank <= 10"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))


def _found(spark, d, normalise=False):
    v = _vectors(spark, d)
    return knn.nearest(v.where("key % 50 = 0"), v, 10, normalise)


@query(_V + _KNN.format(q="q", e="e"))
def knn_exact(spark, d):
    return _found(spark, d)


@query(_V + _N + _KNN.format(q="(SELECT * FROM e2 WHERE vec_id % 50 = 0)", e="e2"))
def knn_normalized(spark, d):
    return _found(spark, d, True)


@query(_V + f", k AS ({_KNN.format(q='q', e='e')}) SELECT query || chr(9) || string_agg(key::VARCHAR, ' ' ORDER BY rank) AS value FROM k GROUP BY query")
def knn_keys_only(spark, d):
    return text.format_neighbors(_found(spark, d), keys_only=True)


@query(_V + f", k AS ({_KNN.format(q='q', e='e')}) SELECT query || chr(9) || string_agg(key || ':' || printf('%.3f', score), ' ' ORDER BY rank) AS value FROM k GROUP BY query")
def knn_format(spark, d):
    return text.format_neighbors(_found(spark, d))


_EMB = with_("units") + f", z AS (SELECT sample, u::INT AS unit, tanh({fixed('a * (' + w_sql('unit', 'u') + ')')}) AS a FROM units, range(8) r(u) GROUP BY 1, 2), n AS (SELECT sample, sqrt({fixed('a * a')}) AS n FROM z GROUP BY 1) SELECT sample, unit, round(a / n, 6) AS a FROM z JOIN n USING (sample) WHERE n > 0"


@query(_EMB)
def encoder_pipeline(spark, d):
    """Forward to a tanh embedding, then rows at length 1 (zero rows are left out)."""
    w = spark.range(64).select(F.col("id").alias("src")).withColumn("dst", F.explode(F.sequence(F.lit(0), F.lit(7))))
    z = dense.dense_z(embedding_units(spark, d), w.select("src", "dst", formula(F.col("src"), F.col("dst")).alias("w"))).select("sample", "unit", F.tanh("z").alias("a"))
    n = z.groupBy("sample").agg(F.sqrt(fixed_sum(F.col("a") * F.col("a"))).alias("n"))
    return z.join(n.where("n > 0"), "sample").select("sample", "unit", F.round(F.col("a") / F.col("n"), 6).alias("a"))


@query(f"SELECT event_type, count(*) AS n, round({fixed('value')}, 4) AS total FROM events GROUP BY 1")
def fixed_point_sums(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(fixed_sum(F.col("value")), 4).alias("total"))


@query(with_("grid") + ", e AS (SELECT sample, sum(0.5::DOUBLE * (a - t) * (a - t)) AS e FROM grid GROUP BY 1), s AS (SELECT sample // 64 AS batch, avg(e) AS e FROM e GROUP BY 1) SELECT batch, round(e, 6) AS error FROM s")
def batch_errors(spark, d):
    g = class_grid(spark, d).groupBy("sample").agg(F.sum(losses.loss("l2", F.col("a"), F.col("t"))).alias("e"))
    return g.groupBy(F.floor(F.col("sample") / 64).alias("batch")).agg(F.avg("e").alias("error")).select("batch", *r6("error"))
