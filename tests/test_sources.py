import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import rank, sparse
from cellweave.sources import dataset, text


def lines(spark, *values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, ord int")


def test_index_valid(spark):
    got = {r["label"]: r["idx"] for r in text.parse_index(lines(spark, "110510\t26743", "121019\t26740", "121017\t26739")).collect()}
    assert got == {"110510": 26743, "121019": 26740, "121017": 26739}


@pytest.mark.parametrize("bad", [["110510\t26743", "110510\t26743"], ["110510\t26743", "110510\t123"], ["\t123"], ["123"], ["110510\t123\t121017"]])
def test_index_errors(spark, bad):
    with pytest.raises(text.LabelIndexError, match="Error"):
        text.parse_index(lines(spark, *bad))


def test_index_files_round_trip(spark, tmp_path):
    index = spark.createDataFrame([("a", 0), ("b", 7)], "label string, idx bigint")
    text.export_index(index, str(tmp_path / "i"))
    assert sorted(map(tuple, text.load_index(spark, str(tmp_path / "i")).collect())) == [("a", 0), ("b", 7)]


def test_parse_samples_rules(spark):
    got = text.parse_samples(lines(spark, "s1\tf1,1.5:f2:f3,2,9::", "no tab", "", "s2\tf1,4", "s2\tf2,5"))
    rows = sorted((r["sample"], r["feature"], r["value"]) for r in got.collect())
    assert rows == [("s1", "f1", 1.5), ("s1", "f2", 0.0), ("s1", "f3", 2.0), ("s2", "f2", 5.0)]


def test_parse_samples_bad_number(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.parse_samples(lines(spark, "s\tf,x1")).collect()


def test_build_index_first_seen_and_merge(spark):
    seen = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3)], "label string, at int")
    first = text.build_index(seen, "at")
    assert {r["label"]: r["idx"] for r in first.collect()} == {"b": 0, "a": 1, "c": 2}
    more = text.build_index(spark.createDataFrame([("d", 0), ("a", 1)], "label string, at int"), "at", first)
    assert {r["label"]: r["idx"] for r in more.collect()} == {"b": 0, "a": 1, "c": 2, "d": 3}


def test_vectors(spark):
    ok = text.parse_vectors(lines(spark, "a:1,2", "b:3,4.5"), ":", ",")
    assert {r["key"]: list(r["vec"]) for r in ok.collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.5]}
    with pytest.raises(ValueError, match="lengths"):
        text.parse_vectors(lines(spark, "a:1,2", "b:3"), ":", ",")
    with pytest.raises(Exception, match="malformed"):
        text.parse_vectors(lines(spark, "a:1:2"), ":", ",").collect()


def test_recs_format(spark):
    recs = spark.createDataFrame([(1, 1, "x", 0.5), (1, 2, "y", 0.25)], "sample int, rank int, label string, score double")
    assert text.format_recs(recs).first()["value"] == "1\tx,0.500:y,0.250:"


def test_dataset_round_trip_and_errors(spark, tmp_path):
    cells = dataset.from_csr(spark, [0, 3, 6], [3, 6, 9], [0, 1, 2, 3, 1, 4, 5, 6, 7])
    ds = dataset.sparse(spark, "input", cells, 8, boolean=True)
    assert ds.of.width == 128 and ds.of.examples == 3
    dataset.save(ds, str(tmp_path / "d"))
    back = dataset.load(spark, str(tmp_path / "d"))
    assert back.of == ds.of and back.cells.count() == 9
    assert [r["feature"] for r in dataset.point(back, 1).orderBy("i").collect()] == [1, 3, 4]
    with pytest.raises(ValueError):
        dataset.from_csr(spark, [1], [2], [0, 1])
    with pytest.raises(IndexError):
        dataset.from_csr(spark, [0], [5], [0, 1])
    with pytest.raises(IndexError):
        dataset.Dataset(dataset.Descriptor("x", dataset.SPARSE, 2, examples=3), cells).check()
    with pytest.raises(ValueError, match="fill"):
        dataset.Dataset(dataset.Descriptor("x", 0, 8, examples=3), cells).check()
    with pytest.raises(RuntimeError):
        dataset.Dataset(dataset.Descriptor("x", dataset.SPARSE | dataset.INDEXED, 8, examples=3), cells).check()
    with pytest.raises(ValueError, match="type"):
        dataset.Dataset(dataset.Descriptor("x", dataset.SPARSE, 8, examples=3, data_type=2), cells).check()


def test_row_ranges(spark):
    cells = dataset.from_csr(spark, [0, 1, 2], [1, 2, 4], [0, 1, 2, 3], [123, 234, 345, 456])
    assert sorted(map(tuple, sparse.row_ranges(cells).collect())) == [(0, 0, 1), (1, 1, 2), (2, 2, 4)]


def test_filters_multiply_and_replace(spark):
    labels = spark.createDataFrame([("a", 0), ("b", 1)], "label string, idx bigint")
    f = rank.filter_rows(lines(spark, "a\tb,0.5", "a\tb:zz,3"), labels, labels)
    scores = spark.createDataFrame([(0, 1, 8.0), (0, 0, 2.0)], "sample bigint, idx bigint, score double")
    got = {r["idx"]: r["score"] for r in rank.apply_filter(scores, f).collect()}
    assert got == {1: 0.0, 0: 2.0}


@pytest.mark.parametrize("k,width", [(128, 1024), (64, 1024), (32, 64), (1, 64)])
def test_topk_ties(spark, k, width):
    grid = spark.range(4).select(F.col("id").alias("sample")).withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    grid = grid.withColumn("score", F.pmod(F.col("idx") * 37 + F.col("sample"), F.lit(17)).cast("double"))
    got = {}
    for r in rank.topk(grid, k).collect():
        got.setdefault(r["sample"], {})[r["rank"]] = r["idx"]
    for s in range(4):
        want = sorted(range(width), key=lambda i: (-((i * 37 + s) % 17), i))[:k]
        assert [got[s][j + 1] for j in range(min(k, width))] == want


def test_blocked_products_agree(spark):
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "sample bigint, vec array<double>")
    items = spark.createDataFrame([(j, [float(j % 5), float(j)]) for j in range(40)], "idx bigint, vec array<double>")
    one = sorted(map(tuple, rank.topk_products(q, items, 7).collect()))
    many = sorted(map(tuple, rank.topk_products(q, items, 7, most_items=9).collect()))
    assert one == many and len(one) == 42


@pytest.mark.parametrize("most_items", [200_000, 30, 5])
def test_equal_items_are_multiplied_once(spark, most_items):
    """Items of a few kinds: a product for each kind, the rows of all products; filters may take whole kinds."""
    rng = random.Random(7)
    kinds = [([rng.choice([-1.0, 0.5, 2.0]), float(i)], float(i % 2)) for i in range(7)] + [([9.0, 9.0], 0.0)]
    items = [(j, *kinds[rng.randrange(7)]) for j in range(300)] + [(300, *kinds[7]), (301, *kinds[7])]
    queries = []
    for i in range(40):
        skip = sorted({*rng.sample(range(302), rng.choice([0, 3, 60, 290])), *([300, 301] if i % 3 else [])})
        queries.append((i, [rng.uniform(-1, 1), rng.uniform(-1, 1)], skip, [rng.choice([0.0, 0.5, 1.5]) for _ in skip]))
    q = spark.createDataFrame(queries, "sample bigint, vec array<double>, skip array<bigint>, factor array<double>")
    table = spark.createDataFrame(items, "idx bigint, vec array<double>, b double")
    got = sorted(map(tuple, rank.topk_products(q, table, 11, "sigmoid", most_items=most_items).collect()))
    want = []
    for i, v, skip, factor in queries:
        f = dict(zip(skip, factor, strict=True))
        best = sorted((-round(f.get(j, 1.0) / (1 + math.exp(-(v[0] * w[0] + v[1] * w[1] + b))), 6), j) for j, w, b in items)[:11]
        want += [(i, at + 1, j, -s) for at, (s, j) in enumerate(best)]
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert max(abs(x[3] - y[3]) for x, y in zip(got, want, strict=True)) < 2e-6
    if most_items > 8:
        assert {len(b.mat) for b in rank._blocks(table, most_items)} <= {7, 8}


def test_scores_are_written_by_their_binary_value(spark):
    """As printf does: 0.4165 and 0.3735 lie below the half, sixteenths are true halves."""
    rng = random.Random(4)
    scores = [0.4165, 0.3735, 0.0005, 0.0015, 0.0625, 0.1875, 1.0625, 2.0005, 0.9995, 0.99951, 0.0, -0.0, -0.0004, -0.4165, 1.0, 123456.7895, 3e12, 0.5]
    scores += [round(rng.uniform(-1, 1), 4) for _ in range(2000)] + [rng.uniform(-2000, 2000) for _ in range(500)] + [rng.randrange(-99999, 99999) / 16 for _ in range(500)]
    found = spark.createDataFrame([(i, 1, i, s) for i, s in enumerate(scores)], "query bigint, rank int, key bigint, score double")
    got = {r["value"] for r in text.format_neighbors(found).collect()}
    assert got == {f"{i}\t{i}:{s:.3f}" for i, s in enumerate(scores)}
    got = {r["value"] for r in text.format_recs(found, "query", "key").collect()}
    assert got == {f"{i}\t{i},{s:.3f}:" for i, s in enumerate(scores)}


def test_a_cluster_needs_a_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from cellweave.functions.tables import shared_folder

    def session(where, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: where), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("/shared/", "spark://host:7077")) == "/shared"
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(session(None, "spark://host:7077"))
