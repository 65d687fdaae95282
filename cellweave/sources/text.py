"""Delimited text in and out: label indexes, samples, vectors, recommendations, neighbours."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.tables import kept


class LabelIndexError(ValueError):
    """A label index that can't be loaded."""


def parse_index(lines: DataFrame) -> DataFrame:
    """(label, idx) from lines(value) of `label \\t idx`. Wrong lines and repeated labels raise."""
    parts = F.split("value", "\t", -1)
    rows = lines.select("value", F.size(parts).alias("n"), F.get(parts, F.lit(0)).alias("label"), F.get(parts, F.lit(1)).alias("number"))
    bad = rows.where((F.col("n") != 2) | (F.col("label") == "")).select("value").limit(1).collect()
    if bad:
        raise LabelIndexError(f"Error: malformed index line: {bad[0]['value']!r}")
    out = rows.select("label", F.coalesce(F.regexp_extract("number", r"^\s*([+-]?[0-9]+)", 1), F.lit("0")).alias("number")).select("label", F.when(F.col("number") == "", F.lit(0)).otherwise(F.col("number").cast("bigint")).alias("idx"))
    again = out.groupBy("label").count().where("count > 1").limit(1).collect()
    if again:
        raise LabelIndexError(f"Error: repeated label {again[0]['label']!r}")
    return out


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_index(spark.read.text(path))


def export_index(index: DataFrame, path: str) -> None:
    index.select(F.concat_ws("\t", "label", F.col("idx").cast("string")).alias("value")).write.text(path)


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ord): lines of a file, or of the files of a folder in order of their names."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select("value", F.struct("file", "block", "row").alias("ord"))


def parse_samples(lines: DataFrame, order: str | None = "ord", appearance: bool = False) -> DataFrame:
    """(sample, pos, feature, value) from lines of `sample \\t feature[,value]:feature[,value]...`.

    Empty lines, lines without a tab and empty elements are skipped; a missing value is 0; of more
    than two parts the first value counts; with `order`, a sample's last line replaces earlier ones
    (a partial aggregate, not a window over a sample's lines). A value that isn't a number raises.
    appearance: also `first`, the order of the sample's first line, and `at`, that of the element."""
    parts = F.split("value", "\t", -1)
    rows = lines.where(F.size(parts) >= 2)
    if order:
        rows = rows.groupBy(F.get(parts, F.lit(0)).alias("sample")).agg(F.max_by(F.get(parts, F.lit(1)), F.col(order)).alias("list"), F.min(order).alias("first"), F.max(order).alias("last"))
    else:
        rows = rows.select(F.get(parts, F.lit(0)).alias("sample"), F.get(parts, F.lit(1)).alias("list"))
    more = ["first", "last"] if appearance else []
    each = rows.select("sample", *more, F.posexplode(F.filter(F.split("list", ":", -1), lambda x: x != "")).alias("pos", "element"))
    bits = F.split("element", ",", -1)
    value = F.when(F.size(bits) > 1, F.get(bits, F.lit(1)).cast("double")).otherwise(0.0)
    return each.select("sample", "pos", F.get(bits, F.lit(0)).alias("feature"), value.alias("value"), *(["first", F.struct("last", "pos").alias("at")] if appearance else []))


def build_index(labels: DataFrame, first_seen: str, old: DataFrame | None = None) -> DataFrame:
    """(label, idx) of old's labels and then new ones, numbered on in order of first_seen.

    Numbers come from a range sort and per-partition offsets, so no task sorts all labels."""
    new = labels.groupBy("label").agg(F.min(first_seen).alias("seen"))
    base = 0
    if old is not None:
        new = new.join(old.select("label"), "label", "left_anti")
        last = old.agg(F.max("idx")).first()[0]
        base = 0 if last is None else last + 1
    numbered = numbered_rows(new, [F.col("seen"), F.col("label")]).select("label", (F.col("n") + base).alias("idx"))
    return numbered if old is None else old.select("label", "idx").unionByName(numbered)


def numbered_rows(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with n = 0, 1, ... in the given order, without a single-task window: a range sort, row
    numbers in each partition, and the partitions' offsets (a row per partition). The numbered rows are
    written once: another range sort could draw other bounds."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = kept(placed.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn("n", F.col("__before") + F.col("__at")).drop("__id", "__part", "__at", "__before")


def index_cells(parsed: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """(sample, feature, value) with ids for labels; unknown labels drop out."""
    s = samples.select(F.col("label").alias("sample"), F.col("idx").alias("__s"))
    f = features.select(F.col("label").alias("feature"), F.col("idx").alias("__f"))
    return parsed.join(s, "sample").join(f, "feature").select(F.col("__s").alias("sample"), F.col("__f").alias("feature"), "value")


def parse_vectors(lines: DataFrame, key_sep: str = "\t", sep: str = " ") -> DataFrame:
    """(key, vec) from lines of `key \\t v v v`. More than one key separator, no element, a value that
    isn't a number or unequal lengths raise."""
    halves = F.split("value", _quoted(key_sep), -1)
    rows = lines.where(F.trim("value") != "")
    ok = (F.size(halves) == 2) & (F.trim(F.get(halves, F.lit(1))) != "")
    wrong = F.raise_error(F.concat(F.lit("malformed vector line: "), F.col("value")))
    vec = F.transform(F.split(F.trim(F.get(halves, F.lit(1))), _quoted(sep), -1), lambda x: x.cast("float"))
    out = rows.select(F.when(ok, F.get(halves, F.lit(0))).otherwise(wrong).alias("key"), vec.alias("vec"))
    sizes = out.agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"vectors of lengths {sizes['a']} to {sizes['b']}")
    return out


def _quoted(sep: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in sep)


def ratings_to_lines(ratings: DataFrame) -> DataFrame:
    """(value): `user \\t item,rating:item,rating...` from ratings(userId, movieId, rating), items in order."""
    pair = F.struct(F.col("movieId").alias("i"), F.concat_ws(",", F.col("movieId").cast("string"), F.col("rating").cast("string")).alias("s"))
    lists = ratings.groupBy("userId").agg(F.array_sort(F.collect_list(pair)).alias("l"))
    return lists.select(F.concat(F.col("userId").cast("string"), F.lit("\t"), F.array_join(F.transform("l", lambda x: x["s"]), ":")).alias("value"))


def three_decimals(x: Column) -> Column:
    """x as C's `%.3f` writes it: by the binary value, a true half to even. Java rounds a double's shortest
    decimal form, half up, so 0.4165 (a little less in binary) would be 0.417. From 4e12 on Java's form stays."""
    v = F.abs(x)
    p, c = v * F.lit(1000.0), v * F.lit(134217729.0)
    high = c - (c - v)  # the upper 26 bits: both parts times 1000 are exact
    error = (high * F.lit(1000.0) - p) + (v - high) * F.lit(1000.0)  # v * 1000 = p + error
    n = F.floor(p)
    half = p - n.cast("double") - F.lit(0.5)
    m = n + F.when((half > 0) | (half == 0) & ((error > 0) | (error == 0) & (F.pmod(n, F.lit(2)) == 1)), 1).otherwise(0)
    digits = F.concat(F.floor(m / F.lit(1000)).cast("string"), F.lit("."), F.lpad(F.pmod(m, F.lit(1000)).cast("string"), 3, "0"))
    return F.when(v < F.lit(4e12), F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), digits)).otherwise(F.format_string("%.3f", x))


def format_recs(recs: DataFrame, sample: str = "sample", label: str = "label", score: str = "score", rank: str = "rank") -> DataFrame:
    """(value): `sample \\t label,score:label,score:` with three decimals and a last colon."""
    item = F.concat(F.col(label).cast("string"), F.lit(","), three_decimals(F.col(score).cast("double")), F.lit(":"))
    lists = recs.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), item.alias("s")))).alias("l"))
    return lists.select(F.concat(F.col(sample).cast("string"), F.lit("\t"), F.array_join(F.transform("l", lambda x: x["s"]), "")).alias("value"))


def format_neighbors(found: DataFrame, keys_only: bool = False) -> DataFrame:
    """(value): `query \\t key:score key:score` (or keys alone) from found(query, rank, key, score)."""
    item = F.col("key").cast("string") if keys_only else F.concat(F.col("key").cast("string"), F.lit(":"), three_decimals(F.col("score").cast("double")))
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("s")))).alias("l"))
    return lists.select(F.concat(F.col("query").cast("string"), F.lit("\t"), F.array_join(F.transform("l", lambda x: x["s"]), " ")).alias("value"))
