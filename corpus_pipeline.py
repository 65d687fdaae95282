"""The corpus pipeline: language ID, near-dedup, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of
documents; the last returns packed pieces. In every stage further columns are left out whatever their
names, null columns other than the text have no effect, and an empty table gives an empty one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.shared import discard, materialise, pick, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose best language is about as likely as chance.

    Without any labelled row there is no model: every document with a letter stays. A null or empty text
    has no letter; repeated rows are judged alike; of equally likely languages the first in order counts."""
    from cellweave.llm.langid import predict, train

    docs = pick(docs, *COLUMNS)
    model = train(docs.select("text", "lang"))
    judged = predict(docs, model, keep=COLUMNS)
    if model is None:  # the score of `und` is 1 for texts without a letter, 0 for the others
        return judged.where("score = 0").select(*COLUMNS)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.3)).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one with the smallest id (null ids last, then the first row).

    Rows are told apart by a key of their own, written once, so null and repeated ids lose nothing.
    Groups are joined by pairs of texts that share five-word shingles with an exact Jaccard similarity of
    0.8 or more. Candidates meet in a partition of one fingerprint and differ in 80 of 384 bits at most."""
    from cellweave.llm.simhash import similar_groups

    rows = materialise(pick(docs, *COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = similar_groups(rows, words=5, similar=0.8, id_col="row")
    groups = groups.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stay = groups.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(small(materialise(stay, "stay")), "row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Null and empty texts hold none and stay; repeated rows are
    judged alike; an empty benchmark drops nothing."""
    from cellweave.llm.decontam import clean

    return clean(pick(docs, *COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets in the texts; no document goes. A null text stays null, and n_chars with
    it; overlapping secrets are masked as one."""
    from cellweave.llm.secrets_link import redact

    return redact(pick(docs, *COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of at most 1024 tokens. A null text packs as an empty one, the closing id alone;
    repeated rows are packed each by itself."""
    import public_tokenizers

    from cellweave.llm.packing import pack

    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), longest=1024)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "bucket", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secret_scan),
    ("packing", packing),
]

#: The stages train models and compare fingerprints, which SQL can't express; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is deleted when the next one's is written."""
    docs, last = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), *COLUMNS), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, "stage-" + name.replace(" ", "-"))
            if last is not None:
                discard(last)
            last = docs
    return docs
