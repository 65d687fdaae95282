"""Ranking quality: precision, recall, nDCG and mean reciprocal rank."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_hits(scores: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(sample, j, hit, p): the k best of each sample's scores(sample, idx, score), whether each is one
    of targets(sample, idx), and the sample's number of targets."""
    from cellweave.operators.rank import topk

    p = targets.groupBy("sample").agg(F.count("*").alias("p"))
    best = topk(scores, k).select("sample", F.col("rank").alias("j"), "idx")
    hit = targets.select("sample", "idx", F.lit(1).alias("hit"))
    return best.join(p, "sample").join(hit, ["sample", "idx"], "left").select("sample", "j", F.coalesce("hit", F.lit(0)).alias("hit"), "p")


def precision_recall_ndcg(scores: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(j, precision, recall, ndcg) averaged over samples with targets, j = 1..k. The ideal gain sums
    over all of a sample's targets, not only over the first k."""
    w = Window.partitionBy("sample").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("hit") * F.lit(1.0) / F.log2(F.col("j") + F.lit(1.0))
    hits = ranked_hits(scores, targets, k)
    run = hits.select("sample", "j", "p", F.sum("hit").over(w).alias("h"), F.sum(gain).over(w).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("p").cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    run = run.withColumn("ideal", ideal)
    return run.groupBy("j").agg(F.avg(F.col("h") / F.col("j")).alias("precision"), F.avg(F.col("h") / F.col("p")).alias("recall"), F.avg(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def mrr(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: mean of 1 / (1 + number of scores over the best target's), over samples with targets."""
    best = scores.join(targets.select("sample", "idx"), ["sample", "idx"]).groupBy("sample").agg(F.max("score").alias("best"))
    rank = scores.join(best, "sample").groupBy("sample").agg((1 + F.count_if(F.col("score") > F.col("best"))).alias("r"))
    return rank.agg(F.avg(F.lit(1.0) / F.col("r")).alias("mrr"), F.count("*").alias("samples"))
