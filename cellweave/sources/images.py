"""Fixed-length binary images with a label byte, as a dense and a sparse dataset."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str, size: int = 3072) -> DataFrame:
    """(sample, label, pixels): records of one label byte and `size` pixel bytes, files in order of name."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.withColumn("record", F.explode(F.sequence(F.lit(0), (F.octet_length("content") / (size + 1)).cast("int") - 1)))
    at = F.col("record") * (size + 1)
    parts = rows.select("path", "record", F.conv(F.hex(F.substring("content", at + 1, F.lit(1))), 16, 10).cast("int").alias("label"), F.substring("content", at + 2, F.lit(size)).alias("pixels"))
    from cellweave.sources.text import numbered_rows

    return numbered_rows(parts, [F.col("path"), F.col("record")]).select(F.col("n").alias("sample"), "label", "pixels")


def pixel_cells(images: DataFrame, size: int = 3072) -> DataFrame:
    """(sample, feature, value): a cell for each pixel, from 0 to 255."""
    each = images.select("sample", "pixels", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("feature"))
    return each.select("sample", "feature", F.conv(F.hex(F.substring("pixels", F.col("feature") + 1, F.lit(1))), 16, 10).cast("double").alias("value"))


def label_cells(images: DataFrame) -> DataFrame:
    return images.select("sample", F.col("label").alias("feature"), F.lit(1.0).alias("value"))
