"""Named datasets: cells and a descriptor, kept as Parquet with the descriptor beside them."""
from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the attributes.
SPARSE, BOOLEAN, COMPRESSED, RECURRENT, MUTABLE, IGNORE_ZERO, INDEXED, WEIGHTED = 1, 2, 4, 8, 16, 32, 64, 128
#: Data types by their number, with the column type that holds them (None: not loadable).
DATA_TYPES = {0: "bigint", 1: "bigint", 2: None, 3: None, 4: "float", 5: "double", 6: "smallint", 7: None, 8: "smallint", 9: "tinyint"}
KINDS = ("Numeric", "Image", "Audio")


@dataclass(frozen=True)
class Descriptor:
    name: str
    attributes: int
    width: int
    height: int = 1
    length: int = 1
    examples: int = 0
    data_type: int = 4
    kind: str = "Numeric"

    @property
    def dims(self) -> int:
        return 1 + (self.height > 1) + (self.length > 1)

    def is_sparse(self) -> bool:
        return bool(self.attributes & SPARSE)


@dataclass
class Dataset:
    """cells(sample, feature, value); optional index(sample, unique_id) and weights(sample, weight)."""

    of: Descriptor
    cells: DataFrame
    index: DataFrame | None = None
    weights: DataFrame | None = None

    def check(self) -> Dataset:
        """Raise on what a loader refuses: no examples, an unloadable type, cells outside the shape, an
        index or weights that the attributes don't name."""
        d = self.of
        if DATA_TYPES.get(d.data_type) is None:
            raise ValueError(f"data type {d.data_type} can't be loaded")
        if d.examples < 1:
            raise ValueError("no examples")
        if (self.index is not None) != bool(d.attributes & INDEXED):
            raise RuntimeError("index and attributes don't agree")
        if (self.weights is not None) != bool(d.attributes & WEIGHTED):
            raise RuntimeError("weights and attributes don't agree")
        size = d.width * d.height * d.length
        row = self.cells.agg(F.count("*").alias("n"), F.min("feature").alias("lo"), F.max("feature").alias("hi")).first()
        if d.is_sparse() and not row["n"]:
            raise ValueError("no sparse data")
        if row["n"] and (row["lo"] < 0 or row["hi"] >= size):
            raise IndexError(f"feature outside of 0..{size - 1}")
        if not d.is_sparse() and row["n"] != size * self.cells.select("sample").distinct().count():
            raise ValueError("dense data must fill every cell")
        return self

    def expanded(self) -> DataFrame:
        """cells by example: through the index where there is one."""
        if self.index is None:
            return self.cells
        return self.index.join(self.cells.withColumnRenamed("sample", "unique_id"), "unique_id").select("sample", "feature", "value")


def sparse(spark: SparkSession, name: str, cells: DataFrame, width: int, boolean: bool = False) -> Dataset:
    n = cells.select("sample").distinct().count()
    cells = cells.withColumn("value", F.lit(1.0)) if boolean else cells
    return Dataset(Descriptor(name, SPARSE | (BOOLEAN if boolean else 0), -(-width // 128) * 128, examples=n), cells)


def save(dataset: Dataset, path: str) -> None:
    spark = dataset.cells.sparkSession
    dataset.cells.write.parquet(f"{path}/cells")
    spark.createDataFrame([asdict(dataset.of)]).coalesce(1).write.json(f"{path}/descriptor")
    for name, part in (("index", dataset.index), ("weights", dataset.weights)):
        if part is not None:
            part.write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Dataset:
    of = Descriptor(**spark.read.json(f"{path}/descriptor").first().asDict())
    part = lambda name, bit: spark.read.parquet(f"{path}/{name}") if of.attributes & bit else None
    return Dataset(of, spark.read.parquet(f"{path}/cells"), part("index", INDEXED), part("weights", WEIGHTED)).check()


def from_csr(spark: SparkSession, start: list[int], end: list[int], index: list[int], data: list[float] | None = None) -> DataFrame:
    """cells of in-memory CSR arrays; ranges must begin at 0 and lie in the arrays."""
    if not start or start[0] != 0:
        raise ValueError("start must begin at 0")
    if len(start) != len(end) or max(end) > len(index) or any(a > b for a, b in zip(start, end, strict=True)):
        raise IndexError("range outside of the data")
    rows = [(s, index[i], float(data[i]) if data else 1.0) for s, (a, b) in enumerate(zip(start, end, strict=True)) for i in range(a, b)]
    return spark.createDataFrame(rows, "sample bigint, feature bigint, value double")


def point(dataset: Dataset, example: int) -> DataFrame:
    """(i, feature, value) of one example's stored cells in order of feature."""
    from cellweave.sources.text import numbered_rows

    return numbered_rows(dataset.expanded().where(F.col("sample") == example).select("feature", "value"), [F.col("feature")]).select(F.col("n").alias("i"), "feature", "value")
