"""Collections of rows with vectors, kept as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Collection:
    """A collection under a path: segments of Parquet files; a row is known by its key."""

    def __init__(self, spark: SparkSession, path: str, key: str, vector: str | None = None):
        self.spark, self.path, self.key, self.vector = spark, path, key, vector
        self.part = 0

    def _segment(self) -> str:
        self.part += 1
        return f"{self.path}/segment={self.part}"

    def insert(self, rows: DataFrame) -> None:
        """Adds a segment. Rows without a vector are left out; a null key is made from the row's text or description."""
        if self.vector:
            rows = rows.filter(F.col(self.vector).isNotNull())
        text = [F.col(c) for c in ("text", "description") if c in rows.columns]
        made = F.md5(F.coalesce(*text, F.lit("")))
        if dict(rows.dtypes)[self.key] == "string":
            rows = rows.withColumn(self.key, F.coalesce(self.key, made))
        rows.write.mode("errorifexists").parquet(self._segment())

    def rows(self) -> DataFrame:
        """All rows of all segments."""
        return self.spark.read.parquet(self.path).drop("segment")

    def delete(self, keys: DataFrame) -> "Collection":
        """The collection without the rows of the given keys, written anew beside the old one."""
        kept = self.rows().join(keys.select(self.key).distinct(), self.key, "left_anti")
        new = type(self)(self.spark, f"{self.path}_kept", self.key, self.vector)
        kept.write.mode("overwrite").parquet(new._segment())
        return new

    def compact(self, files: int) -> "Collection":
        """The collection with its rows in ``files`` files of one segment, clustered by key."""
        new = type(self)(self.spark, f"{self.path}_compact", self.key, self.vector)
        self.rows().repartitionByRange(files, self.key).write.mode("overwrite").parquet(new._segment())
        return new


#: Kinds of collections by name; register others with register().
KINDS: dict[str, type[Collection]] = {"parquet": Collection}


def register(name: str, kind: type[Collection]) -> None:
    """Makes a kind of collection known. It has to be a Collection."""
    if not (isinstance(kind, type) and issubclass(kind, Collection)):
        raise TypeError("a kind of collection has to derive from Collection")
    KINDS[name] = kind


def create(name: str, spark: SparkSession, path: str, key: str, vector: str | None = None) -> Collection:
    """A collection of a known kind."""
    if name not in KINDS:
        raise ValueError(f"unknown kind {name}; known: {sorted(KINDS)}")
    return KINDS[name](spark, path, key, vector)
