"""Life of a collection: tiers by age, segments, flushes, compaction and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tier(age_days: Column) -> Column:
    """hot up to 7 days, warm up to 30, cold beyond; null for an unknown age."""
    return F.when(age_days <= 7, "hot").when(age_days <= 30, "warm").when(age_days.isNotNull(), "cold")


def expired(age_days: Column, ttl_days: Column) -> Column:
    """Whether a row is past its time to live; 0 keeps it for good."""
    return F.when(ttl_days == 0, False).otherwise(age_days > ttl_days)


def memory_bytes(dim: Column, n: Column) -> Column:
    """Memory of an index in bytes: four per dimension and vector, half as much again for structure."""
    return dim.cast("double") * n * 4 * 1.5


def segments(rows: DataFrame, day: str, part: Column, order: Sequence[str], size: Column, most: int) -> DataFrame:
    """The rows with their segment: a segment is closed each day and whenever its size has reached ``most``.

    Sizes are summed up along the order within a day; segment is the day's number of full segments so far. part is a
    value that never falls along the order (the hour, say): its sums are added up first, then rows only within a part,
    so a day that holds most rows isn't summed up by one task.
    """
    rows = rows.withColumn("_part", part).withColumn("_size", size)
    sums = rows.groupBy(day, "_part").agg(F.sum("_size").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(day).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_earlier", F.coalesce(earlier, F.lit(0))).drop("_sum")
    here = F.sum("_size").over(Window.partitionBy(day, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.join(sums, [day, "_part"]).withColumn("_here", F.coalesce(here, F.lit(0)))
    return out.withColumn("segment", F.floor((F.col("_earlier") + F.col("_here")) / most).cast("bigint")).drop("_part", "_size", "_earlier", "_here")


def compaction_plan(segs: DataFrame, by: Sequence[str], most: int = 15, too_many: int = 20, deleted: float = 0.1) -> DataFrame:
    """Which groups of segments to rewrite and in how many runs: the group, n_segments, deleted_share, compact, runs.

    segs has n_rows and n_deleted per segment. A group is compacted if it has more than ``too_many`` segments or a
    larger share of deleted rows than ``deleted``; a run takes at most ``most`` segments.
    """
    g = segs.groupBy(*by).agg(F.count("*").alias("n_segments"), F.round(F.sum("n_deleted") / F.sum("n_rows"), 6).alias("deleted_share"))
    g = g.withColumn("compact", (F.col("n_segments") > too_many) | (F.col("deleted_share") > deleted))
    return g.withColumn("runs", F.when(F.col("compact"), F.ceil(F.col("n_segments") / most)).otherwise(0).cast("bigint"))


def alerts(metrics: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Level of each metric (columns metric, value): ok, warning from its first limit on, critical from its second; unknown metrics are ok."""
    level = F.lit("ok")
    for name, (warn, crit) in limits.items():
        here = F.col("metric") == name
        level = F.when(here & (F.col("value") >= crit), "critical").when(here & (F.col("value") >= warn), "warning").otherwise(level)
    return metrics.withColumn("level", level)


def file_counts(rows: DataFrame, by: str) -> DataFrame:
    """Rows, files and mean file size of each value of a partition column, as a read of Parquet files knows them: by, n_rows, n_files, mean_bytes."""
    one = rows.groupBy(by, F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("bytes"))
    return one.groupBy(by).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_files"), F.avg("bytes").alias("mean_bytes"))


def compact(rows: DataFrame, by: str, path: str, most_rows: int = 5_000_000) -> None:
    """Writes the rows anew under a path in as few files per value of ``by`` as ``most_rows`` allows.

    Values are dealt to tasks by hash and, where one holds more than ``most_rows``, over as many parts as it needs, so
    that a day with a third of all rows is no single task.
    """
    n = rows.groupBy(by).agg(F.ceil(F.count("*") / most_rows).alias("_parts"))
    dealt = rows.join(n, by).withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts")))
    dealt.repartition(by, "_part").drop("_parts", "_part").write.partitionBy(by).option("maxRecordsPerFile", 2 * most_rows).parquet(path)
