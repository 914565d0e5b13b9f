"""Flush windows and incremental ingest over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of event files; ts becomes a timestamp that watermarks accept."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def flush_counts(stream: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events and sums per type and tumbling window; rows later than the watermark are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_seen(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once, the state of it kept as long as copies may come."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_end(out: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Runs a stream over all there is and writes every batch's rows under its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What the last batch that updated each key says."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    one = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return one.select(*keys, "v.*")
