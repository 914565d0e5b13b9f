"""Problem 7: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.shared import cut


def mix_goals(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """How much of each listed source the mix should hold.

    sizes: source, size (of all sources of the corpus). targets: source, target_share, max_repeats. Result: source,
    target_share, max_repeats, corpus_size, goal (double), rate (expected copies of each of the source's records).

    The mix is as large as the whole corpus. A source gives its target share of that, but no more than its size
    times max_repeats; what capped or absent sources can't give is spread over the others in proportion to their
    target shares, so the shares come as near to the targets as the caps allow. If all are capped the mix is smaller.
    Repeated rows of a source add their shares and take the smaller cap; a source, share or cap that is null or
    negative draws nothing. The window runs over the listed targets only, whose number doesn't grow with the data.
    """
    listed = (
        targets.filter("source is not null")
        .groupBy("source")
        .agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    )
    whole = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("double").alias("whole"))
    t = listed.join(sizes.filter("source is not null"), "source", "left").withColumn("corpus_size", F.coalesce("size", F.lit(0)).cast("bigint")).drop("size")
    t = t.withColumn("cap", F.col("corpus_size").cast("double") * F.col("max_repeats")).join(F.broadcast(whole))
    # sources reach their caps in the order of cap / share; the level is what a share of 1 gets once those are set aside
    order = Window.partitionBy(F.lit(1)).orderBy(F.try_divide("cap", "target_share").asc_nulls_last(), "source")
    all_ = Window.partitionBy(F.lit(1))
    t = t.withColumn("set_aside", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("left", F.sum("target_share").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.try_divide(F.col("whole") - F.col("set_aside"), "left"))
    free = F.col("cap") > F.col("target_share") * F.col("level")
    t = t.withColumn("free_level", F.max(F.when(free & (F.col("target_share") > 0), F.col("level"))).over(all_))
    goal = F.when(F.col("target_share") <= 0, 0.0).otherwise(F.least("cap", F.coalesce(F.col("target_share") * F.col("free_level"), F.col("cap"))))
    t = t.withColumn("goal", goal)
    rate = F.coalesce(F.try_divide("goal", F.col("corpus_size").cast("double")), F.lit(0.0))
    return t.withColumn("rate", rate).select("source", "target_share", "max_repeats", "corpus_size", "goal", "rate")


def mix(sized: DataFrame, targets: DataFrame, doc_id: str = "doc_id", size: str = "n_tokens", seed: int = 7, salts: int = 64) -> DataFrame:
    """How often each record of the listed sources comes into the mix: doc_id, source, the size, repeats (int).

    sized: doc_id, source, size. Systematic sampling: within a source, the records' expected copies are summed up
    along an order, one random offset per source is added, and a record is given once for each whole number its part
    of the sum crosses. So a source gives its goal but for the sizes of a few records, and a record comes at most
    max_repeats times. The order goes by size class (sixteenths of an octave), then at random, so every class is
    drawn from evenly and the shares hold in size, not only in number. Records of size 0 or null never come.

    The sums are two-level: counts per source, class and salt first (their number doesn't grow with the data), then
    positions inside each such bucket; so a source that holds most records is spread over all its buckets. Same
    seed, same mix.
    """
    rows = sized.select(F.col(doc_id).alias("doc"), "source", F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    goals = cut(mix_goals(sizes, targets))
    rows = rows.join(goals.select("source", "rate", "max_repeats"), "source")
    rows = rows.withColumn("cls", F.when(F.col("size") > 0, F.floor(F.log2("size") * 16)).otherwise(-1)).withColumn("salt", F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(salts)))
    drawn = rows.filter("size > 0 and rate > 0")
    buckets = drawn.groupBy("source", "cls", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("cls", "salt").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    here = F.row_number().over(Window.partitionBy("source", "cls", "salt").orderBy(F.xxhash64("doc", F.lit(seed + 1)), "doc"))
    placed = drawn.join(buckets, ["source", "cls", "salt"]).withColumn("k", (F.col("before") + here).cast("double"))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    crossed = F.floor(F.col("rate") * F.col("k") + offset) - F.floor(F.col("rate") * (F.col("k") - 1) + offset)
    repeats = F.least(crossed.cast("int"), "max_repeats").cast("int")
    never = rows.filter("not (size > 0 and rate > 0)").select("doc", "source", "size", F.lit(0).cast("int").alias("repeats"))
    out = placed.select("doc", "source", "size", repeats.alias("repeats")).unionByName(never)
    return out.select(F.col("doc").alias(doc_id), "source", F.col("size").alias(size), "repeats")


def mix_shares(sized: DataFrame, targets: DataFrame, doc_id: str = "doc_id", size: str = "n_tokens", seed: int = 7) -> DataFrame:
    """What the mix holds of each listed source, those without records included.

    Columns: source, target_share, max_repeats, corpus_size, goal_share, mix_size, actual_share (null for an empty mix).
    """
    rows = sized.select(F.col(doc_id).alias("doc"), "source", F.col(size).alias("size"))
    goals = cut(mix_goals(rows.groupBy("source").agg(F.sum("size").alias("size")), targets))
    got = mix(rows, targets, "doc", "size", seed).groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("mix_size"))
    got = goals.join(got, "source", "left").withColumn("mix_size", F.coalesce("mix_size", F.lit(0)))
    listed = Window.partitionBy(F.lit(1))
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.sum(F.col(c)).over(listed).cast("double"))
    return got.select("source", "target_share", "max_repeats", "corpus_size", share("goal").alias("goal_share"), "mix_size", share("mix_size").alias("actual_share"))
