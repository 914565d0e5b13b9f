"""Problem 1: the best N items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.shared import cut
from cairn.functions.text import is_blank, strip

#: Into how many parts a heavy group is spread where it is marked as one.
SALTS = 64


def best_scores(hits: DataFrame, group: str = "query", item: str = "chunk_id", score: str = "score") -> DataFrame:
    """One row per group and item with the highest score it got.

    Rows with a null or blank group, a null item, or a score that is null or NaN do not count; outer white space
    of the group is removed. Infinite scores count as the largest and smallest. Other columns are ignored.
    """
    rows = hits.select(strip(group).alias("grp"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    rows = rows.filter(~is_blank("grp") & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    return rows.groupBy("grp", "item").agg(F.max("score").alias("score"))


def top_n(
    hits: DataFrame,
    n: int = 10,
    group: str = "query",
    item: str = "chunk_id",
    score: str = "score",
    heavy: int = 20_000,
    slice_rows: int = 10_000,
) -> DataFrame:
    """The n items with the highest scores of every group: columns group, item, score, rnk.

    Ties go to the smaller item (as a string, by code points), so every run gives the same rows; a group with fewer
    than n items gives all it has; an empty table gives none. Repeated rows and items scored several times count
    once, with the best score.

    Groups are counted exactly. A group of more than ``heavy`` items is cut into salted slices of about
    ``slice_rows`` items that are range-partitioned and sorted apart from each other; each slice keeps n and the
    slices of a group meet in a window of at most n rows each. All other groups go through one ordinary window.
    The heavy groups are marked by a join on group and salt, so no task reads a whole one; it has no hint: Spark
    broadcasts their list only if it measures it as small.
    """
    # the table is read once; counting, the light and the heavy groups all start from its best scores
    best = cut(best_scores(hits, group, item, score).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(SALTS))))
    large = best.groupBy("grp").agg(F.count("*").alias("size")).filter(F.col("size") > heavy)
    large = large.select("grp", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("part"))
    marked = best.join(large, ["grp", "part"], "left")
    order = [F.col("score").desc(), F.col("item").asc()]

    light = marked.filter("size is null").select("grp", "item", "score")
    hot = (
        marked.filter("size is not null")
        .withColumn("salt", F.pmod(F.xxhash64("item", F.lit(1)), F.ceil(F.col("size") / slice_rows)))
        .select("grp", "salt", "item", "score")
        .repartitionByRange("grp", "salt")
        .withColumn("r", F.row_number().over(Window.partitionBy("grp", "salt").orderBy(*order)))
        .filter(F.col("r") <= n)
        .select("grp", "item", "score")
    )
    ranked = F.row_number().over(Window.partitionBy("grp").orderBy(*order))
    keep = [d.withColumn("rnk", ranked).filter(F.col("rnk") <= n) for d in (light, hot)]
    return keep[0].unionByName(keep[1]).select(F.col("grp").alias(group), F.col("item").alias(item), "score", "rnk")
