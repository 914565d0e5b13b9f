"""Quality of ranked results and of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.lexical import terms


def ranked_metrics(ranked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Per query precision, recall, reciprocal rank, NDCG and average precision at k.

    ranked: query, rank (from 1), rel (0 or 1), at most k rows per query. totals: query, n_rel (relevant items there
    are), which has every query. Precision divides by k even if fewer were returned; recall, NDCG and average
    precision are null where nothing is relevant; a query without results has 0.
    """
    before = F.sum("rel").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    r = ranked.filter(F.col("rank") <= k).withColumn("seen", before)
    per = r.groupBy("query").agg(
        F.sum("rel").alias("hits"),
        F.max(F.col("rel") / F.col("rank")).alias("rr"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.sum(F.col("rel") * F.col("seen") / F.col("rank")).alias("ap"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = totals.join(per, "query", "left")
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    some = lambda c: F.when(F.col("n_rel") > 0, F.round(c, 6))
    return out.select(
        "query",
        F.round(num("hits") / k, 6).alias("precision"),
        some(num("hits") / F.col("n_rel")).alias("recall"),
        F.round(num("rr"), 6).alias("reciprocal_rank"),
        some(num("dcg") / ideal).alias("ndcg"),
        some(num("ap") / F.least("n_rel", F.lit(k))).alias("average_precision"),
    )


def means(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean, population deviation and number of non-null values of each metric: metric, mean, deviation, n."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("m")
    g = metrics.select(rows).select("m.*").groupBy("metric")
    return g.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"), F.count("value").alias("n"))


def verdicts(mean: DataFrame, good: float = 0.7) -> DataFrame:
    """Whether each metric's mean is good enough: metric, mean, verdict."""
    return mean.select("metric", "mean", F.when(F.col("mean") >= good, "good").otherwise("needs work").alias("verdict"))


def phrase_check(answer: Column, must: Sequence[str], must_not: Sequence[str]) -> Column:
    """True if the answer holds all required phrases and no forbidden one; null for a null answer."""
    ok = F.lit(True)
    for m in must:
        ok = ok & answer.contains(m)
    for m in must_not:
        ok = ok & ~answer.contains(m)
    return F.when(answer.isNotNull(), ok)


def overlap(a: Column | str, b: Column | str) -> Column:
    """The share of the different terms of a that b has; 0 if a has none. The default judge of grounding and recall."""
    x, y = F.array_distinct(terms(a)), F.array_distinct(terms(b))
    return F.when(F.size(x) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.lit(1)), 6))


def judged(rows: DataFrame, question: str, answer: str, context: str, truth: str) -> DataFrame:
    """Judge metrics of each row by term overlap: faithfulness, relevancy, context_precision, context_recall."""
    return rows.withColumns(
        {
            "faithfulness": overlap(answer, context),
            "relevancy": overlap(question, answer),
            "context_precision": overlap(context, truth),
            "context_recall": overlap(truth, context),
        }
    )
