"""Search over vectors: exact, by inverted lists, reranked and fused."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.ranking import top_per_group

#: Rows of one block of the corpus and of one block of queries; a task multiplies one by the other.
CORPUS_BLOCK, QUERY_BLOCK = 4096, 512


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of a vector, in double."""
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """The vector divided by its length, in double; null for a vector of length 0."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def hashed_words(terms: Column, dim: int = 16) -> Column:
    """The default embedder: how many terms fall to each of ``dim`` (at most 16) places by the first hex digit of their md5."""
    digit = F.transform(terms, lambda t: F.conv(F.substring(F.md5(t), 1, 1), 16, 10).cast("int") % dim)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(digit, lambda x: x == i)).cast("float"))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Larger is nearer for every metric: ip, cosine, or l2 (the squared distance, negated)."""
    if metric == "ip":
        return dot(a, b)
    if metric == "cosine":
        return F.try_divide(dot(a, b), norm(a) * norm(b))
    if metric == "l2":
        d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        return -dot(d, d)
    raise ValueError(f"unknown metric {metric}")


def _pack(batches: Iterator[pa.RecordBatch], size: int, normal: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            b = batch.slice(i, size)
            m = np.array(b.column("vec").to_pylist(), np.float64)
            if normal:
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_arrays([pa.array([b.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([b.column("grp").to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], names=["ids", "grps", "m"])


def _multiply(batches: Iterator[pa.RecordBatch], metric: str, k: int, same: bool, least: float | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            q = np.frombuffer(row["qm"]).reshape(len(row["qids"]), -1)
            c = np.frombuffer(row["m"]).reshape(len(row["ids"]), -1)
            s = q @ c.T
            if metric == "l2":
                s = 2 * s - (q * q).sum(1)[:, None] - (c * c).sum(1)[None, :]
            s = np.round(s, 6) + 0.0
            ids, qids = np.array(row["ids"]), np.array(row["qids"])
            out = np.isfinite(s)
            if same:
                out &= np.array(row["qgrps"])[:, None] == np.array(row["grps"])[None, :]
            if least is not None:
                out &= s >= least
            a, b = [], []
            for i in range(len(qids)):
                here = np.flatnonzero(out[i])
                best = here[np.lexsort((ids[here], -s[i, here]))[:k]]
                a.append(np.full(len(best), i))
                b.append(best)
            a, b = np.concatenate(a).astype(int), np.concatenate(b).astype(int)
            yield pa.RecordBatch.from_arrays([pa.array(qids[a], pa.int64()), pa.array(ids[b], pa.int64()), pa.array(s[a, b])], names=["query_id", "id", "score"])


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", same_group: bool = False, least: float | None = None) -> DataFrame:
    """The k nearest of a corpus for each query, exactly: query_id, id, score (6 decimals), rank.

    queries, corpus: id (bigint), vec (array of numbers), grp (bigint). The filters come before the rank: with
    ``same_group`` only rows of the query's group count, with ``least`` only scores from it on. Scores are inner
    products, cosines or negated squared distances; ties go to the smaller id. Null vectors are left out; fewer than
    k rows give fewer.

    Vectors are packed into blocks, every block of queries meets every block of the corpus, and a task multiplies the
    two as matrices and keeps k per query, so what is shuffled is k rows per query and corpus block.
    """
    cols = ["id", "vec", "grp"]
    cosine = metric == "cosine"
    pack = lambda df, n: df.select(*cols).filter("vec is not null").mapInArrow(partial(_pack, size=n, normal=cosine), "ids array<bigint>, grps array<bigint>, m binary")
    q = pack(queries, QUERY_BLOCK).withColumnsRenamed({"ids": "qids", "grps": "qgrps", "m": "qm"})
    pairs = pack(corpus, CORPUS_BLOCK).join(q)  # blocks against blocks
    found = pairs.mapInArrow(partial(_multiply, metric=metric, k=k, same=same_group, least=least), "query_id bigint, id bigint, score double")
    return top_per_group(found, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def centroids(corpus: DataFrame, digits: int = 9) -> DataFrame:
    """The mean vector of each group: grp, vec. Means are taken per dimension, so a large group isn't gathered anywhere."""
    each = corpus.filter("vec is not null").select("grp", F.posexplode("vec").alias("i", "x"))
    mean = each.groupBy("grp", "i").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("x"))
    parts = F.array_sort(F.collect_list(F.struct("i", "x")))
    return mean.groupBy("grp").agg(F.transform(parts, lambda p: p["x"]).alias("vec"))


def probed(queries: DataFrame, corpus: DataFrame, lists: DataFrame, probes: int, k: int) -> DataFrame:
    """The k nearest by inner product among the ``probes`` groups whose centroids are nearest to the query: query_id, id, score, rank.

    lists: grp, vec (the centroids; as many as the index has lists, a bound that doesn't grow with the data). The
    corpus is joined by group only with the queries that probe it. Recall is what the probes cost; see recall_of.
    """
    c = lists.select(F.col("grp").alias("list"), F.col("vec").alias("cvec"))
    near = queries.filter("vec is not null").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")).join(c)
    near = near.withColumn("near", F.round(dot(F.col("qvec"), F.col("cvec")), 6))
    chosen = top_per_group(near, ["query_id"], [F.col("near").desc(), F.col("list")], probes, "p").select("query_id", "list", "qvec")
    hits = corpus.filter("vec is not null").join(chosen, F.col("grp") == F.col("list"))
    hits = hits.select("query_id", "id", F.round(dot(F.col("qvec"), F.col("vec")), 6).alias("score"))
    return top_per_group(hits, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of the exact results that were found, in one row: n_exact, n_found, recall."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.round(F.try_divide(F.col("n_found").cast("double"), "n_exact"), 6))


def rerank(recalled: DataFrame, score: Column, k: int) -> DataFrame:
    """Of each query's recalled rows the k with the best new score: all columns, score, rank."""
    return top_per_group(recalled.drop("rank").withColumn("score", F.round(score, 6)), ["query_id"], [F.col("score").desc(), F.col("id")], k)


def fused(parts: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """Results of several searches by weighted sum of their scores, a missing one counting 0: query_id, id, score, rank."""
    out = None
    for df, w in parts:
        p = df.select("query_id", "id", (F.col("score") * w).alias("s"))
        out = p if out is None else out.unionByName(p)
    total = out.groupBy("query_id", "id").agg(F.round(F.sum("s"), 7).alias("score"))
    return top_per_group(total, ["query_id"], [F.col("score").desc(), F.col("id")], k)
