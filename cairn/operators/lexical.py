"""Search by words: BM25 over one or several fields."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.shared import cut, spread
from cairn.operators.ranking import top_per_group

#: A term is a run of ASCII letters and digits, or one Chinese character.
TERM = r"([a-z0-9]+|[\x{4e00}-\x{9fff}])"
PATTERN = re.compile("[a-z0-9]+|[\u4e00-\u9fff]")
K1, B = 1.5, 0.75


def terms(c: Column | str) -> Column:
    """The terms of a text in order, in lower case; an empty array for null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_extract_all(F.lower(col), F.lit(TERM), F.lit(1)), F.array().cast("array<string>"))


def _count(batches: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, size, term, n = [], [], [], []
        for k, t in enumerate(b.column("text").to_pylist()):
            all_ = PATTERN.findall(t.lower()) if t else []
            found = Counter(x for x in all_ if x in wanted)
            for x, m in ((None, 0), *found.items()):
                at.append(k)
                size.append(len(all_))
                term.append(x)
                n.append(m)
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(size, pa.int64()), pa.array(term, pa.string()), pa.array(n, pa.int64())], names=["id", "len", "term", "tf"])


def term_counts(queries: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """How often each document has each term of the queries: id, len (all its terms), term, tf; a null term once per document.

    queries: query_id, query; a stated set that doesn't grow with the documents, so its terms go with the task. Each
    document is read once, and a row per document and matching term is all that is kept.
    """
    wanted = frozenset(r.term for r in queries.select(F.explode(terms("query")).alias("term")).distinct().collect())
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")))
    kind = docs.schema[id_col].dataType.simpleString()
    return cut(rows.mapInArrow(partial(_count, wanted=wanted), f"id {kind}, len bigint, term string, tf bigint"))


def bm25(queries: DataFrame, counts: DataFrame, digits: int = 6) -> DataFrame:
    """BM25 scores of all documents with a term of the query: query_id, id, score.

    counts: of term_counts. The idf is ln(1 + (N - df + 0.5) / (df + 0.5)). Documents without terms have length 0 and
    match nothing.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms("query"))).alias("term"))
    stats = counts.filter("term is null").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = counts.filter("term is not null")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # as many rows as the queries have terms
    weights = asked.join(df, "term").join(F.broadcast(stats))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return tf.join(weights, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), digits).alias("score"))


def matched_share(queries: DataFrame, counts: DataFrame, digits: int = 6) -> DataFrame:
    """The share of the query's different terms that each document has: query_id, id, score; documents with none have no row."""
    asked = queries.select("query_id", F.array_distinct(terms("query")).alias("t")).select("query_id", F.size("t").alias("of"), F.explode("t").alias("term"))
    hit = counts.filter("term is not null").join(asked, "term")
    return hit.groupBy("query_id", "id", "of").agg(F.count("*").alias("n")).select("query_id", "id", F.round(F.col("n") / F.col("of"), digits).alias("score"))


def best(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query: query_id, id, score, rank; ties go to the smaller id."""
    return top_per_group(scores, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def multi_field(queries: DataFrame, docs: DataFrame, id_col: str, boosts: dict[str, float], digits: int = 6) -> DataFrame:
    """Scores over several fields, the best boosted one counting: query_id, id, score."""
    out = None
    for field, boost in boosts.items():
        s = bm25(queries, term_counts(queries, docs, id_col, field), digits).withColumn("score", F.col("score") * boost)
        out = s if out is None else out.unionByName(s)
    return out.groupBy("query_id", "id").agg(F.round(F.max("score"), digits).alias("score"))
