"""Steps of a batch pipeline over retrieval hits and documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.fields import chunk_key
from cairn.functions.text import is_blank, strip
from cairn.operators.dialogue import depth
from cairn.operators.ranking import top_per_group


def best_hits(hits: DataFrame) -> DataFrame:
    """One row per query and chunk: query (stripped), chunk_id, score (the best), rel (1 if any row is positive)."""
    rows = hits.select(strip("query").alias("query"), "chunk_id", "score", F.when(F.col("type") == "positive", 1).otherwise(0).alias("rel"))
    rows = rows.filter("query <> '' and chunk_id is not null and score is not null and not isnan(score)")
    return rows.groupBy("query", "chunk_id").agg(F.max("score").alias("score"), F.max("rel").alias("rel"))


def waterfall(hits: DataFrame, strong: float, enough: int) -> DataFrame:
    """Strong hits of each query, and the weaker ones of queries with fewer than ``enough``: query, chunk_id, score, stage."""
    n = hits.groupBy("query").agg(F.count_if(F.col("score") >= strong).alias("n"))
    few = hits.filter(F.col("score") < strong).join(n.filter(F.col("n") < enough), "query", "left_semi")
    mark = lambda df, s: df.select("query", "chunk_id", "score", F.lit(s).alias("stage"))
    return mark(hits.filter(F.col("score") >= strong), "first").unionByName(mark(few, "second"))


def looked_up(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rows with a value found by keys, null where there is none. Blank values don't count; of several the largest."""
    one = lookup.filter(~is_blank(value)).groupBy(*keys).agg(F.max(value).alias(value))
    return rows.join(one, list(keys), "left")


def manifest(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What is stored and the new rows whose key isn't."""
    return stored.unionByName(new.join(stored, key, "left_anti").select(*stored.columns))


def one_of(c: Column, known: Sequence[str], default: str) -> Column:
    """The value if it is a known one, else the default (for null, too)."""
    return F.when(c.isin(*known), c).otherwise(F.lit(default))


def containing(rows: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Rows with each name their text contains.

    names is a configured list that doesn't grow with the rows; every row is compared with it in its own task. Blank
    names match nothing.
    """
    return rows.join(names.filter(~is_blank(name)), F.expr(f"instr({text}, {name}) > 0"))


def projected(rows: DataFrame, fields: Mapping[str, object]) -> DataFrame:
    """The named fields, with the value given for each where it is null or the rows don't have it (text where the type is unknown)."""
    known = set(rows.columns)
    one = lambda f, v: (F.coalesce(F.col(f), F.lit(v)) if f in known else F.lit(v).cast("string")).alias(f)
    return rows.select(*[one(f, v) for f, v in fields.items()])


def matching(rows: DataFrame, where: Mapping[str, object]) -> DataFrame:
    """The rows that meet every condition: a value (None: null), or one of $in, $ne, $gt, $gte, $lt, $lte with a value.

    The conditions are plain comparisons, so they reach the scan.
    """
    ops: dict[str, Callable[[Column, object], Column]] = {
        "$in": lambda c, v: c.isin(*v),
        "$ne": lambda c, v: c.isNotNull() if v is None else c != v,
        "$gt": lambda c, v: c > v,
        "$gte": lambda c, v: c >= v,
        "$lt": lambda c, v: c < v,
        "$lte": lambda c, v: c <= v,
    }
    for field, want in where.items():
        c = F.col(field)
        if isinstance(want, Mapping):
            for op, v in want.items():
                if op not in ops:
                    raise ValueError(f"unknown condition {op}; known: {', '.join(ops)}")
                rows = rows.filter(ops[op](c, v))
        else:
            rows = rows.filter(c.isNull() if want is None else c == F.lit(want))
    return rows


def any_word(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds one of the words; null for a null text."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def adaptive(hits: DataFrame, k: int = 10) -> DataFrame:
    """As much as a question needs: query, chunk_id, depth, rank, of hits (query, chunk_id, document_id, score, words).

    A simple question takes its 3 best by score; a medium one the 5 best by score and the 5 that share most words,
    ranked by both; a complex one its 5 best and, as a second hop, all hits in their documents. At most ``k`` each.
    """
    h = hits.withColumn("depth", depth(F.col("query")))
    first = lambda kind, by, n: top_per_group(h.filter(F.col("depth") == kind), ["query"], [F.col(by).desc(), F.col("chunk_id")], n)
    cols = ["query", "chunk_id", "depth"]
    simple = first("simple", "score", 3).select(*cols, "score")
    medium = first("medium", "score", 5).unionByName(first("medium", "words", 5)).select(*cols, F.round(0.5 * F.col("score") + 0.5 * F.col("words"), 6).alias("score"))
    best = first("complex", "score", 5)
    hop = h.filter("depth = 'complex'").join(best.select("query", "document_id").distinct(), ["query", "document_id"], "left_semi")
    all_ = simple.unionByName(medium).unionByName(best.select(*cols, "score")).unionByName(hop.select(*cols, "score")).distinct()
    return top_per_group(all_, ["query"], [F.col("score").desc(), F.col("chunk_id")], k).select(*cols, "rank")


def with_turn_before(asked: DataFrame) -> DataFrame:
    """A stated conversation (query_id, query) with each question written after the one before it, which it may refer to."""
    before = asked.select((F.col("query_id") + 1).alias("query_id"), F.col("query").alias("before"))
    return asked.join(before, "query_id", "left").select("query_id", F.concat_ws(" ", "before", "query").alias("query"))


#: Pages whose texts are joined in one part of a document.
PART_PAGES = 8


def document_parts(chunks: DataFrame) -> DataFrame:
    """The whole texts of a document joined by blank lines: document_id, part (from 0), body.

    chunks: document_id, chunk_id, text. A part holds PART_PAGES pages, the first one also the chunks whose id names no
    page; parts in their order, joined by a blank line, are the document. So a document that holds a third of all
    chunks is many groups. Chunks are in the order of page, index and id; equal ones count once.
    """
    key = chunk_key("chunk_id")
    c = chunks.filter("chunk_id is not null and text is not null").select("document_id", "chunk_id", "text").distinct()
    c = c.withColumns({"page": F.coalesce(key["page_idx"], F.lit(-1)), "idx": F.coalesce(key["chunk_index"], F.lit(-1))})
    part = F.greatest(F.floor(F.col("page") / PART_PAGES), F.lit(0)).cast("bigint")
    g = c.groupBy("document_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("page", "idx", "chunk_id", "text"))).alias("c"))
    return g.select("document_id", "part", F.array_join(F.transform("c", lambda x: x["text"]), "\n\n").alias("body"))
