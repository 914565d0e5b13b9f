"""Queries of the training-data problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.functions.shared import cut
from cairn.functions.text import WHITE_SPACE
from cairn.llm.mixing import mix, mix_shares
from cairn.llm.neardup import groups, item_pairs, near_duplicates
from cairn.llm.spans import shared_share, shared_spans
from cairn.llm.tokens import encode_corpus, token_counts
from cairn.llm.topn import top_n
from cairn.llm.truncation import endings_of, length_hazards, text_values, truncated, truncation_report
from cairn.sources.tables import table

_WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def p1_top(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "doc_101_labeled"), 10).select("query", "chunk_id", "score", "rnk")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "doc_101_labeled"), 10).select("query", "chunk_id")


def _values(spark: SparkSession, d: str) -> DataFrame:
    ent, rel = table(spark, d, "entities"), table(spark, d, "relations")
    return text_values([("entities", ent, ["entity_name", "description"]), ("relations", rel, ["description"])])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(_values(spark, d)).filter("cut").select("ref_table", "row_id", "field")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return truncated(_values(spark, d)).filter("cut").select("ref_table", "row_id", "field", "reason")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation_report(truncated(_values(spark, d)), table(spark, d, "kg_metadata"))


def p4_lengths(spark: SparkSession, d: str) -> DataFrame:
    return length_hazards(cut(endings_of(_values(spark, d))))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = item_pairs(*near_duplicates(table(spark, d, "doc_101_labeled")))
    return pairs.withColumnsRenamed({"item_a": "chunk_id_a", "item_b": "chunk_id_b"})


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = near_duplicates(table(spark, d, "doc_101_labeled"))
    return groups(cut(pairs), members).withColumnRenamed("item", "chunk_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return cut(token_counts(table(spark, d, "documents"), ["doc_id", "source"]))


def p7_repeats(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_shares(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"))


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return shared_share(docs, shared_spans(docs))


_BEST = f"""with best as (
    select trim(query, {_WS}) as query, chunk_id, max(score) as score from doc_101_labeled
    where chunk_id is not null and score is not null and not isnan(score) and trim(query, {_WS}) <> '' group by 1, 2),
ranked as (select *, cast(row_number() over (partition by query order by score desc, chunk_id) as integer) as rnk from best)"""

# Bodies, and all shingles of all bodies against each other.
_NEAR = f"""with recursive chunks as (
    select chunk_id, max(case when trim(content, {_WS}) <> '' then content else text end) as raw
    from doc_101_labeled where chunk_id is not null group by chunk_id),
bodies as (select chunk_id, translate(raw, {_WS}, '') as body from chunks),
members as materialized (select chunk_id, body, min(chunk_id) over (partition by body) as rep from bodies where length(body) >= 5),
shingles as materialized (
    select distinct rep, s from (select rep, unnest(list_transform(range(1, length(body) - 3), lambda p: substr(body, p, 5))) as s
                                 from members where chunk_id = rep)),
sizes as (select rep, count(*) as n from shingles group by rep),
common as (select a.rep as a, b.rep as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.rep < b.rep group by a.rep, b.rep),
pairs as materialized (
    select a, b from common join sizes x on x.rep = a join sizes y on y.rep = b where common.n >= 0.7 * (x.n + y.n - common.n))"""

# Every window of 200 characters, cut from pieces that hold 200 of them each.
_SHARED = """with pieces as (
    select doc_id, q, substr(text, q, 399) as piece
    from (select doc_id, text, unnest(range(1, length(text) - 198, 200)) as q from documents where length(text) >= 200)),
places as (
    select doc_id, q + j - 1 as p, md5_number(substr(piece, j, 200)) as h
    from (select doc_id, q, piece, unnest(range(1, length(piece) - 198)) as j from pieces)),
recurring as (select h from places group by h having min(doc_id) < max(doc_id)),
hit as materialized (select distinct doc_id, p from places where h in (select h from recurring)),
fresh as (select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 200 then 0 else 1 end as f from hit),
runs as (select doc_id, p, sum(f) over (partition by doc_id order by p) as run from fresh),
spans as (select doc_id, cast(min(p) as integer) as span_start, cast(max(p) - min(p) + 200 as integer) as span_len from runs group by doc_id, run)"""

QUERIES = {
    "p1_found": p1_found, "p1_top": p1_top,
    "p4_found": p4_found, "p4_reasons": p4_reasons, "p4_report": p4_report, "p4_lengths": p4_lengths,
    "p5_found": p5_found, "p5_groups": p5_groups,
    "p6_ids": p6_ids,
    "p7_repeats": p7_repeats, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_share": p8_share,
}

SQL = {
    "p1_found": f"{_BEST} select query, chunk_id from ranked where rnk <= 10",
    "p1_top": f"{_BEST} select query, chunk_id, score, rnk from ranked where rnk <= 10",
    "p5_found": f"""{_NEAR}, found as (
        select x.chunk_id as x, y.chunk_id as y from pairs join members x on x.rep = a join members y on y.rep = b
        union all select x.chunk_id, y.chunk_id from members x join members y on x.rep = y.rep and x.chunk_id < y.chunk_id)
        select least(x, y) as chunk_id_a, greatest(x, y) as chunk_id_b from found""",
    "p5_groups": f"""{_NEAR}, links as (select a as x, b as y from pairs union all select b, a from pairs),
        reach as (select rep as node, rep as root from sizes union select y, root from reach join links on x = node),
        roots as (select node, min(root) as root from reach group by node),
        counted as (select x, count(*) as n from links group by x)
        select chunk_id, rep, root as group_id, coalesce(n, 0) as n_links
        from members join roots on node = rep left join counted on x = rep""",
    "p8_found": f"{_SHARED} select doc_id, span_start, span_len from spans",
    "p8_share": f"""{_SHARED}, per as (select doc_id, count(*) as n_spans, sum(span_len) as shared_chars from spans group by doc_id)
        select doc_id, cast(coalesce(length(text), 0) as bigint) as n_chars, coalesce(n_spans, 0) as n_spans,
               cast(coalesce(shared_chars, 0) as bigint) as shared_chars,
               case when coalesce(length(text), 0) > 0 then coalesce(shared_chars, 0) / cast(length(text) as double) end as share
        from documents left join per using (doc_id)""",
}
