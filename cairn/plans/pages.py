"""Queries of tables on pages, whole (survey: A04, C07, C09, C11, V07, S27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import fields as X
from cairn.functions.text import WHITE_SPACE
from cairn.operators import tables as B
from cairn.plans.documents import _TABLES
from cairn.plans.registry import registry
from cairn.plans.text import _KEPT
from cairn.sources.tables import table

QUERIES, SQL, query = registry()
WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
T = f"trim(%s, {WS})"
#: The shortest text around a table that is kept here: the pages of these reports say little beside their tables.
LEAST = 12
#: Pages that two parts of a table may be apart. Neighbouring pages alone give next to no merged table in these reports.
GAP = 5

_PAGES = """pages as (select chunk_id, max(document_id) as document_id, max(page_idx) as page_idx, max(stage) as stage, max(text) as text, max(content) as content, max(headers_norm) as headers from doc_101_labeled where chunk_id is not null group by 1)"""
_MD = f"list_filter(string_split(content, chr(10)), lambda x: starts_with({T % 'x'}, '|'))"
_CHUNKS = f"""{_PAGES}, lines as (select * exclude (content), content as whole, array_to_string({_MD}, chr(10)) as content from pages), cleaned as (select * exclude (content), array_to_string({_KEPT}, chr(10)) as markdown from lines),
    chunks as (select *, concat_ws(chr(10), '【' || nullif(stage, '') || '】', '第' || (page_idx + 1) || '页表格', markdown) as chunk_text,
        concat_ws(chr(10), coalesce('## 【' || nullif(stage, '') || ' - 第' || (page_idx + 1) || '页】' || chr(10), '## 第' || (page_idx + 1) || '页表格' || chr(10)), markdown) as chunk_content,
        substr(md5(coalesce(headers, '') || '|' || coalesce(stage, '')), 1, 12) as group_id, coalesce(len(list_filter(string_split(nullif(markdown, ''), chr(10)), lambda x: not regexp_matches(x, '{X.RULE_ROW}'))), case when markdown is not null then 0 end) as n_rows from cleaned)"""


def _pages(spark, d):
    h = table(spark, d, "doc_101_labeled").filter("chunk_id is not null").groupBy("chunk_id")
    of = {"document_id": "document_id", "page_idx": "page_idx", "stage": "stage", "text": "text", "content": "content", "headers_norm": "headers"}
    return h.agg(*[F.max(c).alias(a) for c, a in of.items()])


@query("C07_whole_chunks", f"with {_CHUNKS} select chunk_id, chunk_text, chunk_content, group_id, n_rows from chunks where contains(whole, chr(10) || '|')")
def _(spark, d):
    p = _pages(spark, d).filter(F.col("content").contains("\n|"))
    return B.table_chunks(p).select("chunk_id", "chunk_text", "chunk_content", "group_id", "n_rows")


_NOTE = " or ".join(f"contains(t, '{w}')" for w in B.NOTE_WORDS)
_NEARBY = f"""l as (select chunk_id, string_split(content, chr(10)) as lines from pages where content is not null), r as (select *, list_transform(lines, lambda x: starts_with({T % 'x'}, '|')) as row_ from l),
    s as (select chunk_id, list_position(row_, true) as first, len(row_) - list_position(list_reverse(row_), true) + 1 as last, unnest(list_transform(lines, lambda x, i: {{'t': {T % 'x'}, 'i': i}}), recursive := true) from r where list_contains(row_, true)),
    o as (select *, case when i < first then 0 else 1 end as side, case when i < first then first - i else i - last end as far from s where t <> '' and (i < first or i > last)),
    n as (select *, sum(length(t)) over (partition by chunk_id, side order by far rows unbounded preceding) as total, {_NOTE} as note from o),
    k as (select *, row_number() over (partition by chunk_id, side order by note desc, far) as rank from n where total <= 1200),
    described as (select chunk_id, string_agg(t, chr(10) order by side, rank) as description from k where rank <= 5 group by 1 having length(string_agg(t, chr(10) order by side, rank)) >= {LEAST})"""


@query("C09_nearby_texts", f"with {_PAGES}, {_NEARBY} select chunk_id, description from described")
def _(spark, d):
    return B.nearby_texts(_pages(spark, d), "chunk_id", least=LEAST)


@query("S27_whole_pages", f"""with {_TABLES}, {_CHUNKS}, {_NEARBY} select chunk_id, chunk_text, group_id, n_rows, description, contains(coalesce(c.headers, ''), 'feature_desc') or contains(coalesce(c.headers, ''), '特征描述') as has_feature
    from chunks c join p using (chunk_id) left join described using (chunk_id) where len(p.cells) >= 2 and not p.placeholder and length(whole) >= 50 and (contains(whole, '规格') or contains(whole, '材质') or contains(whole, 'spec'))""")
def _(spark, d):
    pages = _pages(spark, d)
    rows = B.cells(F.col("content"))
    word = F.col("content").contains("规格") | F.col("content").contains("材质") | F.col("content").contains("spec")
    kept = pages.filter((F.length("content") >= 50) & word).withColumn("cells", rows).filter((F.size("cells") >= 2) & ~B.is_placeholder(F.col("cells"))).drop("cells")
    headers = F.coalesce("headers", F.lit(""))
    out = B.table_chunks(kept).join(B.nearby_texts(kept, "chunk_id", least=LEAST), "chunk_id", "left")
    return out.select("chunk_id", "chunk_text", "group_id", "n_rows", "description", (headers.contains("feature_desc") | headers.contains("特征描述")).alias("has_feature"))


# the reports have no boxes; these stand in for them, made from each row
_BODY = f"{T % "regexp_replace(regexp_replace(text, '^【[^】]+】[ \\t\\n\\r]*', ''), '^第[0-9]+页表格[ \\t\\n\\r]*', '')"}"
_SHOWN = f"{T % f"array_to_string(list_filter(string_split(whole, chr(10)), lambda x: not starts_with({T % 'x'}, '##')), chr(10))"}"
_SPAN = "(min(page_idx) + 1) || '-' || (max(page_idx) + 1)"
_STAGE = "nullif(arg_min_null(stage, o), '')"


@query("A04_C11_V07_whole_tables", f"""with {_CHUNKS}, b as (select *, length(coalesce(text, '')) % 50 as x0, page_idx % 30 as y0, 100 + length(coalesce(whole, '')) % 40 as x1, 200 + page_idx % 7 as y1 from chunks where page_idx is not null),
    l as (select *, page_idx - lag(page_idx) over w as step, row_number() over w as o from b window w as (partition by document_id, group_id order by page_idx, chunk_id)),
    i as (select *, sum(case when step > 0 and step <= {GAP} then 0 else 1 end) over (partition by document_id, group_id order by page_idx, chunk_id rows unbounded preceding) as island from l),
    g as (select document_id, group_id, arg_min_null(chunk_id, o) as chunk_id, min(page_idx) as page_idx, arg_min_null(stage, o) as stage, cast(sum(coalesce(n_rows, 0)) as bigint) as n_rows, count(*) as n_pages, string_agg(cast(page_idx as varchar), ',' order by o) as pages,
        arg_min_null(text, o) as text1, arg_min_null(whole, o) as content1, arg_min_null(markdown, o) as markdown1, least(arg_min(x0, o), arg_max(x0, o)) || ',' || least(arg_min(y0, o), arg_max(y0, o)) || ',' || greatest(arg_min(x1, o), arg_max(x1, o)) || ',' || greatest(arg_min(y1, o), arg_max(y1, o)) as bbox,
        concat_ws(chr(10), '【' || {_STAGE} || '】', '第' || {_SPAN} || '页表格（跨页合并）', string_agg({_BODY}, chr(10) order by o) filter (text <> '')) as text2,
        concat_ws(chr(10) || chr(10), coalesce('## 【' || {_STAGE} || ' - 第' || {_SPAN} || '页】（跨页合并）' || chr(10), '## 第' || {_SPAN} || '页表格（跨页合并）' || chr(10)), string_agg({_SHOWN}, chr(10) || chr(10) order by o) filter (whole <> '')) as content2,
        coalesce(string_agg(markdown, chr(10) || chr(10) order by o) filter (markdown <> ''), arg_min_null(markdown, o)) as markdown2 from i group by document_id, group_id, island)
    select document_id, group_id, chunk_id, page_idx, stage, n_rows, n_pages, pages, bbox, case when n_pages > 1 then text2 else text1 end as text, case when n_pages > 1 then content2 else content1 end as content, case when n_pages > 1 then markdown2 else markdown1 end as markdown from g""")
def _(spark, d):
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    box = F.array(size("text") % 50, F.col("page_idx") % 30, 100 + size("content") % 40, 200 + F.col("page_idx") % 7)
    c = B.table_chunks(_pages(spark, d).filter("page_idx is not null")).withColumn("bbox", box)
    out = B.merged_pages(c.drop("headers", "chunk_text", "chunk_content"), GAP)
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",").alias(a)
    return out.select("document_id", "group_id", "chunk_id", "page_idx", "stage", "n_rows", "n_pages", joined("pages"), joined("bbox"), "text", "content", "markdown")
