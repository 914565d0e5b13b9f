"""Queries of chunking and tables (survey: C01-C11, A04, W02, W03, W05, W10, P08-P13, J10, V06, S05, S20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import fields as X
from cairn.functions.text import WHITE_SPACE, strip
from cairn.operators import chunking as C
from cairn.operators import tables as B
from cairn.plans.registry import registry
from cairn.sources.tables import table

QUERIES, SQL, query = registry()
WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
T = f"trim(%s, {WS})"


@query("C01_W10_fixed_chunks", f"""with s as (select doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 1000) / 800.0)::bigint))) * 800 as start from documents where length(text) > 0),
    c as (select doc_id, start, {T % 'substr(text, start + 1, 1000)'} as chunk from s)
    select doc_id, cast(row_number() over (partition by doc_id order by start) - 1 as integer) as idx, cast(start as integer) as start, chunk from c where chunk <> ''""")
def _(spark, d):
    return C.fixed(table(spark, d, "documents"))


def _packed(split: str, glue: str) -> str:
    return f"""with recursive p as (select doc_id, {T % 'part'} as part, row_number() over (partition by doc_id order by i) as i from (select doc_id, unnest(list_transform(list_filter(list_transform({split}, lambda x: {T % 'x'}), lambda x: x <> ''), lambda x, i: {{'part': x, 'i': i}}), recursive := true) from documents where text <> '')),
    fold as (select doc_id, i, part, length(part) as size, 0 as idx from p where i = 1
        union all select p.doc_id, p.i, p.part, case when fold.size + length(p.part) > 1000 then length(p.part) else fold.size + length(p.part) end, case when fold.size + length(p.part) > 1000 then fold.idx + 1 else fold.idx end
        from fold join p on p.doc_id = fold.doc_id and p.i = fold.i + 1)
    select doc_id, cast(idx as integer) as idx, string_agg(part, {glue} order by i) as chunk from fold group by doc_id, idx"""


@query("C02_sentence_chunks", _packed("regexp_split_to_array(text, '[。！？\\n]+|\\.[ \\t\\n\\r\\f\\v]+|![ \\t\\n\\r\\f\\v]+|\\?[ \\t\\n\\r\\f\\v]+')", "' '"))
def _(spark, d):
    return C.chunked(table(spark, d, "documents"), "sentence")


@query("C03_S05_paragraph_chunks", _packed("string_split(text, chr(10) || chr(10))", "chr(10) || chr(10)"))
def _(spark, d):
    return C.chunked(table(spark, d, "documents"), "paragraph")


@query("C04_bounded_chunks", f"""with recursive w as (select doc_id, text, 0 as start, 0 as k, least(1000, length(text)) as soft from documents where length(text) > 0
        union all select doc_id, text, stop - 200, k + 1, least(stop - 200 + 1000, length(text)) from
            (select *, case when soft < length(text) then soft + length(regexp_extract(substr(text, soft + 1, 100), '^[^。！？\\n]*[。！？\\n]')) else soft end as stop from w) where stop < length(text)),
    c as (select doc_id, k, {T % "substr(text, start + 1, case when soft < length(text) then soft + length(regexp_extract(substr(text, soft + 1, 100), '^[^。！？\\n]*[。！？\\n]')) else soft end - start)"} as chunk from w)
    select doc_id, cast(row_number() over (partition by doc_id order by k) - 1 as integer) as idx, chunk from c where chunk <> ''""")
def _(spark, d):
    return C.chunked(table(spark, d, "documents"), "bounded")


@query("C05_recursive_chunks")
def _(spark, d):
    return C.chunked(table(spark, d, "documents"), "recursive")


_LINES = """l as (select l_orderkey, l_returnflag, l_linestatus, l_linenumber, l_partkey, l_linenumber - lag(l_linenumber) over w as step from lineitem window w as (partition by l_orderkey, l_returnflag, l_linestatus order by l_linenumber, l_partkey)),
    i as (select *, sum(case when step > 0 and step <= 1 then 0 else 1 end) over (partition by l_orderkey, l_returnflag, l_linestatus order by l_linenumber, l_partkey rows unbounded preceding) as island from l)"""


@query("A04_W02_C11_merged_tables", f"""with {_LINES} select l_orderkey, l_returnflag, l_linestatus, min(l_linenumber) as first_page, max(l_linenumber) as last_page, count(*) as n_pages, string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber, l_partkey) as pages, string_agg('part ' || l_partkey, chr(10) order by l_linenumber, l_partkey) as body from i group by 1, 2, 3, island""")
def _(spark, d):
    t = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    return B.merged_tables(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag", "l_linestatus"], "l_linenumber", ["l_partkey"], t)


@query("W03_B14_renumbered", "select distinct chunk_id, document_id, page_idx, cast(dense_rank() over (partition by document_id order by page_idx, chunk_id) - 1 as integer) as chunk_index from doc_101_labeled where chunk_id is not null and document_id is not null and page_idx is not null")
def _(spark, d):
    c = table(spark, d, "doc_101_labeled").filter("chunk_id is not null and document_id is not null and page_idx is not null").select("chunk_id", "document_id", "page_idx").distinct()
    return B.renumbered(c, ["document_id"], ["page_idx", "chunk_id"])


_HEADS, _TOTALS = [*B.HEADER_WORDS], [*B.TOTAL_WORDS]
_BARE = f"translate(x, {WS}, '')"
_SPACE = "[ \\t\\n\\r\\x0B\\f\\x{00A0}\\x{3000}]+"
_FEATURE = f"translate(lower(regexp_replace({T % 'c'}, '{_SPACE}', ' ', 'g')), '：（）', ':()') in ('项目特征描述', '特征描述', 'feature_desc')"
_CORE = f"trim(trim(trim({T % 'c'}, '|'), '-'), {WS})"
_SAYS = f"({_CORE} <> '' and not regexp_full_match({_CORE}, '[-—·. ]+') and not list_contains({_HEADS + _TOTALS!r}, {_CORE}) and lower(replace({_CORE}, ' ', '')) not in ('col7', 'col8'))"
#: The tables of the chunks: rows of cells (cells), the first of them the header, and whether they hold no data.
_TABLES = f"""t as (select chunk_id, content, headers, list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda x: {T % 'x'}), lambda x: starts_with(x, '|') and not regexp_matches(x, '{X.RULE_ROW}')),
        lambda x: list_transform(string_split(regexp_replace(x, '^\\||\\|$', '', 'g'), '|'), lambda c: {T % 'c'})) as cells from (select chunk_id, max(content) as content, max(headers_norm) as headers from doc_101_labeled where chunk_id is not null group by 1)),
    w as (select *, cells[2:] as body, list_distinct(list_filter(list_transform(cells[1], lambda x: {_BARE}), lambda x: x <> '')) as words, list_transform(list_filter(list_transform(cells[1], lambda c, i: {{'f': {_FEATURE}, 'i': i}}), lambda c: c.f), lambda c: c.i) as feat from t),
    v as (select *, list_filter(body, lambda r: not (len(words) > 0 and len(list_intersect(list_distinct(list_filter(list_transform(r, lambda x: {_BARE}), lambda x: x <> '')), words)) >= greatest(3, floor(len(words) * 0.6))) and not list_has_any(r, {_TOTALS!r})) as held from w),
    p as (select *, coalesce(len(body) = 0 or len(flatten(body)) = 0 or len(list_filter(flatten(body), lambda c: c <> '')) < len(flatten(body)) * 0.05 or len(list_filter(flatten(held), lambda c: {_SAYS})) = 0
        or (len(feat) > 0 and len(list_filter(held, lambda r: len(list_filter(list_transform(feat, lambda i: r[i]), lambda c: c is not null and {_SAYS})) > 0)) = 0), true) as placeholder from v)"""


@query("P10_placeholder_tables", f"with {_TABLES} select chunk_id, cast(len(cells) as integer) as n_rows, placeholder from p")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter("chunk_id is not null").groupBy("chunk_id").agg(F.max("content").alias("content"))
    cells = B.cells(F.col("content"))
    return h.select("chunk_id", F.when(F.col("content").isNotNull(), F.size(cells)).alias("n_rows"), B.is_placeholder(cells).alias("placeholder"))


@query("P08_P09_keyword_filter", "select hit_id from doc_101_labeled where contains(headers_norm, 'feature_desc') or contains(headers_norm, '特征描述') or contains(text, '规格')")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled")
    return h.filter(F.col("headers_norm").contains("feature_desc") | F.col("headers_norm").contains("特征描述") | F.col("text").contains("规格")).select("hit_id")


@query("P11_P12_P13_size_filter", f"select hit_id from doc_101_labeled where length({T % 'text'}) >= 50 and {T % 'content'} <> ''")
def _(spark, d):
    return table(spark, d, "doc_101_labeled").filter((F.length(strip("text")) >= 50) & (F.length(strip("content")) > 0)).select("hit_id")


@query("C07_table_chunks", """select distinct chunk_id, '【' || stage || '】' || chr(10) || '第' || (page_idx + 1) || '页表格' || chr(10) || headers_norm as built, substr(md5(headers_norm || '|' || stage), 1, 12) as group_id from doc_101_labeled where chunk_id is not null""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter("chunk_id is not null")
    built = F.concat(F.lit("【"), "stage", F.lit("】\n第"), (F.col("page_idx") + 1).cast("string"), F.lit("页表格\n"), "headers_norm")
    return h.select("chunk_id", built.alias("built"), F.substring(F.md5(F.concat("headers_norm", F.lit("|"), "stage")), 1, 12).alias("group_id")).distinct()


_IOU = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query("J10_V06_outside_tables", f"""with box as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity as x0, l_tax * 100 as y0, l_quantity + 20.0 as x1, l_tax * 100 + 20.0 as y1 from lineitem),
    tables as (select * from box where l_returnflag = 'R'), blocks as (select * from box where l_returnflag <> 'R')
    select l_orderkey, l_linenumber, l_partkey from blocks a where not exists (select 1 from tables b where b.l_orderkey = a.l_orderkey and {_IOU} / (800.0 - {_IOU}) > 0.2)""")
def _(spark, d):
    box = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("l_quantity").alias("x0"), (F.col("l_tax") * 100).alias("y0"), (F.col("l_quantity") + 20.0).alias("x1"), (F.col("l_tax") * 100 + 20.0).alias("y1"))
    a, b = box.filter("l_returnflag <> 'R'").alias("a"), box.filter("l_returnflag = 'R'").alias("b")
    sides = lambda t: [F.col(f"{t}.{c}") for c in ("x0", "y0", "x1", "y1")]
    return a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (B.iou(sides("a"), sides("b")) > 0.2), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("W05_T08_within_length", """with l as (select l_orderkey, l_linenumber, l_partkey, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding) as total from lineitem) select l_orderkey, l_linenumber, l_partkey, total from l where total <= 60""")
def _(spark, d):
    return B.within_length(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], F.col("l_quantity"), 60).select("l_orderkey", "l_linenumber", "l_partkey", "total")
