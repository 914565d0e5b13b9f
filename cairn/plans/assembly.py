"""Queries that put rows, texts and answers together (survey: S08, S26, S27, K03, K05, K20, P15, P17, A18, U04-U09, F02, F30, V10, D01, M03-M08, C08-C10, X07, X10, X14, X21, X27-X32, ST6, ST7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.functions import fields as X
from cairn.functions.shared import checkpoint_dir
from cairn.functions.text import WHITE_SPACE, is_blank, strip
from cairn.operators import chunking as C
from cairn.operators import graph as G
from cairn.operators import tables as B
from cairn.operators import vectors as V
from cairn.operators.evaluation import overlap
from cairn.operators.ranking import top_per_group
from cairn.operators.replies import keywords_of
from cairn.plans.registry import registry
from cairn.sources import store
from cairn.sources.tables import questions, table

QUERIES, SQL, query = registry()
WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
T = f"trim(%s, {WS})"
_TERMS = "regexp_extract_all(lower(%s), '([a-z0-9]+|[\\x{4e00}-\\x{9fff}])', 1)"


@query("S08_scanned_documents", f"""with p as (select document_id, page_idx, max(length({T % 'text'})) as n from doc_101_labeled where document_id is not null and page_idx < 10 group by 1, 2)
    select document_id, cast(count_if(n > 50) as bigint) < 3 as scanned from p group by 1""")
def _(spark, d):
    p = table(spark, d, "doc_101_labeled").filter("document_id is not null and page_idx < 10").groupBy("document_id", "page_idx").agg(F.max(F.length(strip("text"))).alias("n"))
    return p.groupBy("document_id").agg((F.count_if(F.col("n") > 50) < 3).alias("scanned"))


@query("S26_J12_frames_and_subtitles", """with f as (select event_id, user_id, date_trunc('minute', ts) as at from events where event_type = 'view'), s as (select user_id, date_trunc('minute', ts) as at, count(*) as n from events where event_type = 'click' group by 1, 2)
    select f.event_id, coalesce(s.n, 0) as n_subtitles from f left join s on f.user_id = s.user_id and f.at = s.at""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("at", F.date_trunc("minute", "ts"))
    s = e.filter("event_type = 'click'").groupBy("user_id", "at").agg(F.count("*").alias("n"))
    return e.filter("event_type = 'view'").join(s, ["user_id", "at"], "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n_subtitles"))


@query("S27_page_tables")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter("chunk_id is not null").groupBy("chunk_id").agg(F.max("content").alias("content"), F.max("headers_norm").alias("headers"))
    h = h.withColumn("cells", B.cells(F.col("content"))).filter((F.size("cells") >= 2) & (F.length("content") >= 50))
    return h.filter(~B.is_placeholder(F.col("cells"))).select("chunk_id", F.size("cells").alias("n_rows"), F.length("content").alias("n_chars"))


@query("P15_A01_element_classes", "select case when event_type in ('view', 'click') then 'text' when event_type = 'purchase' then 'table' end as class, count(*) as n from events where event_type in ('view', 'click', 'purchase') group by 1")
def _(spark, d):
    c = F.when(F.col("event_type").isin("view", "click"), "text").when(F.col("event_type") == "purchase", "table")
    return table(spark, d, "events").select(c.alias("class")).filter("class is not null").groupBy("class").agg(F.count("*").alias("n"))


@query("P17_graded_documents", f"""select hit_id from doc_101_labeled where len(list_distinct({_TERMS % 'query'})) > 0 and round(len(list_intersect(list_distinct({_TERMS % 'query'}), list_distinct({_TERMS % "coalesce(text, '')"}))) / len(list_distinct({_TERMS % 'query'})), 6) >= 0.2""")
def _(spark, d):
    return table(spark, d, "doc_101_labeled").filter(overlap("query", "text") >= 0.2).select("hit_id")


@query("A18_keyword_queries", f"select row_id, array_to_string(list_filter(list_transform(string_split(keywords, ','), lambda x: {T % 'x'}), lambda x: x <> ''), ' ') as query from relations where keywords is not null")
def _(spark, d):
    return table(spark, d, "relations").filter("keywords is not null").select("row_id", F.array_join(X.split_markers("keywords", [","]), " ").alias("query"))


@query("F02_split_markers", f"select row_id, len(list_filter(list_transform(regexp_split_to_array(keywords, ',|-'), lambda x: {T % 'x'}), lambda x: x <> '')) as n_parts from relations where keywords is not null")
def _(spark, d):
    return table(spark, d, "relations").filter("keywords is not null").select("row_id", F.size(X.split_markers("keywords", [",", "-"])).cast("bigint").alias("n_parts"))


@query("F30_positions", f"""with s as (select doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 1000) / 800.0)::bigint))) * 800 as start from documents where length(text) > 0)
    select doc_id, start || '-' || least(start + 1000, length(text)) as position from s where {T % 'substr(text, start + 1, 1000)'} <> ''""")
def _(spark, d):
    docs = table(spark, d, "documents")
    c = C.fixed(docs).join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    return c.select("doc_id", F.concat_ws("-", F.col("start").cast("string"), F.least(F.col("start") + 1000, F.col("n")).cast("string")).alias("position"))


_HEADERS = ["quantity", "unit", "depth", "area", "floors"]


@query("U04_header_overlap", f"select hit_id, len(list_intersect(list_distinct(list_transform(string_split(headers_norm, '|'), lambda x: {T % 'x'})), {_HEADERS!r})) as n_shared from doc_101_labeled where headers_norm is not null")
def _(spark, d):
    h = F.transform(F.split("headers_norm", r"\|"), strip)
    return table(spark, d, "doc_101_labeled").filter("headers_norm is not null").select("hit_id", F.size(F.array_intersect(h, F.array(*map(F.lit, _HEADERS)))).cast("bigint").alias("n_shared"))


@query("U05_M08_keyword_union", f"""select row_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(keywords, '') || ',' || coalesce(relation_type, ''), ','), lambda x: {T % 'x'}), lambda x: x <> ''))), ',') as keywords from relations""")
def _(spark, d):
    both = F.array_union(X.keyword_list("keywords"), X.keyword_list("relation_type"))
    return table(spark, d, "relations").select("row_id", F.array_join(F.array_sort(both), ",").alias("keywords"))


@query("U07_both_sources", f"select 'kb' as source, count(*) as n from entities where {T % 'entity_id'} <> '' union all select 'web', count(*) from seed_entities")
def _(spark, d):
    kb = table(spark, d, "entities").filter(~is_blank("entity_id")).select(F.lit("kb").alias("source"), "entity_id")
    web = table(spark, d, "seed_entities").select(F.lit("web").alias("source"), "entity_id")
    return kb.unionByName(web).groupBy("source").agg(F.count("*").alias("n"))


@query("U09_M03_flattened", f"select kw, count(*) as n from (select {T % 'unnest(string_split(keywords, chr(44)))'} as kw from relations) where kw <> '' group by 1")
def _(spark, d):
    return table(spark, d, "relations").select(F.explode(X.split_markers("keywords", [","])).alias("kw")).groupBy("kw").agg(F.count("*").alias("n"))


@query("M07_last_name_wins", f"""select regexp_replace({T % 'entity_name'}, '[ \\t\\n\\r\\x0B\\f\\x{{00A0}}\\x{{3000}}:：、,，。;；()（）\\-]+', '', 'g') as key, arg_max(entity_name, row_id) as name from entities where {T % 'entity_name'} <> '' group by 1""")
def _(spark, d):
    e = table(spark, d, "entities").filter(~is_blank("entity_name"))
    return e.groupBy(X.canonical("entity_name").alias("key")).agg(F.max_by("entity_name", "row_id").alias("name"))


_PARTS = f"""parts as (select doc_id, i, part, case when contains(part, '备注') or contains(part, '说明') or contains(part, 'Note') then 3 else 1 end as score from
        (select doc_id, unnest(list_transform(string_split(text, chr(10) || chr(10)), lambda x, i: {{'part': {T % 'x'}, 'i': i}}), recursive := true) from documents where text <> '') where part <> '')"""


def _parts(spark, d):
    p = table(spark, d, "documents").filter("text <> ''").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("i", "part"))
    p = p.select("doc_id", (F.col("i") + 1).cast("bigint").alias("i"), strip("part").alias("part")).filter("part <> ''")
    key = F.col("part").contains("备注") | F.col("part").contains("说明") | F.col("part").contains("Note")
    return p.withColumn("score", F.when(key, 3).otherwise(1))


@query("C09_T08_description_blocks", f"""with {_PARTS}, c as (select *, sum(length(part)) over (partition by doc_id order by i rows unbounded preceding) as total from parts)
    select doc_id, i, score, cast(row_number() over (partition by doc_id order by score desc, i) as integer) as rank from c where total <= 1200 qualify row_number() over (partition by doc_id order by score desc, i) <= 5""")
def _(spark, d):
    near = B.within_length(_parts(spark, d), ["doc_id"], ["i"], F.length("part"), 1200)
    return top_per_group(near, ["doc_id"], [F.col("score").desc(), F.col("i")], 5).select("doc_id", "i", "score", "rank")


@query("C10_W05_page_descriptions", f"""with {_PARTS}, c as (select *, sum(length(part)) over (partition by doc_id order by i rows unbounded preceding) as total from parts where score = 3)
    select doc_id, string_agg(part, chr(10) order by i) as description from c where total <= 1200 group by 1 having length(string_agg(part, chr(10) order by i)) >= 50""")
def _(spark, d):
    near = B.within_length(_parts(spark, d).filter("score = 3"), ["doc_id"], ["i"], F.length("part"), 1200)
    parts = F.array_sort(F.collect_list(F.struct("i", "part")))
    out = near.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n").alias("description"))
    return out.filter(F.length("description") >= 50)


@query("C08_page_chunks", f"select doc_id, '第1页' || chr(10) || {T % 'text'} as chunk from documents where length({T % 'text'}) >= 50 and (contains(text, '编号') or contains(text, 'Ticket'))")
def _(spark, d):
    t = strip("text")
    rows = table(spark, d, "documents").filter((F.length(t) >= 50) & (F.col("text").contains("编号") | F.col("text").contains("Ticket")))
    return rows.select("doc_id", F.concat(F.lit("第1页\n"), t).alias("chunk"))


_WORDS = ["水箱", "culvert", "检索器", "parapet"]


@query("X07_X10_chunk_search", f"""with q as (select unnest({_WORDS!r}) as query), h as (select query, chunk_id as key, max(round(length(query) / length(t), 6)) as score from q join (select chunk_id, lower({T % 'text'}) as t from doc_101_labeled where chunk_id is not null) on contains(t, query) group by 1, 2)
    select query, key, score from h qualify row_number() over (partition by query order by score desc, key) <= 10""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter("chunk_id is not null")
    return G.named_like(questions(spark, _WORDS).select("query"), h, "text", F.col("chunk_id"), 10)


@query("X14_M02_keywords", f"select row_id, len(list_filter(string_split(keywords, ','), lambda x: {T % 'x'} <> '')) as n_high, cast(0 as bigint) as n_low from relations where keywords is not null")
def _(spark, d):
    reply = F.concat(F.lit('```json\n{"high_level": '), F.to_json(F.split("keywords", ",")), F.lit(', "low_level": "none",}\n```'))
    fixed = X.repaired_json(reply)
    return table(spark, d, "relations").filter("keywords is not null").select("row_id", F.size(keywords_of(fixed, "high_level")).cast("bigint").alias("n_high"), F.size(keywords_of(fixed, "low_level")).cast("bigint").alias("n_low"))


@query("X21_cross_modal", """with e as (select vec_id as id, label, cast(embedding as double[]) as v from embeddings), s as (select q.id as query_id, e.id, case when e.label < 5 then 'text' else 'image' end as kind, round(list_dot_product(q.v, e.v), 6) + 0.0 as score from e q, e where q.id % 20 = 0)
    select query_id, kind, id, score from s qualify row_number() over (partition by query_id, kind order by score desc, id) <= case when kind = 'text' then 10 else 5 end""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("bigint").alias("grp"))
    q = e.filter("id % 20 = 0")
    part = lambda cond, k, kind: V.nearest(q, e.filter(cond), k).select("query_id", F.lit(kind).alias("kind"), "id", "score")
    return part("grp < 5", 10, "text").unionByName(part("grp >= 5", 5, "image"))


@query("V10_label_distance", """with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), m as (select label, i, round(avg(x), 9) as x from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from e) group by 1, 2), c as (select label, list(x order by i) as cv from m group by 1)
    select vec_id, round(1 - list_cosine_similarity(v, cv), 6) as distance from e join c using (label)""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"), F.col("label").alias("grp"))
    c = V.centroids(e).withColumnRenamed("vec", "cvec")
    return e.join(c, "grp").select("vec_id", F.round(1 - V.similarity("cosine", F.col("vec"), F.col("cvec")), 6).alias("distance"))


@query("X27_resolved_scores", "select hit_id, round(coalesce(case when isnan(score) then null else score end, case type when 'positive' then 1.0 when 'negative' then 0.0 end), 6) as score from doc_101_labeled")
def _(spark, d):
    s = F.coalesce(F.nanvl("score", F.lit(None).cast("double")), F.when(F.col("type") == "positive", 1.0).when(F.col("type") == "negative", 0.0))
    return table(spark, d, "doc_101_labeled").select("hit_id", F.round(s, 6).alias("score"))


@query("X28_summaries", "select doc_id, regexp_extract(text, '^[^。.\\n]*') as summary from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", "^[^。.\\n]*", 0).alias("summary"))


@query("X31_answers", f"""with h as (select {T % 'query'} as query, chunk_id, max(score) as score, max(substr(text, 1, 80)) as text from doc_101_labeled where chunk_id is not null and score is not null and not isnan(score) and text is not null and {T % 'query'} <> '' group by 1, 2),
    r as (select *, row_number() over (partition by query order by score desc, chunk_id) as rank from h)
    select query, '问题：' || query || chr(10) || string_agg(text, chr(10) order by rank) as prompt, max(text) filter (rank = 1) as answer from r where rank <= 3 group by query""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").withColumn("query", strip("query"))
    h = h.filter("chunk_id is not null and score is not null and not isnan(score) and text is not null and query <> ''")
    h = h.groupBy("query", "chunk_id").agg(F.max("score").alias("score"), F.max(F.substring("text", 1, 80)).alias("text"))
    top = top_per_group(h, ["query"], [F.col("score").desc(), F.col("chunk_id")], 3)
    g = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    context = F.array_join(F.transform("c", lambda x: x["text"]), "\n")
    return g.select("query", F.concat(F.lit("问题："), "query", F.lit("\n"), context).alias("prompt"), F.element_at("c", 1)["text"].alias("answer"))


@query("X31_whole_answers", f"""with h as (select {T % 'query'} as query, chunk_id, max(score) as score, max(text) as text from doc_101_labeled where chunk_id is not null and score is not null and not isnan(score) and text is not null and {T % 'query'} <> '' group by 1, 2),
    r as (select *, row_number() over (partition by query order by score desc, chunk_id) as rank from h)
    select query, '问题：' || query || chr(10) || string_agg(text, chr(10) order by rank) as prompt, max(text) filter (rank = 1) as answer from r where rank <= 3 group by query""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").withColumn("query", strip("query"))
    h = h.filter("chunk_id is not null and score is not null and not isnan(score) and text is not null and query <> ''")
    h = h.groupBy("query", "chunk_id").agg(F.max("score").alias("score"), F.max("text").alias("text"))
    top = top_per_group(h, ["query"], [F.col("score").desc(), F.col("chunk_id")], 3)
    g = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    context = F.array_join(F.transform("c", lambda x: x["text"]), "\n")
    return g.select("query", F.concat(F.lit("问题："), "query", F.lit("\n"), context).alias("prompt"), F.element_at("c", 1)["text"].alias("answer"))


@query("X32_extracted_codes", "select distinct doc_id, unnest(regexp_extract_all(text, '[A-Z]{2}-[0-9]{5}')) as code from documents")
def _(spark, d):
    codes = F.regexp_extract_all("text", F.lit("([A-Z]{2}-[0-9]{5})"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.explode(codes).alias("code")).distinct()


@query("K03_saved_vectors_text", "select row_id, substr(coalesce(keywords, '') || chr(9) || coalesce(source_entity, '') || chr(9) || coalesce(target_entity, '') || chr(9) || coalesce(description, ''), 1, 4096) as text, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') as saved_at from relations")
def _(spark, d):
    parts = [x for c in ("keywords", "source_entity", "target_entity", "description") for x in (F.lit("\t"), F.coalesce(c, F.lit("")))][1:]
    return table(spark, d, "relations").select("row_id", F.substring(F.concat(*parts), 1, 4096).alias("text"), F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("saved_at"))


@query("K05_K20_append_and_replace", "select hit_id from doc_101_labeled where hit_id % 2 = 0 or hit_id % 3 = 0")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").select("hit_id")
    c = store.create("parquet", spark, f"{checkpoint_dir(spark)}/examples-{uuid.uuid4().hex}", "hit_id")
    c.insert(h.filter("hit_id % 2 = 0"))
    c.insert(h.filter("hit_id % 2 = 1 and hit_id % 3 = 0"))
    return c.rows()


@query("ST6_steps", f"with q as (select distinct {T % 'query'} as question from doc_101_labeled where {T % 'query'} <> '') select question, unnest(generate_series(1, 3)) as step, unnest(['route', 'retrieve', 'answer']) as node from q")
def _(spark, d):
    q = table(spark, d, "doc_101_labeled").select(strip("query").alias("question")).filter("question <> ''").distinct()
    steps = F.posexplode(F.array(F.lit("route"), F.lit("retrieve"), F.lit("answer"))).alias("step", "node")
    return q.select("question", steps).select("question", (F.col("step") + 1).cast("bigint").alias("step"), "node")


@query("ST7_D01_isolated_failures", "select row_id, created_at is not null and try_strptime(created_at, '%Y-%m-%d %H:%M:%S') is null as failed from entities")
def _(spark, d):
    ok = F.col("created_at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$") & F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    return table(spark, d, "entities").select("row_id", F.coalesce(F.col("created_at").isNotNull() & ~ok, F.lit(False)).alias("failed"))
