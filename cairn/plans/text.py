"""Queries of the text, key and parsing rules (survey 2.9 and 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import fields as X
from cairn.functions.text import WHITE_SPACE, strip
from cairn.plans.registry import registry
from cairn.sources.tables import table

QUERIES, SQL, query = registry()
WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
T = f"trim(%s, {WS})"


@query("F06_entity_ids", "select row_id, 'ent-' || substr(md5(entity_name), 1, 16) as ent_id from entities")
def _(spark, d):
    return table(spark, d, "entities").select("row_id", X.content_id("ent-", "entity_name").alias("ent_id"))


@query("F06_relation_ids", "select row_id, 'rel-' || substr(md5(source_entity || '|' || target_entity || '|' || relation_type), 1, 16) as rel_id from relations")
def _(spark, d):
    return table(spark, d, "relations").select("row_id", X.content_id("rel-", "source_entity", "target_entity", "relation_type").alias("rel_id"))


@query("F06_chunk_ids", "select doc_id, 'chunk-' || substr(md5(text), 1, 16) as chunk_key from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_id("chunk-", "text").alias("chunk_key"))


@query("F04_F05_limits", """select row_id,
    case when length(description) > 256 then substr(description, 1, 253) || '...' else description end as description_256,
    case when length(entity_name) > 128 then substr(entity_name, 1, 125) || '...' else entity_name end as name_128,
    substr(entity_type, 1, 32) as type_32 from entities""")
def _(spark, d):
    e = table(spark, d, "entities")
    return e.select("row_id", X.ellipsized("description", 256).alias("description_256"), X.ellipsized("entity_name", 128).alias("name_128"), F.substring("entity_type", 1, 32).alias("type_32"))


@query("F01_clean_attribute", f"""select row_id, trim(trim({T % 'source_entity'}, '"'), '''') as source_clean from relations""")
def _(spark, d):
    return table(spark, d, "relations").select("row_id", X.clean_attribute("source_entity").alias("source_clean"))


_SPACES = "[ \\t\\n\\r\\x0B\\f\\x{00A0}\\x{3000}]"
_NAMES = "case s " + " ".join(f"when '{k}' then '{v}'" for k, v in X.HEADER_NAMES.items()) + " else s end"


@query("F07_normal_headers", f"""with h as (select distinct unnest(string_split(headers_norm, '|')) as header from doc_101_labeled),
    n as (select header, lower(translate(regexp_replace({T % 'header'}, '{_SPACES}+', ' ', 'g'), '：（）', ':()')) as s from h)
    select header, {_NAMES} as normal from n""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").select(F.explode(F.split("headers_norm", r"\|")).alias("header")).distinct()
    return h.select("header", X.normal_header("header").alias("normal"))


@query("F08_canonical_names", f"""select row_id, regexp_replace({T % 'entity_name'}, '[ \\t\\n\\r\\x0B\\f\\x{{00A0}}\\x{{3000}}:：、,，。;；()（）\\-]+', '', 'g') as name_key from entities""")
def _(spark, d):
    return table(spark, d, "entities").select("row_id", X.canonical("entity_name").alias("name_key"))


@query("F11_chunk_text_body", f"""select hit_id, {T % "regexp_replace(regexp_replace(text, '^【[^】]+】[ \\t\\n\\r]*', ''), '^第[0-9]+页表格[ \\t\\n\\r]*', '')"} as body from doc_101_labeled""")
def _(spark, d):
    return table(spark, d, "doc_101_labeled").select("hit_id", X.without_prefix("text").alias("body"))


@query("F12_without_headings", f"""select hit_id, {T % f"array_to_string(list_filter(string_split(content, chr(10)), lambda x: not starts_with({T % 'x'}, '##')), chr(10))"} as body from doc_101_labeled""")
def _(spark, d):
    return table(spark, d, "doc_101_labeled").select("hit_id", X.without_headings("content").alias("body"))


_CELL = f"trim(trim({T % "regexp_replace(c, '(?i)(<br[ \\t]*/?>)+', '', 'g')"}, '-'), '|')"
_EMPTY = f"len(list_filter(string_split(trim({T % 'x'}, '|'), '|'), lambda c: {T % _CELL} <> '')) = 0"
_KEPT = f"list_filter(string_split(content, chr(10)), lambda x: {T % 'x'} <> '' and (not starts_with({T % 'x'}, '|') or regexp_matches({T % 'x'}, '{X.RULE_ROW}') or not ({_EMPTY})))"


@query("F10_F13_clean_tables", f"""with k as (select hit_id, {_KEPT} as kept from doc_101_labeled), r as (select *, list_transform(kept, lambda x: regexp_matches({T % 'x'}, '{X.RULE_ROW}')) as rule from k)
    select hit_id, array_to_string(list_filter(kept, lambda x, i: not rule[i] or i = list_position(rule, true)), chr(10)) as cleaned from r""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled")
    return h.select("hit_id", X.first_rule_only(X.clean_table("content")).alias("cleaned"))


@query("F14_keyword_union", f"""with k as (select source_entity, target_entity, {T % 'unnest(string_split(keywords, chr(44)))'} as kw from relations)
    select source_entity, target_entity, array_to_string(list_sort(list(distinct kw)), ',') as keywords from k where kw <> '' group by all""")
def _(spark, d):
    r = table(spark, d, "relations").select("source_entity", "target_entity", F.explode(X.keyword_list("keywords")).alias("kw"))
    return r.groupBy("source_entity", "target_entity").agg(F.array_join(F.array_sort(F.collect_set("kw")), ",").alias("keywords"))


@query("F15_chunk_keys", """select hit_id, nullif(regexp_extract(chunk_id, '^(.*)-(-?[0-9]+)-([0-9]+)$', 1), '') as doc,
    cast(nullif(regexp_extract(chunk_id, '^(.*)-(-?[0-9]+)-([0-9]+)$', 2), '') as bigint) as page,
    cast(nullif(regexp_extract(chunk_id, '^(.*)-(-?[0-9]+)-([0-9]+)$', 3), '') as bigint) as idx from doc_101_labeled""")
def _(spark, d):
    k = X.chunk_key("chunk_id")
    return table(spark, d, "doc_101_labeled").select("hit_id", k["document_id"].alias("doc"), k["page_idx"].alias("page"), k["chunk_index"].alias("idx"))


@query("F16_build_chunk_ids", "select hit_id, substr(document_id || '-' || page_idx || '-' || hit_id, 1, 64) as built from doc_101_labeled")
def _(spark, d):
    return table(spark, d, "doc_101_labeled").select("hit_id", F.substring(F.concat("document_id", F.lit("-"), F.col("page_idx").cast("string"), F.lit("-"), F.col("hit_id").cast("string")), 1, 64).alias("built"))


@query("F18_word_counts", f"""select doc_id, case when coalesce(length({T % 'text'}), 0) = 0 then 0
    else len(regexp_split_to_array({T % 'text'}, '{_SPACES}+')) end as n_words from documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count("text").alias("n_words"))


@query("F17_previews", "select doc_id, case when length(text) > 400 then substr(text, 1, 400) || '...' else text end as preview from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview("text").alias("preview"))


@query("F20_embedding_text", """select row_id, entity_name || chr(10) || coalesce(description, '') as embedding_text from entities""")
def _(spark, d):
    return table(spark, d, "entities").select("row_id", F.concat("entity_name", F.lit("\n"), F.coalesce("description", F.lit(""))).alias("embedding_text"))


@query("F19_query_text", f"select distinct stage || ' ' || {T % 'query'} as query_text from doc_101_labeled where stage is not null and {T % 'query'} <> ''")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").select(F.concat("stage", F.lit(" "), strip("query")).alias("query_text"), strip("query").alias("q"))
    return h.filter("q <> '' and query_text is not null").select("query_text").distinct()


@query("F24_citation_context", f"""with q as (select {T % 'query'} as query, chunk_id, max(score) as score, max(source_file) as source from doc_101_labeled
        where chunk_id is not null and score is not null and not isnan(score) and {T % 'query'} <> '' group by 1, 2),
    r as (select *, row_number() over (partition by query order by score desc, chunk_id) as i from q)
    select query, string_agg('[文档' || i || '] ' || chunk_id || chr(10) || '来源：' || coalesce(source, '未知'), chr(10) || chr(10) order by i) as context from r where i <= 3 group by query""")
def _(spark, d):
    from cairn.operators.ranking import top_per_group

    h = table(spark, d, "doc_101_labeled").withColumn("query", strip("query"))
    h = h.filter("chunk_id is not null and score is not null and not isnan(score) and query <> ''")
    q = h.groupBy("query", "chunk_id").agg(F.max("score").alias("score"), F.max("source_file").alias("source"))
    top = top_per_group(q, ["query"], [F.col("score").desc(), F.col("chunk_id")], 3, "i")
    line = F.concat(F.lit("[文档"), F.col("i").cast("string"), F.lit("] "), "chunk_id", F.lit("\n来源："), F.coalesce("source", F.lit("未知")))
    parts = F.array_sort(F.collect_list(F.struct("i", line.alias("line"))))
    return top.groupBy("query").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("context"))


@query("F25_joined_pages", """select document_id, string_agg(body, chr(10) || chr(10) order by chunk_id) as body from (select distinct document_id, chunk_id, substr(text, 1, 40) as body
    from doc_101_labeled where chunk_id is not null and text is not null) group by document_id""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter("chunk_id is not null and text is not null")
    h = h.select("document_id", "chunk_id", F.substring("text", 1, 40).alias("body")).distinct()
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "body")))
    return h.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x["body"]), "\n\n").alias("body"))


_PARTS = r"""(select document_id, greatest(page // 8, 0) as part, string_agg(text, chr(10) || chr(10) order by page, idx, chunk_id, text) as body from
        (select *, coalesce(try_cast(regexp_extract(chunk_id, '^(.*)-(-?[0-9]+)-([0-9]+)$', 2) as bigint), -1) as page, coalesce(try_cast(regexp_extract(chunk_id, '^(.*)-(-?[0-9]+)-([0-9]+)$', 3) as bigint), -1) as idx
         from (select distinct document_id, chunk_id, text from doc_101_labeled where chunk_id is not null and text is not null)) group by 1, 2)"""


@query("F25_whole_texts", f"select document_id, part, body from {_PARTS}")
def _(spark, d):
    from cairn.operators.pipeline import document_parts

    return document_parts(table(spark, d, "doc_101_labeled"))


@query("F24_cited_texts", f"""with q as (select {T % 'query'} as query, chunk_id, max(score) as score, max(source_file) as source, coalesce(max(text), '') as text from doc_101_labeled
        where chunk_id is not null and score is not null and not isnan(score) and {T % 'query'} <> '' group by 1, 2),
    r as (select *, row_number() over (partition by query order by score desc, chunk_id) as i from q)
    select query, string_agg('[文档' || i || '] ' || text || chr(10) || '来源：' || coalesce(source, '未知'), chr(10) || chr(10) order by i) as context from r where i <= 3 group by query""")
def _(spark, d):
    from cairn.operators.ranking import top_per_group

    h = table(spark, d, "doc_101_labeled").withColumn("query", strip("query"))
    h = h.filter("chunk_id is not null and score is not null and not isnan(score) and query <> ''")
    q = h.groupBy("query", "chunk_id").agg(F.max("score").alias("score"), F.max("source_file").alias("source"), F.coalesce(F.max("text"), F.lit("")).alias("text"))
    top = top_per_group(q, ["query"], [F.col("score").desc(), F.col("chunk_id")], 3, "i")
    line = F.concat(F.lit("[文档"), F.col("i").cast("string"), F.lit("] "), "text", F.lit("\n来源："), F.coalesce("source", F.lit("未知")))
    parts = F.array_sort(F.collect_list(F.struct("i", line.alias("line"))))
    return top.groupBy("query").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("context"))


@query("F26_row_sentences", "select c_custkey, c_name || ' of segment ' || c_mktsegment || ' lives in nation ' || c_nationkey || '.' as sentence from customer")
def _(spark, d):
    s = F.concat("c_name", F.lit(" of segment "), "c_mktsegment", F.lit(" lives in nation "), F.col("c_nationkey").cast("string"), F.lit("."))
    return table(spark, d, "customer").select("c_custkey", s.alias("sentence"))


@query("F27_time_bound", "select hit_id, regexp_matches(query, '今天|最新|现在|today|latest|now') as web from doc_101_labeled")
def _(spark, d):
    return table(spark, d, "doc_101_labeled").select("hit_id", X.time_bound("query").alias("web"))


@query("F22_F23_labels", """select hit_id, case when contains(lower(type), 'positive') then 'positive' when contains(lower(type), 'negative') then 'negative' end as label from doc_101_labeled""")
def _(spark, d):
    return table(spark, d, "doc_101_labeled").select("hit_id", X.label_of("type").alias("label"))


@query("F28_data_urls", "select row_id, 'data:text/plain;base64,' || base64(encode(entity_name)) as url from entities")
def _(spark, d):
    return table(spark, d, "entities").select("row_id", X.data_url("entity_name").alias("url"))


@query("F31_scores_in_text", """select doc_id, cast(nullif(regexp_extract(text, '置信分数[^0-9]{0,6}([0-9]+(?:\\.[0-9]+)?)', 1), '') as double) as confidence from documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.number_after("text", "置信分数").alias("confidence"))


@query("M01_M02_json_repair", """select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_type as kind from events""")
def _(spark, d):
    # a model's reply as it comes: prose around the object, comments, a trailing comma
    e = table(spark, d, "events")
    reply = F.concat(F.lit("Sure, here it is:\n"), F.regexp_replace("props", r"\}$", ""), F.lit(", /* kind */ \"kind\": \""), "event_type", F.lit("\", // last\n}\nDone."))
    parsed = F.from_json(X.repaired_json(reply), "k bigint, kind string")
    return e.select("event_id", parsed["k"].alias("k"), parsed["kind"].alias("kind"))


@query("M09_answer_stream", """select user_id, cast(cast(ts as date) as varchar) as day, string_agg(event_type, '' order by event_id) as answer from events group by all""")
def _(spark, d):
    from cairn.operators.replies import answers

    e = table(spark, d, "events")
    lines = e.select("user_id", F.col("ts").cast("date").cast("string").alias("day"), F.col("event_id").alias("n"), F.concat(F.lit('data: {"answer": "'), "event_type", F.lit('"}')).alias("line"))
    end = e.groupBy("user_id", F.col("ts").cast("date").cast("string").alias("day")).agg((F.max("event_id") + 1).alias("n")).withColumn("line", F.lit("data: [DONE]"))
    return answers(lines.unionByName(end), ["user_id", "day"])


@query("M06_records", f"""with e as (select row_id, 'entity' as kind, {T % 'entity_name'} as a, {T % 'entity_type'} as b, cast(null as double) as weight from entities
        where {T % 'entity_name'} <> '' and {T % 'entity_type'} <> '' and {T % 'description'} <> ''),
    r as (select row_id, 'relationship' as kind, {T % 'source_entity'} as a, {T % 'target_entity'} as b, weight from relations
        where {T % 'source_entity'} <> '' and {T % 'target_entity'} <> '' and {T % 'keywords'} <> '' and {T % 'relation_type'} <> '' and {T % 'source_entity'} <> {T % 'target_entity'})
    select row_id, kind, trim(trim(a, '"'), '''') as first, trim(trim(b, '"'), '''') as second, case when kind = 'entity' then null else coalesce(round(weight, 4), 1.0) end as weight from (select * from e union all select * from r)
    where row_id not in (select row_id from relations where kind = 'relationship' and regexp_matches(source_entity || target_entity || relation_type || keywords, '[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'))""")
def _(spark, d):
    from cairn.operators.replies import records

    e = table(spark, d, "entities").select("row_id", F.concat(F.lit('("entity"<|>'), "entity_name", F.lit("<|>"), "entity_type", F.lit("<|>x)<|COMPLETE|>")).alias("reply"), strip("description").alias("d"), strip("entity_name").alias("n"), strip("entity_type").alias("t"))
    e = e.filter("n <> '' and t <> '' and d <> ''").select("row_id", "reply")
    w = F.coalesce(F.round("weight", 4).cast("string"), F.lit("none"))
    r = table(spark, d, "relations").select("row_id", F.concat(F.lit('("relationship"<|>'), "source_entity", F.lit("<|>"), "target_entity", F.lit("<|>"), "relation_type", F.lit("<|>"), "keywords", F.lit("<|>"), w, F.lit(")##")).alias("reply"), strip("keywords").alias("k"), strip("relation_type").alias("t"))
    r = r.filter("k <> '' and t <> '' and reply is not null").select("row_id", "reply")
    return records(e.unionByName(r), "row_id").select("row_id", "kind", "first", "second", "weight")


@query("M11_headings", """with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
    select doc_id, cast(count_if(regexp_matches(line, '^#{1,4} ')) as bigint) as n_headings, cast(count_if(regexp_matches(line, '^[-*] ')) as bigint) as n_items, cast(count_if(contains(line, '**')) as bigint) as n_bold, count(*) as n_lines from l group by doc_id""")
def _(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    count = lambda p: F.count_if(p)
    return lines.groupBy("doc_id").agg(count(F.col("line").rlike("^#{1,4} ")).alias("n_headings"), count(F.col("line").rlike("^[-*] ")).alias("n_items"), count(F.col("line").contains("**")).alias("n_bold"), F.count("*").alias("n_lines"))


@query("F21_prompts", "select hit_id, '问题：' || query || chr(10) || '内容：' || substr(content, 1, 2500) || chr(10) || '只回答 positive 或 negative。' as prompt from doc_101_labeled")
def _(spark, d):
    from cairn.operators.replies import prompt

    h = table(spark, d, "doc_101_labeled").select("hit_id", "query", F.substring("content", 1, 2500).alias("content"))
    return h.select("hit_id", prompt("问题：{query}\n内容：{content}\n只回答 positive 或 negative。").alias("prompt"))
