"""Queries of lexical search, the batch pipeline and evaluation (survey: X01, X02, X06, X22-X26, U06, J01, J02, J06, J07, A05-A16, K14, K15, K17, S14, S19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.fields import chunk_key, label_of
from cairn.functions.text import WHITE_SPACE, is_blank, strip
from cairn.operators import evaluation as E
from cairn.operators import lexical as L
from cairn.operators import pipeline as P
from cairn.operators import vectors as V
from cairn.operators.ranking import top_per_group
from cairn.operators.references import key_of
from cairn.plans.registry import registry
from cairn.plans.text import _PARTS
from cairn.sources.tables import questions, table

QUERIES, SQL, query = registry()
WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
T = f"trim(%s, {WS})"

# a stated set of queries that doesn't grow with the documents
_ASKED = ["水箱 焊接", "segment-count gateway", "检索器 缓存命中率", "corroded parapet", "养护 地下水位", "tombstones snapshots drift"]
_ASK = "ask as (select i - 1 as query_id, list_extract(%r, i) as query from generate_series(1, %d) g(i))" % (_ASKED, len(_ASKED))
_TERMS = "regexp_extract_all(lower(%s), '([a-z0-9]+|[\\x{4e00}-\\x{9fff}])', 1)"


def _bm25(table_: str, id_: str, text: str, name: str = "scores") -> str:
    return f"""{name}_t as (select {id_} as id, coalesce({_TERMS % text}, []) as terms from {table_}),
    {name}_a as (select distinct query_id, unnest({_TERMS % 'query'}) as term from ask),
    {name}_n as (select count(*) as n, avg(len(terms)) as avg_len from {name}_t),
    {name}_f as (select id, len, term, count(*) as tf from (select id, len(terms) as len, unnest(terms) as term from {name}_t) where term in (select term from {name}_a) group by 1, 2, 3),
    {name}_d as (select term, count(*) as df from {name}_f group by 1),
    {name} as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) as score
        from {name}_f join {name}_d using (term) join {name}_a using (term), {name}_n group by 1, 2)"""


_RANK = "select query_id, id, score, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from %s qualify row_number() over (partition by query_id order by score desc, id) <= %d"


def _asked(spark):
    return questions(spark, _ASKED)


@query("X01_X02_bm25", f"with {_ASK}, {_bm25('documents', 'doc_id', 'text')} {_RANK % ('scores', 20)}")
def _(spark, d):
    counts = L.term_counts(_asked(spark), table(spark, d, "documents"), "doc_id", "text")
    return L.best(L.bm25(_asked(spark), counts), 20)


@query("X01_boosted_fields", f"""with {_ASK}, {_bm25('entities', 'row_id', 'entity_name', 'a')}, {_bm25('entities', 'row_id', 'description', 'b')},
    s as (select query_id, id, round(max(score), 6) as score from (select query_id, id, score * 3.0 as score from a union all select * from b) group by 1, 2) {_RANK % ('s', 10)}""")
def _(spark, d):
    return L.best(L.multi_field(_asked(spark), table(spark, d, "entities"), "row_id", {"entity_name": 3.0, "description": 1.0}), 10)


@query("X01_exact_term", "select row_id, entity_name from entities where entity_type = '材料'")
def _(spark, d):
    return table(spark, d, "entities").filter("entity_type = '材料'").select("row_id", "entity_name")


@query("X06_hybrid", f"""with {_ASK}, {_bm25('documents', 'doc_id', 'text')}, top as (select query_id, max(score) as m from scores group by 1),
    dense as (select query_id, doc_id as id, round(len(list_intersect(list_distinct({_TERMS % 'query'}), list_distinct({_TERMS % "coalesce(text, '')"}))) / len(list_distinct({_TERMS % 'query'})), 6) as score from ask, documents),
    f as (select query_id, id, round(0.7 * dense.score + 0.3 * round(coalesce(scores.score, 0) / m, 6), 6) as score from dense left join scores using (query_id, id) join top using (query_id) where dense.score > 0) {_RANK % ('f', 10)}""")
def _(spark, d):
    counts = L.term_counts(_asked(spark), table(spark, d, "documents"), "doc_id", "text")
    sparse = L.bm25(_asked(spark), counts)
    top = sparse.groupBy("query_id").agg(F.max("score").alias("m"))
    dense = L.matched_share(_asked(spark), counts).withColumnRenamed("score", "dense")
    f = dense.join(sparse, ["query_id", "id"], "left").join(top, "query_id")
    s = F.round(0.7 * F.col("dense") + 0.3 * F.round(F.coalesce("score", F.lit(0.0)) / F.col("m"), 6), 6)
    return L.best(f.select("query_id", "id", s.alias("score")), 10)


# the vector of the i-th asked text is the one with id 20 i, since no model is called here; doc_id names the vector of a document
@query("X06_dense_and_sparse", f"""with {_ASK}, {_bm25('documents', 'doc_id', 'text')}, top as (select query_id, max(score) as m from scores group by 1),
    e as (select vec_id, cast(embedding as double[]) as v from embeddings),
    dense as (select query_id, doc_id as id, round(list_dot_product(q.v, e.v), 6) + 0.0 as dense from ask join e q on q.vec_id = query_id * 20, documents join e on doc_id = e.vec_id),
    f as (select query_id, id, round(0.7 * coalesce(dense, 0) + 0.3 * coalesce(score / m, 0), 6) as score from dense full join scores using (query_id, id) left join top using (query_id)) {_RANK % ('f', 10)}""")
def _(spark, d):
    docs = table(spark, d, "documents")
    e = table(spark, d, "embeddings").filter("embedding is not null")
    asked = _asked(spark).join(e, F.col("vec_id") == F.col("query_id") * 20).select("query_id", F.col("embedding").alias("qvec"))
    held = docs.select(F.col("doc_id").alias("id")).join(e, F.col("id") == F.col("vec_id"))
    dense = held.join(asked).select("query_id", "id", F.round(V.dot(F.col("qvec"), F.col("embedding")), 6).alias("dense"))
    sparse = L.bm25(_asked(spark), L.term_counts(_asked(spark), docs, "doc_id", "text"))
    top = sparse.groupBy("query_id").agg(F.max("score").alias("m"))
    f = dense.join(sparse, ["query_id", "id"], "full").join(top, "query_id", "left")
    s = F.round(0.7 * F.coalesce("dense", F.lit(0.0)) + 0.3 * F.coalesce(F.col("score") / F.col("m"), F.lit(0.0)), 6)
    return L.best(f.select("query_id", "id", s.alias("score")), 10)


@query("U06_waterfall", f"""with h as (select {T % 'query'} as query, chunk_id, max(score) as score from doc_101_labeled where chunk_id is not null and score is not null and not isnan(score) and {T % 'query'} <> '' group by 1, 2),
    strong as (select * from h where score >= 0.6), few as (select query from (select distinct query from h) left join (select query, count(*) as n from strong group by 1) using (query) where coalesce(n, 0) < 3)
    select query, chunk_id, score, 'first' as stage from strong union all select query, chunk_id, score, 'second' from h where score < 0.6 and query in (select query from few)""")
def _(spark, d):
    return P.waterfall(P.best_hits(table(spark, d, "doc_101_labeled")), 0.6, 3)


_HITS = f"""hits as (select {T % 'query'} as query, chunk_id, max(score) as score, max(case when type = 'positive' then 1 else 0 end) as rel from doc_101_labeled
        where chunk_id is not null and score is not null and not isnan(score) and {T % 'query'} <> '' group by 1, 2),
    ranked as (select *, row_number() over (partition by query order by score desc, chunk_id) as rank from hits),
    tot as (select query, sum(rel) as n_rel from hits group by 1),
    m as (select query, sum(rel) as hits, max(rel / rank) as rr, sum(rel / log2(rank + 1.0)) as dcg, sum(rel * seen / rank) as ap
        from (select *, sum(rel) over (partition by query order by rank rows unbounded preceding) as seen from ranked where rank <= 10) group by 1),
    metrics as (select query, round(hits / 10.0, 6) as precision, case when n_rel > 0 then round(hits / n_rel, 6) end as recall, round(rr, 6) as reciprocal_rank,
        case when n_rel > 0 then round(dcg / list_sum(list_transform(generate_series(1, least(n_rel, 10)::bigint), lambda i: 1 / log2(i + 1.0))), 6) end as ndcg,
        case when n_rel > 0 then round(ap / least(n_rel, 10), 6) end as average_precision from tot join m using (query))"""


def _metrics(spark, d):
    hits = P.best_hits(table(spark, d, "doc_101_labeled"))
    ranked = top_per_group(hits, ["query"], [F.col("score").desc(), F.col("chunk_id")], 10)
    return E.ranked_metrics(ranked, hits.groupBy("query").agg(F.sum("rel").alias("n_rel")), 10)


@query("A12_A13_ranked_metrics", f"with {_HITS} select * from metrics")
def _(spark, d):
    return _metrics(spark, d)


_NAMES = ["precision", "recall", "reciprocal_rank", "ndcg", "average_precision"]
_MEANS = "means as (" + " union all ".join(f"select '{n}' as metric, round(avg({n}), 6) as mean, round(stddev_pop({n}), 6) as deviation, count({n}) as n from metrics" for n in _NAMES) + ")"


@query("A10_A11_metric_means", f"with {_HITS}, {_MEANS} select * from means")
def _(spark, d):
    return E.means(_metrics(spark, d), _NAMES)


@query("A14_verdicts", f"with {_HITS}, {_MEANS} select metric, mean, case when mean >= 0.7 then 'good' else 'needs work' end as verdict from means")
def _(spark, d):
    return E.verdicts(E.means(_metrics(spark, d), _NAMES))


@query("A15_ab_split", "select user_id % 2 as arm, count(*) as n, round(avg(value), 6) as mean_value, cast(count_if(user_id % 10 = 0) as bigint) as n_canary from events group by 1")
def _(spark, d):
    e = table(spark, d, "events").groupBy((F.col("user_id") % 2).alias("arm"))
    return e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.col("user_id") % 10 == 0).alias("n_canary"))


@query("A16_session_metrics", """with s as (select user_id, count(*) as turns, max(case when event_type = 'purchase' then 1 else 0 end) as resolved, avg(value) as satisfaction from events group by 1)
    select count(*) as sessions, round(avg(turns), 6) as mean_turns, round(avg(resolved), 6) as resolution_rate, round(avg(satisfaction), 6) as satisfaction from s""")
def _(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("turns"), F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("resolved"), F.avg("value").alias("satisfaction"))
    return s.agg(F.count("*").alias("sessions"), F.round(F.avg("turns"), 6).alias("mean_turns"), F.round(F.avg("resolved"), 6).alias("resolution_rate"), F.round(F.avg("satisfaction"), 6).alias("satisfaction"))


@query("A21_phrase_check", "select doc_id, case when text is not null then contains(text, '编号') and not contains(text, '待复核') end as ok from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", E.phrase_check(F.col("text"), ["编号"], ["待复核"]).alias("ok"))


_OV = lambda a, b: f"case when len(list_distinct({_TERMS % a})) = 0 or {a} is null then 0.0 else round(len(list_intersect(list_distinct({_TERMS % a}), list_distinct({_TERMS % f'coalesce({b}, chr(32))'}))) / len(list_distinct({_TERMS % a})), 6) end"


@query("X26_judge_metrics", f"""select hit_id, {_OV('headers_norm', 'text')} as faithfulness, {_OV('query', 'headers_norm')} as relevancy, {_OV('text', 'content')} as context_precision, {_OV('content', 'text')} as context_recall from doc_101_labeled""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled")
    return E.judged(h, "query", "headers_norm", "text", "content").select("hit_id", "faithfulness", "relevancy", "context_precision", "context_recall")


@query("J02_content_lookup", f"""with c as (select document_id, page_idx, regexp_extract(chunk_id, '^(.*)-(-?[0-9]+)-([0-9]+)$', 3) as idx, max(content) as found from doc_101_labeled where chunk_id is not null and {T % 'content'} <> '' group by 1, 2, 3)
    select hit_id, found from doc_101_labeled h left join c on h.document_id = c.document_id and h.page_idx = c.page_idx and regexp_extract(h.chunk_id, '^(.*)-(-?[0-9]+)-([0-9]+)$', 3) = c.idx""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled")
    return P.looked_up(h.select("hit_id", "document_id", "page_idx", chunk_key("chunk_id")["chunk_index"].alias("idx")), h.select("document_id", "page_idx", chunk_key("chunk_id")["chunk_index"].alias("idx"), "content"), ["document_id", "page_idx", "idx"], "content").select("hit_id", F.col("content").alias("found"))


@query("J01_parent_texts", f"""with h as (select {T % 'query'} as query, document_id, max(score) as score from doc_101_labeled where document_id is not null and score is not null and not isnan(score) and {T % 'query'} <> '' group by 1, 2)
    select query, document_id, score, cast(row_number() over (partition by query order by score desc, document_id) as integer) as rank from h qualify row_number() over (partition by query order by score desc, document_id) <= 5""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").withColumn("query", strip("query"))
    h = h.filter("document_id is not null and score is not null and not isnan(score) and query <> ''")
    parents = h.groupBy("query", "document_id").agg(F.max("score").alias("score"))
    return top_per_group(parents, ["query"], [F.col("score").desc(), F.col("document_id")], 5)


@query("J01_whole_parents", f"""with h as (select {T % 'query'} as query, document_id, max(score) as score from doc_101_labeled where document_id is not null and score is not null and not isnan(score) and {T % 'query'} <> '' group by 1, 2),
    r as (select *, cast(row_number() over (partition by query order by score desc, document_id) as integer) as rank from h qualify row_number() over (partition by query order by score desc, document_id) <= 5)
    select query, document_id, score, rank, part, body from r join {_PARTS} using (document_id)""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled")
    return QUERIES["J01_parent_texts"](spark, d).join(P.document_parts(h), "document_id")


@query("J06_skip_processed", f"select row_id from entities where lower({T % 'entity_id'}) not in (select lower({T % 'entity_id'}) from entity_index where {T % 'entity_id'} <> '') and {T % 'entity_id'} <> ''")
def _(spark, d):
    done = table(spark, d, "entity_index").filter(~is_blank("entity_id")).select(key_of("entity_id").alias("k"))
    return table(spark, d, "entities").filter(~is_blank("entity_id")).withColumn("k", key_of("entity_id")).join(done, "k", "left_anti").select("row_id")


@query("J07_allow_list", "select row_id from entities where document_id in (select document_id from kg_metadata where status = 'completed')")
def _(spark, d):
    ok = table(spark, d, "kg_metadata").filter("status = 'completed'").select("document_id")
    return table(spark, d, "entities").join(ok, "document_id", "left_semi").select("row_id")


@query("K17_manifest", """with old as (select distinct document_id, 'stored' as origin from kg_metadata where document_id is not null),
    new as (select distinct document_id from entities where document_id is not null and document_id not in (select document_id from old))
    select * from old union all select document_id, 'new' from new""")
def _(spark, d):
    old = table(spark, d, "kg_metadata").filter("document_id is not null").select("document_id").distinct().withColumn("origin", F.lit("stored"))
    new = table(spark, d, "entities").filter("document_id is not null").select("document_id").distinct().withColumn("origin", F.lit("new"))
    return P.manifest(old, new, "document_id")


@query("A05_A06_label_counts", """select document_id, count(*) as n, cast(count_if(type = 'positive') as bigint) as n_positive, cast(count_if(type = 'negative') as bigint) as n_negative, cast(count_if(coalesce(type, '') not in ('positive', 'negative')) as bigint) as n_unknown from doc_101_labeled group by 1""")
def _(spark, d):
    t = F.coalesce("type", F.lit(""))
    return table(spark, d, "doc_101_labeled").groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(t == "positive").alias("n_positive"), F.count_if(t == "negative").alias("n_negative"), F.count_if(~t.isin("positive", "negative")).alias("n_unknown"))


@query("A09_outcomes", "select status, count(*) as n, cast(sum(entity_count) as bigint) as n_entities from (select distinct * from kg_metadata) group by 1")
def _(spark, d):
    return table(spark, d, "kg_metadata").distinct().groupBy("status").agg(F.count("*").alias("n"), F.sum("entity_count").alias("n_entities"))


@query("X25_labelled_rows", f"""select hit_id, coalesce(case when contains(lower(type), 'positive') then 'positive' when contains(lower(type), 'negative') then 'negative' end, 'unknown') as label, length(substr(content, 1, 2500)) as n_chars from doc_101_labeled where {T % 'query'} <> '' and {T % 'content'} <> ''""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter(~is_blank("query") & ~is_blank("content"))
    return h.select("hit_id", F.coalesce(label_of("type"), F.lit("unknown")).alias("label"), F.length(F.substring("content", 1, 2500)).cast("bigint").alias("n_chars"))


@query("X24_stages", f"select hit_id, case when stage in ('地下结构', '地上结构', '桩基施工', '装修收尾', '机电安装', '园林道路', '场地平整') then stage else '地上结构' end as stage from doc_101_labeled")
def _(spark, d):
    known = ["地下结构", "地上结构", "桩基施工", "装修收尾", "机电安装", "园林道路", "场地平整"]
    return table(spark, d, "doc_101_labeled").select("hit_id", P.one_of(F.col("stage"), known, "地上结构").alias("stage"))


@query("X22_stage_search", f"""with h as (select {T % 'query'} as query, stage, chunk_id, max(score) as score from doc_101_labeled where chunk_id is not null and stage is not null and score is not null and not isnan(score) and {T % 'query'} <> '' group by 1, 2, 3)
    select query, stage, chunk_id, score, cast(row_number() over (partition by query, stage order by score desc, chunk_id) as integer) as rank from h qualify row_number() over (partition by query, stage order by score desc, chunk_id) <= 10""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").withColumn("query", strip("query"))
    h = h.filter("chunk_id is not null and stage is not null and score is not null and not isnan(score) and query <> ''")
    return top_per_group(h.groupBy("query", "stage", "chunk_id").agg(F.max("score").alias("score")), ["query", "stage"], [F.col("score").desc(), F.col("chunk_id")], 10)


@query("X23_query_chunk_rows", f"select distinct {T % 'query'} as query, text as chunk from doc_101_labeled where {T % 'query'} <> '' and {T % 'text'} <> ''")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter(~is_blank("query") & ~is_blank("text"))
    return h.select(strip("query").alias("query"), F.col("text").alias("chunk")).distinct()


@query("S14_T06_latest_files", "select doc_id, source, project_code from documents where source = 'ops_runbook' and project_code is not null order by doc_id desc limit 50")
def _(spark, d):
    return table(spark, d, "documents").filter("source = 'ops_runbook' and project_code is not null").orderBy(F.col("doc_id").desc()).limit(50).select("doc_id", "source", "project_code")


@query("S10_W04_first_per_folder", "select project_code, min(doc_id) as doc_id from documents where project_code is not null and text is not null group by 1")
def _(spark, d):
    return table(spark, d, "documents").filter("project_code is not null and text is not null").groupBy("project_code").agg(F.min("doc_id").alias("doc_id"))


@query("S15_by_document", "select d.document_id, count(*) as n from (select distinct document_id from kg_metadata where namespace = 'tower_north') d join relations r on r.document_id = d.document_id group by 1")
def _(spark, d):
    ids = table(spark, d, "kg_metadata").filter("namespace = 'tower_north'").select("document_id")
    return table(spark, d, "relations").join(ids, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("n"))


@query("A20_tables_per_document", f"""select document_id, count(*) as n_tables, cast(sum(length(coalesce(nullif({T % 'content'}, ''), text))) as bigint) as n_chars from (select distinct document_id, chunk_id, content, text from doc_101_labeled where chunk_id is not null) group by 1""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter("chunk_id is not null").select("document_id", "chunk_id", "content", "text").distinct()
    return h.groupBy("document_id").agg(F.count("*").alias("n_tables"), F.sum(F.length(F.coalesce(F.nullif(strip("content"), F.lit("")), "text"))).alias("n_chars"))


@query("J08_factor_match", f"""with f as (select distinct regexp_replace({T % 'entity_name'}, '[ \\t\\n\\r:：、,，。;；()（）\\-]+', '', 'g') as factor from seed_entities)
    select factor, count(*) as n_chunks from (select distinct chunk_id, regexp_replace(text, '[ \\t\\n\\r:：、,，。;；()（）\\-]+', '', 'g') as t from doc_101_labeled where chunk_id is not null) join f on contains(t, factor) group by 1""")
def _(spark, d):
    bare = lambda c: F.regexp_replace(c, r"[ \t\n\r:：、,，。;；()（）\-]+", "")
    f = table(spark, d, "seed_entities").select(bare(strip("entity_name")).alias("factor")).distinct()
    c = table(spark, d, "doc_101_labeled").filter("chunk_id is not null").select("chunk_id", bare(F.col("text")).alias("t")).distinct()
    return P.containing(c, "t", f, "factor").groupBy("factor").agg(F.count("*").alias("n_chunks"))
