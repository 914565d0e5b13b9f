"""Queries of projections, filters, files and small steps (survey: P01, P04, P05, P07, P14, J11, J13-J15, T02-T11, U06, U08, F03, F09, F22, F29, F31, M04, C06, K03, K13-K16, S11, S21, S22, X18-X20, X32, X33, ST3, ST4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.functions import fields as X
from cairn.functions.shared import checkpoint_dir
from cairn.functions.text import WHITE_SPACE, is_blank, strip
from cairn.operators import chunking as C
from cairn.operators import dialogue as D
from cairn.operators import lexical as L
from cairn.operators import lifecycle as Y
from cairn.operators import pipeline as P
from cairn.operators import replies as R
from cairn.operators import vectors as V
from cairn.operators.evaluation import overlap
from cairn.operators.ranking import top_per_group
from cairn.operators.references import key_of
from cairn.plans.operations import QUERIES as LOOP
from cairn.plans.operations import SQL as OPERATIONS
from cairn.plans.registry import registry
from cairn.plans.retrieval import _ASK, _bm25, _asked
from cairn.sources import files as S
from cairn.sources.tables import table

QUERIES, SQL, query = registry()
WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
T = f"trim(%s, {WS})"
K = f"lower(trim(%s, {WS}))"
_TERMS = "regexp_extract_all(lower(%s), '([a-z0-9]+|[\\x{4e00}-\\x{9fff}])', 1)"


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("P01_output_fields", "select hit_id, coalesce(stage, '') as stage, cast(null as varchar) as img_path, '' as caption from doc_101_labeled")
def _(spark, d):
    return P.projected(table(spark, d, "doc_101_labeled"), {"hit_id": None, "stage": "", "img_path": None, "caption": ""})


@query("P04_where", "select hit_id from doc_101_labeled where type = 'positive' and stage in ('地下结构', '桩基施工') and page_idx >= 3 and source_file is not null")
def _(spark, d):
    where = {"type": "positive", "stage": {"$in": ["地下结构", "桩基施工"]}, "page_idx": {"$gte": 3}, "source_file": {"$ne": None}}
    return P.matching(table(spark, d, "doc_101_labeled"), where).select("hit_id")


_E = "e as (select vec_id as id, label, cast(embedding as double[]) as v from embeddings), q as (select * from e where id % 20 = 0)"
_RANKED = "select query_id, id, score, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from"
_TOP = "qualify row_number() over (partition by query_id order by score desc, id) <= {k}"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(0).cast("bigint").alias("grp"))


# the documents whose rows a search may give are picked before it ranks
@query("P05_within_documents", f"with {_E}, s as (select q.id as query_id, e.id, round(list_dot_product(q.v, e.v), 6) + 0.0 as score from q, e where e.id in (select row_id from entities where document_id in (select document_id from kg_metadata where status = 'completed'))) {_RANKED} s {_TOP.format(k=10)}")
def _(spark, d):
    e = _vectors(spark, d)
    done = table(spark, d, "kg_metadata").filter("status = 'completed'").select("document_id")
    allowed = table(spark, d, "entities").join(done, "document_id", "left_semi").select(F.col("row_id").alias("id"))
    return V.nearest(e.filter("id % 20 = 0"), e.join(allowed, "id", "left_semi"), 10)


@query("P07_floor", f"with {_E}, s as (select q.id as query_id, e.id, round(list_dot_product(q.v, e.v), 6) + 0.0 as score from q, e) {_RANKED} s where score >= 0.001 {_TOP.format(k=25)}")
def _(spark, d):
    e = _vectors(spark, d)
    return V.nearest(e.filter("id % 20 = 0"), e, 25, least=0.001)


@query("T05_rerank_50_5", f"""with {_E}, s as (select q.id as query_id, e.id, round(list_dot_product(q.v[1:32], e.v[1:32]), 6) + 0.0 as s1, round(list_cosine_similarity(q.v, e.v), 6) as score from q, e),
    f as (select * from s qualify row_number() over (partition by query_id order by s1 desc, id) <= 50) {_RANKED} f {_TOP.format(k=5)}""")
def _(spark, d):
    e = _vectors(spark, d)
    q, half = e.filter("id % 20 = 0"), lambda df: df.withColumn("vec", F.slice("vec", 1, 32))
    both = V.nearest(half(q), half(e), 50).join(e.select("id", "vec"), "id").join(q.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), "query_id")
    return V.rerank(both, V.similarity("cosine", F.col("qvec"), F.col("vec")), 5).select("query_id", "id", "score", "rank")


@query("P14_blank_keywords", f"select row_id, len(list_filter(string_split(coalesce(keywords, ''), ','), lambda x: {T % 'x'} <> '')) as n from relations")
def _(spark, d):
    words = F.to_json(F.struct(F.split(F.coalesce("keywords", F.lit("")), ",").alias("w")))
    return table(spark, d, "relations").select("row_id", F.size(R.keywords_of(words, "w")).cast("bigint").alias("n"))


@query("J11_exists_check", f"select row_id, lower({T % 'entity_id'}) in (select lower({T % 'entity_id'}) from seed_entities where {T % 'entity_id'} <> '') as known from entities where {T % 'entity_id'} <> ''")
def _(spark, d):
    seeds = table(spark, d, "seed_entities").filter(~is_blank("entity_id")).select(key_of("entity_id").alias("k")).distinct().withColumn("known", F.lit(True))
    e = table(spark, d, "entities").filter(~is_blank("entity_id")).withColumn("k", key_of("entity_id"))
    return e.join(seeds, "k", "left").select("row_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("J14_manifest_merge", "select document_id, max(namespace) as namespace from kg_metadata where document_id is not null group by 1 union all select distinct document_id, cast(null as varchar) from relations where document_id is not null and document_id not in (select document_id from kg_metadata where document_id is not null)")
def _(spark, d):
    old = table(spark, d, "kg_metadata").filter("document_id is not null").groupBy("document_id").agg(F.max("namespace").alias("namespace"))
    new = table(spark, d, "relations").filter("document_id is not null").select("document_id").distinct().withColumn("namespace", F.lit(None).cast("string"))
    return P.manifest(old, new, "document_id")


@query("J15_positions", """with k as (select row_id, unnest(list_transform(string_split(keywords, ','), lambda x, i: {'w': x, 'i': i}), recursive := true) from relations),
    t as (select row_id, unnest(list_transform(string_split(description, ' '), lambda x, i: {'t': x, 'i': i}), recursive := true) from relations) select row_id, i as pos, w as keyword, t as word from k join t using (row_id, i)""")
def _(spark, d):
    pairs = F.arrays_zip(F.split("keywords", ",").alias("keyword"), F.split("description", " ").alias("word"))
    p = table(spark, d, "relations").select("row_id", F.posexplode(pairs).alias("pos", "p")).filter("p.keyword is not null and p.word is not null")
    return p.select("row_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "p.keyword", "p.word")


_BEST = f"h as (select {T % 'query'} as query, chunk_id, max(coalesce(case when isnan(score) then 0 else score end, 0)) as score from doc_101_labeled where chunk_id is not null and {T % 'query'} <> '' group by 1, 2)"


@query("T02_T03_T11_heads", f"with {_BEST} select query, chunk_id, score, cast(row_number() over (partition by query order by score desc, chunk_id) as integer) as rank from h qualify row_number() over (partition by query order by score desc, chunk_id) <= 5")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter(~is_blank("query") & F.col("chunk_id").isNotNull())
    h = h.groupBy(strip("query").alias("query"), "chunk_id").agg(F.max(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0))).alias("score"))
    return top_per_group(h, ["query"], [F.col("score").desc(), F.col("chunk_id")], 5)


@query("T07_page_order", "select chunk_id, document_id, row_number() over (partition by document_id order by page_idx, cast(regexp_extract(chunk_id, '([0-9]+)$', 1) as bigint), chunk_id) as place from (select distinct chunk_id, document_id, page_idx from doc_101_labeled where chunk_id is not null and document_id is not null and page_idx is not null)")
def _(spark, d):
    c = table(spark, d, "doc_101_labeled").filter("chunk_id is not null and document_id is not null and page_idx is not null").select("chunk_id", "document_id", "page_idx").distinct()
    order = [F.col("page_idx"), X.chunk_key("chunk_id")["chunk_index"], F.col("chunk_id")]
    return top_per_group(c, ["document_id"], order, 2**31 - 1, "place").select("chunk_id", "document_id", F.col("place").cast("bigint").alias("place"))


@query("T09_distinct_limit", f"select distinct source_chunk_id from entities where {T % 'source_chunk_id'} <> '' order by 1 limit 100")
def _(spark, d):
    return table(spark, d, "entities").filter(~is_blank("source_chunk_id")).select("source_chunk_id").distinct().orderBy("source_chunk_id").limit(100)


@query("T10_K16_preview", "select hit_id, chunk_id, case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as preview from doc_101_labeled order by hit_id limit 20")
def _(spark, d):
    return table(spark, d, "doc_101_labeled").orderBy("hit_id").limit(20).select("hit_id", "chunk_id", X.preview("text", 100).alias("preview"))


@query("K16_chunk_rows", "select distinct chunk_id, document_id, page_idx, stage from doc_101_labeled where chunk_id is not null and stage is not null")
def _(spark, d):
    at = _folder(spark, "rows")
    rows = table(spark, d, "doc_101_labeled").filter("chunk_id is not null and stage is not null").select("chunk_id", "document_id", "page_idx", "stage").distinct()
    S.write_csv(rows, at, bom=True)
    return S.read_csv(spark, at, "chunk_id string, document_id string, page_idx bigint, stage string")


@query("K14_K15_query_chunk_csv", f"select distinct {T % 'query'} as query, replace(text, chr(13), '') as chunk from doc_101_labeled where {T % 'query'} <> '' and {T % 'text'} <> ''")
def _(spark, d):
    at = _folder(spark, "pairs")
    h = table(spark, d, "doc_101_labeled").filter(~is_blank("query") & ~is_blank("text"))
    S.write_csv(h.select(strip("query").alias("query"), F.replace("text", F.lit("\r"), F.lit("")).alias("chunk")).distinct(), at, bom=True)
    return S.read_csv(spark, at, "query string, chunk string")


@query("K13_second_run", "select distinct document_id, chunk_id from doc_101_labeled where chunk_id is not null and document_id is not null")
def _(spark, d):
    at = _folder(spark, "runs")
    c = table(spark, d, "doc_101_labeled").filter("chunk_id is not null and document_id is not null").select("document_id", "chunk_id").distinct()
    first = c.join(c.filter("cast(document_id as bigint) % 2 = 0").select("document_id").distinct(), "document_id", "left_semi")
    first.write.partitionBy("document_id").json(at)
    # the second run leaves out what the first one wrote
    done = spark.read.json(at, schema="chunk_id string, document_id string").select("document_id").distinct()
    c.join(done, "document_id", "left_anti").write.mode("append").partitionBy("document_id").json(at)
    return spark.read.json(at, schema="chunk_id string, document_id string").select("document_id", "chunk_id")


@query("K03_saved_vectors", f"""with t as (select row_id, {_TERMS % "coalesce(entity_name, '')"} as w from entities), h as (select row_id, list_transform(w, lambda x: substr(md5(x), 1, 1)) as h from t)
    select row_id, array_to_string(list_transform(string_split('0123456789abcdef', ''), lambda c: cast(len(list_filter(h, lambda x: x = c)) as varchar)), ',') as vector from h""")
def _(spark, d):
    at = _folder(spark, "vectors")
    e = table(spark, d, "entities")
    e.select("row_id", V.hashed_words(L.terms("entity_name")).alias("vec")).write.parquet(at)
    saved = spark.read.parquet(at)
    return saved.select("row_id", F.array_join(F.transform("vec", lambda x: x.cast("bigint").cast("string")), ",").alias("vector"))


@query("S21_indexed_csv", f"select term, count(*) as df from (select distinct row_id, unnest({_TERMS % 'description'}) as term from entities) group by 1")
def _(spark, d):
    at = _folder(spark, "index")
    S.write_csv(table(spark, d, "entities").filter(~is_blank("description")).select("row_id", "description"), at)
    rows = S.read_csv(spark, at, "row_id bigint, description string")
    return rows.select("row_id", F.explode(L.terms("description")).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))


@query("S22_tab_separated", "select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderpriority end as priority, o_totalprice as price from orders")
def _(spark, d):
    at = _folder(spark, "tsv")
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_totalprice").alias("price"))
    o.write.csv(at, sep="\t", header=True, nullValue="（NULL）")
    return S.tsv(spark, at, "o_orderkey bigint, priority string, price double")


@query("F03_parentheses", "select row_id, regexp_extract(entity_name, '\\((.*)\\)', 1) as inner_text from entities where entity_name is not null")
def _(spark, d):
    return table(spark, d, "entities").filter("entity_name is not null").select("row_id", X.in_parentheses("entity_name").alias("inner_text"))


@query("F09_stages", "select hit_id, regexp_replace(regexp_extract(substr('工程名称：' || regexp_extract(text, '^【([^】]+)】', 1) || '，' || text, 1, 1000), '工程名称[:\\s：]+([^\\s，。；标]+(?:工程)?)', 1), '[，。；：:]+$', '') as named from doc_101_labeled where text is not null")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter("text is not null")
    page = F.concat(F.lit("工程名称："), F.regexp_extract("text", "^【([^】]+)】", 1), F.lit("，"), F.col("text"))
    return h.select("hit_id", X.stage_of(page).alias("named"))


_LABELS = ["地下结构", "地上结构", "桩基施工", "装修收尾", "机电安装", "园林道路", "场地平整"]


@query("F22_stage_labels", f"select hit_id, list_filter({_LABELS!r}, lambda x: contains(replace(coalesce(stage, '') || '阶段（' || coalesce({T % 'query'}, '') || '）', '阶段', ''), x))[1] as label from doc_101_labeled")
def _(spark, d):
    reply = F.concat(F.coalesce("stage", F.lit("")), F.lit("阶段（"), F.coalesce(strip("query"), F.lit("")), F.lit("）"))
    return table(spark, d, "doc_101_labeled").select("hit_id", X.first_label(reply, _LABELS, "阶段").alias("label"))


@query("F29_stamped_names", "select row_id, 'chunks_' || strftime(loaded_at, '%Y%m%d_%H%M%S') || '_' || row_id || '.json' as name from entities")
def _(spark, d):
    return table(spark, d, "entities").select("row_id", F.concat(F.lit("chunks_"), F.date_format("loaded_at", "yyyyMMdd_HHmmss"), F.lit("_"), F.col("row_id").cast("string"), F.lit(".json")).alias("name"))


@query("F31_dimension_scores", "select user_id, event_id, round((1 + event_id % 5 + case when event_id % 3 = 0 then 0 else 1 + user_id % 5 end) / case when event_id % 3 = 0 then 1.0 else 2.0 end, 6) as mean_score from events")
def _(spark, d):
    e = table(spark, d, "events")
    second = F.when(F.col("event_id") % 3 == 0, "完整性：无").otherwise(F.concat(F.lit("完整性: "), (1 + F.col("user_id") % 5).cast("string"), F.lit("分")))
    reply = F.concat(F.lit("准确性："), (1 + F.col("event_id") % 5).cast("string"), F.lit("\n"), second)
    return e.select("user_id", "event_id", F.round(X.average_of(reply, ["准确性", "完整性"]), 6).alias("mean_score"))


@query("M04_joined_headers", f"select row_id, array_to_string(list_filter(list_transform(string_split(keywords, ','), lambda x: {T % 'x'}), lambda x: x <> ''), '|') as headers from relations where keywords is not null")
def _(spark, d):
    return table(spark, d, "relations").filter("keywords is not null").select("row_id", F.array_join(X.split_markers("keywords", [","]), "|").alias("headers"))


@query("C06_unknown_strategy", f"""with s as (select doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 600) / 500.0)::bigint))) * 500 as start from documents where length(text) > 0),
    c as (select doc_id, start, {T % 'substr(text, start + 1, 600)'} as chunk from s)
    select doc_id, cast(row_number() over (partition by doc_id order by start) - 1 as integer) as idx, chunk from c where chunk <> ''""")
def _(spark, d):
    return C.chunked(table(spark, d, "documents"), "by magic", size=600, overlap=100)


@query("U08_relevant_found", f"""with h as (select {T % 'query'} as query, chunk_id, max(score) as score, max(case when type = 'positive' then 1 else 0 end) as rel from doc_101_labeled where chunk_id is not null and score is not null and not isnan(score) and {T % 'query'} <> '' group by 1, 2),
    r as (select * from h qualify row_number() over (partition by query order by score desc, chunk_id) <= 10) select query, chunk_id from r where rel = 1""")
def _(spark, d):
    hits = P.best_hits(table(spark, d, "doc_101_labeled"))
    found = top_per_group(hits, ["query"], [F.col("score").desc(), F.col("chunk_id")], 10)
    return found.select("query", "chunk_id").join(hits.filter("rel = 1"), ["query", "chunk_id"], "left_semi")


# by meaning and by words, each its best 20; then all of them ranked anew by both
@query("U06_united_and_reranked", f"""with {_ASK}, {_bm25('documents', 'doc_id', 'text')}, e as (select vec_id, cast(embedding as double[]) as v from embeddings),
    dense as (select query_id, doc_id as id, round(list_dot_product(q.v, e.v), 6) + 0.0 as dense from ask join e q on q.vec_id = query_id * 20, documents join e on doc_id = e.vec_id),
    a as (select query_id, id from dense qualify row_number() over (partition by query_id order by dense desc, id) <= 20), b as (select query_id, id from scores qualify row_number() over (partition by query_id order by score desc, id) <= 20),
    f as (select query_id, id, round(0.5 * coalesce(dense, 0) + 0.05 * coalesce(score, 0), 6) as score from (select * from a union select * from b) left join dense using (query_id, id) left join scores using (query_id, id))
    {_RANKED} f {_TOP.format(k=10)}""")
def _(spark, d):
    docs, e = table(spark, d, "documents"), _vectors(spark, d)
    asked = _asked(spark).join(e, F.col("id") == F.col("query_id") * 20).select(F.col("query_id").alias("id"), "vec", "grp")
    held = e.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    a = V.nearest(asked, held, 20)
    sparse = L.bm25(_asked(spark), L.term_counts(_asked(spark), docs, "doc_id", "text"))
    both = a.select("query_id", "id").union(L.best(sparse, 20).select("query_id", "id")).distinct()
    both = both.join(sparse, ["query_id", "id"], "left").join(held.select("id", "vec"), "id", "left").join(asked.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), "query_id", "left")
    dense = F.coalesce(F.round(V.dot(F.col("qvec"), F.col("vec")), 6), F.lit(0.0))
    return L.best(both.select("query_id", "id", F.round(0.5 * dense + 0.05 * F.coalesce("score", F.lit(0.0)), 6).alias("score")), 10)


_DEPTH = f"case when len({_TERMS % 'query'}) <= 6 then 'simple' when len({_TERMS % 'query'}) <= 12 then 'medium' else 'complex' end"
_OV = f"case when len(list_distinct({_TERMS % 'query'})) = 0 then 0.0 else round(len(list_intersect(list_distinct({_TERMS % 'query'}), list_distinct({_TERMS % 'text'}))) / len(list_distinct({_TERMS % 'query'})), 6) end"


@query("X18_X19_adaptive_retrieval", f"""with h as (select {T % 'query'} as query, chunk_id, max(document_id) as document_id, max(score) as score, max(coalesce(text, '')) as text from doc_101_labeled where chunk_id is not null and score is not null and not isnan(score) and {T % 'query'} <> '' group by 1, 2),
    c as (select query, chunk_id, document_id, score, {_OV} as words, {_DEPTH} as depth from h),
    v as (select *, row_number() over (partition by query order by score desc, chunk_id) as rv, row_number() over (partition by query order by words desc, chunk_id) as rw from c),
    top as (select distinct query, document_id from v where depth = 'complex' and rv <= 5 and document_id is not null),
    got as (select query, chunk_id, depth, score as s from v where depth = 'simple' and rv <= 3
        union select query, chunk_id, depth, round(0.5 * score + 0.5 * words, 6) from v where depth = 'medium' and (rv <= 5 or rw <= 5)
        union select query, chunk_id, depth, score from v where depth = 'complex' and (rv <= 5 or (query, document_id) in (select (query, document_id) from top)))
    select query, chunk_id, depth, cast(row_number() over (partition by query order by s desc, chunk_id) as integer) as rank from got qualify row_number() over (partition by query order by s desc, chunk_id) <= 10""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter(~is_blank("query") & F.expr("chunk_id is not null and score is not null and not isnan(score)"))
    h = h.groupBy(strip("query").alias("query"), "chunk_id").agg(F.max("document_id").alias("document_id"), F.max("score").alias("score"), F.max(F.coalesce("text", F.lit(""))).alias("text"))
    return P.adaptive(h.select("query", "chunk_id", "document_id", "score", overlap("query", "text").alias("words")))


@query("X32_record_replies", "select distinct doc_id, unnest(regexp_extract_all(text, '[A-Z]{2}-[0-9]{5}')) as name, 'code' as type from documents")
def _(spark, d):
    # the default extractor answers as a model does, in the record format, and its reply is read as one
    codes = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z]{2}-[0-9]{5})"), F.lit(1)))
    one = lambda c: F.concat(F.lit('("entity"<|>"'), c, F.lit('"<|>"code"<|>"named in the text")'))
    reply = F.concat(F.array_join(F.transform(codes, one), "##"), F.lit("<|COMPLETE|>"))
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", reply.alias("reply"))
    return R.records(docs, "doc_id").select("doc_id", F.col("first").alias("name"), F.col("second").alias("type")).distinct()


@query("X33_fused_answers", f"""with kb as (select {K % 'entity_id'} as key, arg_max(description, row_id) as said from entities where {T % 'entity_id'} <> '' and {T % 'description'} <> '' group by 1),
    web as (select {K % 'entity_id'} as key, max(entity_name) as said from seed_entities where {T % 'entity_id'} <> '' group by 1)
    select key, case when kb.said is null then '网络补充：' || web.said when web.said is null then '知识库：' || kb.said else '知识库：' || kb.said || chr(10) || '网络补充：' || web.said end as answer from kb full join web using (key)""")
def _(spark, d):
    kb = table(spark, d, "entities").filter(~is_blank("entity_id") & ~is_blank("description")).groupBy(key_of("entity_id").alias("key")).agg(F.max_by("description", "row_id").alias("kb"))
    web = table(spark, d, "seed_entities").filter(~is_blank("entity_id")).groupBy(key_of("entity_id").alias("key")).agg(F.max("entity_name").alias("web"))
    answer = F.concat_ws("\n", F.concat(F.lit("知识库："), "kb"), F.concat(F.lit("网络补充："), "web"))
    return kb.join(web, "key", "full").select("key", answer.alias("answer"))


@query("X33_asked_of_chunks", f"select distinct chunk_id, '请根据' || stage || '的内容提出一个关于“' || regexp_extract({T % 'query'}, '[^ 　]+$') || '”的问题。' as asked from doc_101_labeled where chunk_id is not null and stage is not null and {T % 'query'} <> '' and type = 'positive'")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter(~is_blank("query") & F.expr("chunk_id is not null and stage is not null and type = 'positive'"))
    h = h.select("chunk_id", "stage", F.regexp_extract(strip("query"), "[^ 　]+$", 0).alias("topic"))
    return h.select("chunk_id", R.prompt("请根据{stage}的内容提出一个关于“{topic}”的问题。").alias("asked")).distinct()


# the question as it stands after the turns before it, and the documents that then have most of its words
@query("X20_history_search", f"""with {_ASK}, h as (select query_id, coalesce(lag(query) over (order by query_id) || ' ', '') || query as query from ask), a as (select query_id, unnest(list_distinct({_TERMS % 'query'})) as term from h),
    t as (select distinct doc_id as id, unnest({_TERMS % 'text'}) as term from documents), f as (select query_id, id, cast(count(*) as double) as score from a join t using (term) group by 1, 2) {_RANKED} f {_TOP.format(k=10)}""")
def _(spark, d):
    asked = P.with_turn_before(_asked(spark))
    counts = L.term_counts(asked, table(spark, d, "documents"), "doc_id", "text").filter("term is not null")
    words = asked.select("query_id", F.explode(F.array_distinct(L.terms("query"))).alias("term"))
    scores = counts.select("id", "term").distinct().join(words, "term").groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score"))
    return L.best(scores, 10)


_DAY = "1998-08-03"


@query("J13_ST4_tier_partitions", f"""with t as (select date_diff('day', cast(o_orderdate as date), date '{_DAY}') as age, o_orderkey, o_totalprice from orders)
    select case when age <= 7 then 'hot' else 'warm' end as tier, count(*) as n, round(sum(o_totalprice), 2) as total from t where age <= 30 group by 1""")
def _(spark, d):
    at = _folder(spark, "tiers")
    age = F.datediff(F.lit(_DAY).cast("date"), F.col("o_orderdate").cast("date"))
    # one folder per tier: a question about the last 30 days reads two of the three
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", Y.tier(age).alias("tier")).write.partitionBy("tier").parquet(at)
    recent = spark.read.parquet(at).filter(F.col("tier").isin("hot", "warm"))
    return recent.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("ST3_compacted_files", "select cast(cast(ts as date) as varchar) as day, count(*) as n, cast(1 as bigint) as n_files from events group by 1")
def _(spark, d):
    at, to = _folder(spark, "files"), _folder(spark, "compact")
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    e.repartition(4).write.partitionBy("day").parquet(at)
    Y.compact(spark.read.parquet(at), "day", to)
    return Y.file_counts(spark.read.parquet(to), "day").select("day", F.col("n_rows").alias("n"), "n_files")


@query("P13_three_filters", f"select distinct chunk_id from doc_101_labeled where chunk_id is not null and (contains(text, '面积') or contains(text, '厚度') or contains(text, 'area')) and (contains(headers_norm, 'feature_desc') or contains(text, '规格')) and contains(content, chr(10) || '|')")
def _(spark, d):
    has = lambda c, words: P.any_word(F.col(c), words)
    h = table(spark, d, "doc_101_labeled").filter("chunk_id is not null").filter(has("text", ["面积", "厚度", "area"]))
    return h.filter(has("headers_norm", ["feature_desc"]) | has("text", ["规格"])).filter(has("content", ["\n|"])).select("chunk_id").distinct()


@query("M05_context_rows", "select row_id, to_json({'entity_name': entity_name, 'entity_type': entity_type, 'document_id': document_id}) as context from entities")
def _(spark, d):
    doc = F.to_json(F.struct("entity_name", "entity_type", "document_id"), {"ignoreNullFields": "false"})
    return table(spark, d, "entities").select("row_id", doc.alias("context"))


@query("C08_read_pages", f"""select distinct chunk_id, concat_ws(chr(10), '【' || nullif(stage, '') || '】', '第' || (page_idx + 1) || '页（OCR识别）', {T % 'text'}) as chunk from doc_101_labeled
    where chunk_id is not null and page_idx is not null and not contains(content, chr(10) || '|') and length({T % 'text'}) >= 50 and (contains(text, '规格') or contains(text, '材质'))""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter("chunk_id is not null and page_idx is not null").filter(~F.col("content").contains("\n|"))
    h = h.filter((F.length(strip("text")) >= 50) & P.any_word(F.col("text"), ["规格", "材质"]))
    stage = F.concat(F.lit("【"), F.nullif("stage", F.lit("")), F.lit("】"))
    page = F.concat(F.lit("第"), (F.col("page_idx") + 1).cast("string"), F.lit("页（OCR识别）"))
    return h.select("chunk_id", F.concat_ws("\n", stage, page, strip("text")).alias("chunk")).distinct()


@query("K05_replaced_rows", "select vec_id from embeddings where label >= 5")
def _(spark, d):
    at = _folder(spark, "replaced")
    e = table(spark, d, "embeddings")
    e.filter("label < 5").select("vec_id").write.parquet(at)
    e.filter("label >= 5").select("vec_id").write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


@query("S10_first_per_folder", """with p as (select distinct 'reports/' || document_id || case when hit_id % 10 = 0 then 'x' else '' end || '/' || source_file || '.pdf' as path from doc_101_labeled where document_id is not null and source_file is not null),
    f as (select regexp_extract(path, '^reports/([0-9]+)/', 1) as folder, path from p where regexp_matches(path, '^reports/[0-9]+/')) select folder, min(path) as path from f where folder in (select cast(document_id as varchar) from kg_metadata where status = 'completed') group by 1""")
def _(spark, d):
    odd = F.when(F.col("hit_id") % 10 == 0, "x").otherwise("")
    h = table(spark, d, "doc_101_labeled").filter("document_id is not null and source_file is not null")
    paths = h.select(F.concat(F.lit("reports/"), "document_id", odd, F.lit("/"), "source_file", F.lit(".pdf")).alias("path")).distinct()
    allowed = table(spark, d, "kg_metadata").filter("status = 'completed'").select(F.col("document_id").cast("string").alias("folder"))
    return S.first_per_folder(paths, "reports", allowed)


@query("X27_score_keys", """select event_id, round(case event_id % 4 when 0 then value when 1 then value / 2 when 2 then case when user_id % 2 = 0 then 1.0 else 0.0 end end, 6) as score from events""")
def _(spark, d):
    v = F.col("value").cast("string")
    kind = F.col("event_id") % 4
    reply = F.when(kind == 0, F.concat(F.lit('{"faithfulness_score": '), v, F.lit(', "faithfulness": 9}')))
    reply = reply.when(kind == 1, F.concat(F.lit('{"faithfulness": '), (F.col("value") / 2).cast("string"), F.lit("}")))
    reply = reply.when(kind == 2, F.concat(F.lit('{"grounded": '), (F.col("user_id") % 2 == 0).cast("string"), F.lit("}"))).otherwise("no object")
    return table(spark, d, "events").select("event_id", F.round(R.score_in(reply, "faithfulness", ["grounded", "correct"]), 6).alias("score"))


@query("ST6_X16_graph_steps", f"""with a as ({OPERATIONS["X16_X19_adaptive_loop"]}),
    n as (select question, case state when 'web' then ['route', 'web_search', 'generate'] when 'answered' then list_concat(['route'], flatten(list_transform(range(rounds_used), lambda i: ['retrieve', 'grade', 'rewrite'])), ['retrieve', 'grade', 'generate'])
        else list_concat(['route'], flatten(list_transform(range(rounds_used), lambda i: ['retrieve', 'grade', 'rewrite'])), ['retrieve', 'grade', 'give_up']) end as nodes from a)
    select question, unnest(range(1, len(nodes) + 1)) as step, unnest(nodes) as node from n""")
def _(spark, d):
    return D.steps(LOOP["X16_X19_adaptive_loop"](spark, d))


_SPACES = "[ \\t\\n\\r\\x0B\\f\\x{00A0}\\x{3000}]+"


@query("C05_token_chunks", f"""with w as (select doc_id, regexp_split_to_array({T % 'text'}, '{_SPACES}') as w from documents where {T % 'text'} <> ''), i as (select doc_id, w, unnest(range(0, cast(ceil(len(w) / 500.0) as bigint))) as idx from w)
    select doc_id, cast(idx as integer) as idx, array_to_string(w[idx * 500 + 1 : idx * 500 + 500], ' ') as chunk from i""")
def _(spark, d):
    return C.token_chunks(table(spark, d, "documents"))
