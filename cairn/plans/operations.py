"""Queries of lifecycle, streams, dialogue, sources and sinks (survey: A17, A19, A22, D02-D05, W06-W09, ST1-ST8, X15-X20, S01-S23, K01-K20)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.functions.shared import checkpoint_dir
from cairn.functions.text import WHITE_SPACE, strip
from cairn.operators import dialogue as A
from cairn.operators import lifecycle as Y
from cairn.operators.lexical import TERM
from cairn.plans.registry import registry
from cairn.sources import files as S
from cairn.sources import store
from cairn.sources.tables import table
from cairn.streaming import flush

QUERIES, SQL, query = registry()
WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
T = f"trim(%s, {WS})"
#: The day that ages are counted to; fixed, so that a query gives the same rows on every day.
TODAY = "2001-01-01"


def _folder(spark, name: str) -> str:
    """A new folder in the place all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("D02_J13_tier_routing", f"""select o_orderkey, date_diff('day', cast(o_orderdate as date), date '{TODAY}') as age,
    case when date_diff('day', cast(o_orderdate as date), date '{TODAY}') <= 7 then 'hot' when date_diff('day', cast(o_orderdate as date), date '{TODAY}') <= 30 then 'warm' else 'cold' end as tier from orders""")
def _(spark, d):
    age = F.datediff(F.lit(TODAY).cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", age.cast("bigint").alias("age"), Y.tier(age).alias("tier"))


@query("ST4_tier_totals", f"""with t as (select case when date_diff('day', cast(o_orderdate as date), date '{TODAY}') <= 7 then 'hot' when date_diff('day', cast(o_orderdate as date), date '{TODAY}') <= 30 then 'warm' else 'cold' end as tier, o_totalprice from orders)
    select tier, count(*) as n, round(sum(o_totalprice), 2) as total from t group by 1""")
def _(spark, d):
    age = F.datediff(F.lit(TODAY).cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, d, "orders").groupBy(Y.tier(age).alias("tier")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("D05_expired", f"""select o_orderkey, case when o_custkey % 3 = 0 then false else date_diff('day', cast(o_orderdate as date), date '{TODAY}') > 400 * (o_custkey % 3) end as expired from orders""")
def _(spark, d):
    age = F.datediff(F.lit(TODAY).cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", Y.expired(age, (F.col("o_custkey") % 3) * 400).alias("expired"))


_SEG = """s as (select event_id, cast(cast(ts as date) as varchar) as day, user_id, value, cast(floor(coalesce(sum(1 + user_id) over (partition by cast(ts as date) order by ts, event_id rows between unbounded preceding and 1 preceding), 0) / 2000) as bigint) as segment from events)"""


def _segments(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    return Y.segments(e, "day", F.hour("ts"), ["ts", "event_id"], 1 + F.col("user_id"), 2000)


@query("W09_ST1_segments", f"with {_SEG} select event_id, day, segment from s")
def _(spark, d):
    return _segments(spark, d).select("event_id", "day", "segment")


@query("ST3_compaction_plan", f"""with {_SEG}, g as (select day, segment, count(*) as n_rows, count_if(user_id % 7 = 0) as n_deleted from s group by 1, 2),
    p as (select day, count(*) as n_segments, round(sum(n_deleted) / sum(n_rows), 6) as deleted_share from g group by 1)
    select *, n_segments > 20 or deleted_share > 0.1 as compact, cast(case when n_segments > 20 or deleted_share > 0.1 then ceil(n_segments / 15.0) else 0 end as bigint) as runs from p""")
def _(spark, d):
    g = _segments(spark, d).groupBy("day", "segment").agg(F.count("*").alias("n_rows"), F.count_if(F.col("user_id") % 7 == 0).alias("n_deleted"))
    return Y.compaction_plan(g, ["day"])


@query("A19_capacity", "select label, count(*) as n, cast(max(len(embedding)) * count(*) * 6.0 as double) as bytes from embeddings group by 1")
def _(spark, d):
    g = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))
    return g.select("label", "n", Y.memory_bytes(F.col("dim"), F.col("n")).alias("bytes"))


@query("A22_alerts", """with m as (select event_type as metric, round(quantile_cont(value, 0.99), 6) as value from events group by 1)
    select metric, value, case when metric = 'error' and value >= 100 then 'critical' when metric = 'error' and value >= 10 then 'warning' when metric = 'view' and value >= 1000 then 'critical' when metric = 'view' and value >= 50 then 'warning' else 'ok' end as level from m""")
def _(spark, d):
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.percentile("value", F.lit(0.99)), 6).alias("value"))
    return Y.alerts(m, {"error": (10.0, 100.0), "view": (50.0, 1000.0)})


@query("A17_totals_rollup", "select event_type, cast(cast(ts as date) as varchar) as day, count(*) as n, round(sum(value), 4) as total from events group by rollup (event_type, cast(cast(ts as date) as varchar))")
def _(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date").cast("string"))
    return e.rollup("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("A01_A17_trend", "select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1, 2")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("D03_D04_dates", "select o_orderkey, cast(cast(o_orderdate as date) as varchar) as day from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'")
def _(spark, d):
    o = table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz '1997-01-01 00:00:00' and o_orderdate < timestamp_ntz '1998-01-01 00:00:00'")
    # written as month/day/year and read back
    return o.select("o_orderkey", F.to_date(F.date_format("o_orderdate", "M/d/yyyy"), "M/d/yyyy").cast("string").alias("day"))


_FLUSH = "select cast(time_bucket(interval 6 hours, ts) as timestamp) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"


@query("ST2_flush_windows", _FLUSH)
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return flush.flush_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("ST2_ST8_flush_stream", _FLUSH)
def _(spark, d):
    at = _folder(spark, "flush")
    stream = flush.events(spark, f"{d}/events.parquet", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    flush.run_to_end(flush.flush_counts(stream), f"{at}/out", f"{at}/state")
    out = flush.latest(spark, f"{at}/out", ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("ST8_first_seen_stream", "select user_id, min(event_id) as first_event from events group by 1")
def _(spark, d):
    at = _folder(spark, "seen")
    stream = flush.events(spark, f"{d}/events.parquet", "event_id bigint, ts timestamp_ntz, user_id bigint")
    flush.run_to_end(flush.first_seen(stream, "event_id").select("event_id", "user_id"), f"{at}/out", f"{at}/state", "append")
    return spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.min("event_id").alias("first_event"))


@query("W06_last_turns", "select user_id, event_id, cast(row_number() over (partition by user_id order by ts desc, event_id desc) as integer) as turn_back from events qualify turn_back <= 3")
def _(spark, d):
    return A.last_turns(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("user_id", "event_id", "turn_back")


@query("W07_X20_history", "select event_id, concat_ws(' | ', lag(event_type, 2) over w, lag(event_type, 1) over w) as history from events window w as (partition by user_id order by ts, event_id)")
def _(spark, d):
    return A.history(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", 2, F.col("ts").cast("date")).select("event_id", "history")


_NUMBERED = "(select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // 64 as part from events)"


@query("W07_whole_history", f"select event_id, user_id, part, coalesce(string_agg(event_type, ' | ') over (partition by user_id, part order by ts, event_id rows between unbounded preceding and 1 preceding), '') as history from {_NUMBERED}")
def _(spark, d):
    return A.whole_history(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", F.col("ts").cast("date")).select("event_id", "user_id", "part", "history")


@query("W07_history_parts", f"select user_id, part, coalesce(string_agg(event_type, ' | ' order by ts, event_id), '') as history from {_NUMBERED} group by 1, 2")
def _(spark, d):
    return A.history_parts(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", F.col("ts").cast("date"))


_Q = f"q as (select distinct {T % 'query'} as question from doc_101_labeled where {T % 'query'} <> '')"
_ROUTE = "case when regexp_matches(question, '今天|最新|现在|today|latest|now') then 'web' when regexp_matches(question, '[A-Z]+[0-9]{4,}') then 'keyword' when regexp_matches(question, '关系|影响|相连|relat|between') then 'graph' else 'vector' end"
_TERMS = f"regexp_extract_all(lower(%s), '{TERM}', 1)"
_N = f"len(regexp_extract_all(lower(question), '{TERM}', 1))"


def _questions(spark, d):
    return table(spark, d, "doc_101_labeled").select(strip("query").alias("question")).filter("question <> ''").distinct()


@query("X15_X17_routes", f"with {_Q} select question, {_ROUTE} as route from q")
def _(spark, d):
    return _questions(spark, d).select("question", A.route(F.col("question")).alias("route"))


@query("X18_depths", f"with {_Q} select question, case when {_N} <= 6 then 'simple' when {_N} <= 12 then 'medium' else 'complex' end as depth from q")
def _(spark, d):
    return _questions(spark, d).select("question", A.depth(F.col("question")).alias("depth"))


_OVERLAP = f"case when len(list_distinct({_TERMS % 'question'})) = 0 then 0.0 else round(len(list_intersect(list_distinct({_TERMS % 'question'}), list_distinct({_TERMS % 'text'}))) / len(list_distinct({_TERMS % 'question'})), 6) end"


@query("X16_X19_adaptive_loop", f"""with {_Q}, h as (select {T % 'query'} as question, coalesce(page_idx, 0) % 3 as round, text from doc_101_labeled where {T % 'query'} <> '' and text is not null),
    g as (select question, round, cast(count_if({_OVERLAP} >= 0.1) as bigint) as n from h group by 1, 2), f as (select question, min({{'r': round, 'n': n}}) as f from g where n > 0 and round <= 2 group by 1),
    s as (select question, {_ROUTE} = 'web' as web, f from q left join f using (question))
    select question, case when web then 'web' when f is not null then 'answered' else 'given up' end as state, cast(case when web then 0 else coalesce(f.r, 2) end as integer) as rounds_used, cast(case when web then 0 else coalesce(f.n, 0) end as bigint) as n_documents from s""")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").select(strip("query").alias("question"), "text", "page_idx").filter("question <> '' and text is not null")
    tried = h.select("question", (F.coalesce("page_idx", F.lit(0)) % 3).cast("int").alias("round"), "text")
    return A.answered(_questions(spark, d), tried)


# odd rows are kept as GBK, and names of ASCII characters of every third row with a byte that only Latin-1 has
@query("S01_S04_decoded_files", f"select row_id, case when row_id % 3 = 2 and regexp_full_match(entity_name, '[ -~]+') then entity_name || chr(255) else entity_name end as text from entities where {T % 'entity_name'} <> ''")
def _(spark, d):
    e = table(spark, d, "entities").filter(F.length(strip("entity_name")) > 0)
    latin = (F.col("row_id") % 3 == 2) & F.col("entity_name").rlike("^[ -~]+$")
    name = F.when(latin, F.concat("entity_name", F.lit("\u00ff"))).otherwise(F.col("entity_name"))
    encoding = F.when(latin, "latin-1").when(F.col("row_id") % 2 == 1, "gbk").otherwise("utf-8")
    raw = S.encoded(e.select(F.concat(F.col("row_id").cast("string"), F.when(F.col("row_id") % 5 == 0, ".TXT").otherwise(".md")).alias("path"), name.alias("text"), encoding.alias("encoding")))
    # by their endings: txt and what has an unknown one are both read as text
    out = S.texts(raw.filter(S.suffix(F.col("path")) == "txt")).unionByName(S.texts(raw.filter(S.suffix(F.col("path")) != "txt")))
    return out.select(F.regexp_extract("path", "^([0-9]+)", 1).cast("bigint").alias("row_id"), "text")


@query("S20_html_text", "select doc_id, replace(replace(text, '<', '['), '&', '+') as text from documents")
def _(spark, d):
    t = F.translate("text", "<&", "[+")
    html = F.concat(F.lit("<html><head><style>p {x: y}</style><script>if (a < b) {c()}</script></head><body><p class='a'>"), t, F.lit("</p></body></html>"))
    return table(spark, d, "documents").select("doc_id", S.html_text(html).alias("text"))


@query("S22_S23_semi_structured", "select event_id, event_type as platform, case when event_id % 5 = 0 then null else value end as likes from events")
def _(spark, d):
    e = table(spark, d, "events")
    likes = F.when(F.col("event_id") % 5 == 0, "nan").otherwise(F.col("value").cast("string"))
    line = F.concat(F.lit("platform: "), "event_type", F.lit(", likes: "), likes)
    return e.select("event_id", S.key_value(line, "platform").alias("platform"), S.key_value(line, "likes").cast("double").alias("likes"))


@query("S19_factors", "select cast(json_extract(props, '$.k') as bigint) as factor, count(*) as n from events group by 1")
def _(spark, d):
    doc = F.concat(F.lit('[{"stage": "a", "sources": [{"factors": ['), "props", F.lit("]}]}]"))
    parsed = F.from_json(doc, "array<struct<stage string, sources array<struct<factors array<struct<k bigint>>>>>>")
    e = table(spark, d, "events").select(F.explode(parsed).alias("s")).select(F.explode("s.sources").alias("s")).select(F.explode("s.factors").alias("f"))
    return e.groupBy(F.col("f.k").alias("factor")).agg(F.count("*").alias("n"))


@query("S12_K13_chunk_files", "select distinct document_id, chunk_id, page_idx from doc_101_labeled where chunk_id is not null and document_id is not null")
def _(spark, d):
    at = _folder(spark, "chunks")
    c = table(spark, d, "doc_101_labeled").filter("chunk_id is not null and document_id is not null").select("document_id", "chunk_id", "page_idx").distinct()
    # chunk files hold the pages of a document in parts, so none grows with the whole collection
    one = c.groupBy("document_id", F.floor(F.coalesce("page_idx", F.lit(-1)) / 8).alias("part")).agg(F.collect_list(F.struct("chunk_id", "page_idx")).alias("chunks"))
    one.select("document_id", "chunks").write.json(at)
    return S.chunk_files(spark, at, "chunk_id string, page_idx bigint")


@query("K14_K15_csv_per_document", "select hit_id, document_id, nullif(type, '') as type from doc_101_labeled where document_id is not null")
def _(spark, d):
    at = _folder(spark, "csv")
    h = table(spark, d, "doc_101_labeled").select("hit_id", "document_id", "type", F.lit(None).cast("string").alias("original_query"))
    S.write_csv_per_group(h, at, "document_id", ("type", "original_query"))
    out = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").schema("hit_id bigint, type string, document_id string").csv(at)
    return out.select("hit_id", "document_id", "type")


@query("K01_K04_collection", "select vec_id, label from embeddings where vec_id % 10 <> 3")
def _(spark, d):
    e = table(spark, d, "embeddings")
    c = store.create("parquet", spark, _folder(spark, "collection"), "vec_id", "embedding")
    c.insert(e.filter("label < 5"))
    c.insert(e.filter("label >= 5"))
    return c.delete(e.filter("vec_id % 10 = 3").select("vec_id")).compact(4).rows().select("vec_id", "label")


@query("K02_made_keys", f"select coalesce(nullif({T % 'entity_id'}, ''), md5(coalesce(description, ''))) as key, count(*) as n from entities where entity_name is not null group by 1")
def _(spark, d):
    e = table(spark, d, "entities").filter("entity_name is not null")
    key = F.coalesce(F.nullif(strip("entity_id"), F.lit("")), F.md5(F.coalesce("description", F.lit(""))))
    return e.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("K21_manifest_rows", "select document_id, document_id || '/' || document_id || '_origin.pdf' as path, coalesce(min(source_file), '') as file_name, count(*) as n from doc_101_labeled where document_id is not null group by 1")
def _(spark, d):
    h = table(spark, d, "doc_101_labeled").filter("document_id is not null").groupBy("document_id")
    h = h.agg(F.coalesce(F.min("source_file"), F.lit("")).alias("file_name"), F.count("*").alias("n"))
    return h.withColumn("path", F.concat("document_id", F.lit("/"), "document_id", F.lit("_origin.pdf")))


@query("X30_versions", "select row_id, collection_name from entity_index where collection_name = 'kg__entities_v2'")
def _(spark, d):
    return table(spark, d, "entity_index").filter("collection_name = 'kg__entities_v2'").select("row_id", "collection_name")


@query("P18_P19_combined_filters", "select hit_id from doc_101_labeled where type = 'positive' and score >= 0.5 and not isnan(score) and contains(text, '规格')")
def _(spark, d):
    return table(spark, d, "doc_101_labeled").filter((F.col("type") == "positive") & (F.col("score") >= 0.5) & ~F.isnan("score") & F.col("text").contains("规格")).select("hit_id")


@query("P20_nested_projection", "select o_orderkey, 'INV-' || o_orderkey as number, c_name as buyer, o_totalprice as total from orders join customer on o_custkey = c_custkey")
def _(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    doc = F.to_json(F.struct(F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("no"), F.struct(F.col("c_name").alias("name")).alias("buyer"), F.struct(F.col("o_totalprice").alias("sum")).alias("total")))
    inv = F.from_json(doc, "no string, buyer struct<name string>, total struct<sum double>")
    return o.select("o_orderkey", inv["no"].alias("number"), inv["buyer"]["name"].alias("buyer"), inv["total"]["sum"].alias("total"))


@query("M05_context_json", "select count(*) as n from entities where entity_name is not null")
def _(spark, d):
    e = table(spark, d, "entities").filter("entity_name is not null")
    doc = F.to_json(F.struct("row_id", "entity_name"))
    back = F.from_json(doc, "row_id bigint, entity_name string")
    return e.select(back["entity_name"].eqNullSafe(F.col("entity_name")).alias("same")).agg(F.count_if("same").alias("n"))
