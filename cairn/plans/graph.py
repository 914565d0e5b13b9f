"""Queries of the knowledge graph (survey: A02, A03, A08, K08-K11, X08-X13, P16, P21, J03-J05, U01-U03)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.functions.shared import checkpoint_dir
from cairn.functions.text import WHITE_SPACE, is_blank, strip
from cairn.operators import graph as G
from cairn.operators import vectors as V
from cairn.operators.references import key_of
from cairn.plans.registry import registry
from cairn.sources import files
from cairn.sources.tables import questions, table

QUERIES, SQL, query = registry()
WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
T = f"trim(%s, {WS})"
K = f"lower(trim(%s, {WS}))"
#: Where the later part of a table begins that comes in as new rows.
NEW = "timestamp '2025-07-01'"


@query("A02_merge_entities", f"""with e as (select row_id, coalesce(entity_name, '') as entity_name, coalesce(entity_type, '') as entity_type, description, entity_id, source_chunk_id, document_id from entities)
    select entity_name, entity_type, min(row_id) as first_id, count(*) as n, arg_min_null(entity_id, row_id) as entity_id, arg_min_null(source_chunk_id, row_id) as source_chunk_id, arg_min_null(document_id, row_id) as document_id, array_to_string(list_sort(list(distinct description) filter ({T % 'description'} <> '')), ' | ') as description from e group by 1, 2""")
def _(spark, d):
    return G.merge_entities(table(spark, d, "entities"))


_R = "coalesce(source_entity, '') as source_entity, coalesce(target_entity, '') as target_entity, coalesce(relation_type, '') as relation_type"


@query("A03_merge_relations", f"""select {_R}, count(*) as n, round(sum(coalesce(weight, 1.0)), 6) as weight, arg_min_null(keywords, row_id) as keywords,
    array_to_string(list_sort(list(distinct description) filter ({T % 'description'} <> '')), ' | ') as description from relations group by 1, 2, 3""")
def _(spark, d):
    return G.merge_relations(table(spark, d, "relations"))


@query("K08_upsert_entities", f"""with e as (select *, {K % 'entity_id'} as key from entities where {T % 'entity_id'} <> ''),
    t as (select key, description, min(row_id) as o from e where {T % 'description'} <> '' group by 1, 2),
    j as (select key, string_agg(description, ';' order by o, description) as description from t group by key),
    h as (select key, arg_max({{'t': entity_type, 'd': document_id}}, {{'a': loaded_at, 'b': row_id}}) as l, count(*) as n from e group by key)
    select key, l.t as entity_type, l.d as document_id, n, description from h left join j using (key)""")
def _(spark, d):
    e = table(spark, d, "entities")
    new = F.col("loaded_at") >= F.expr("timestamp_ntz '2025-07-01 00:00:00'")
    return G.upsert_entities(e.filter(~new), e.filter(new))


@query("K08_merged_by_name", f"""with e as (select *, {K % 'entity_name'} as key from entities where {T % 'entity_name'} <> ''),
    t as (select key, description, min(row_id) as o from e where {T % 'description'} <> '' group by 1, 2),
    j as (select key, string_agg(description, ';' order by o, description) as description from t group by key),
    h as (select key, arg_max({{'t': entity_type, 'd': document_id}}, {{'a': loaded_at, 'b': row_id}}) as l, count(*) as n from e group by key)
    select key, l.t as entity_type, l.d as document_id, n, description from h left join j using (key)""")
def _(spark, d):
    e = table(spark, d, "entities")
    new = F.col("loaded_at") >= F.expr("timestamp_ntz '2025-07-01 00:00:00'")
    return G.upsert_entities(e.filter(~new), e.filter(new), "entity_name")


@query("K09_upsert_relations", f"""with r as (select *, {K % 'source_entity'} as source, {K % 'target_entity'} as target, coalesce(relation_type, '') as kind from relations where {T % 'source_entity'} <> '' and {T % 'target_entity'} <> ''),
    t as (select source, target, kind, description, min(row_id) as o from r where {T % 'description'} <> '' group by 1, 2, 3, 4),
    j as (select source, target, kind, string_agg(description, ';' order by o, description) as description from t group by 1, 2, 3),
    w as (select source, target, kind, {T % 'unnest(string_split(keywords, chr(44)))'} as kw from r),
    k as (select source, target, kind, array_to_string(list_sort(list(distinct kw)), ',') as keywords from w where kw <> '' group by 1, 2, 3),
    h as (select source, target, kind, round(sum(coalesce(weight, 1.0)), 6) as weight from r group by 1, 2, 3)
    select * from h left join k using (source, target, kind) left join j using (source, target, kind)""")
def _(spark, d):
    r = table(spark, d, "relations")
    new = F.col("loaded_at") >= F.expr("timestamp_ntz '2025-07-01 00:00:00'")
    return G.upsert_relations(r.filter(~new), r.filter(new))


@query("K10_upsert_metadata", """with m as (select document_id, max(namespace) as namespace, nullif(max({'a': coalesce(try_cast(translate(updated_at, '/T', '- ') as timestamp), timestamp '0001-01-01'), 's': coalesce(status, '')})['s'], '') as status from kg_metadata where document_id is not null group by 1),
    e as (select document_id, cast(count(*) as integer) as entity_count from entities where document_id is not null group by 1),
    r as (select document_id, cast(count(*) as integer) as relation_count from relations where document_id is not null group by 1)
    select document_id, namespace, coalesce(status, 'processing') as status, coalesce(entity_count, 0) as entity_count, coalesce(relation_count, 0) as relation_count
    from m full join e using (document_id) full join r using (document_id)""")
def _(spark, d):
    return G.upsert_metadata(table(spark, d, "kg_metadata"), table(spark, d, "entities"), table(spark, d, "relations"))


_EDGES = f"""edges as (select * from (select row_id, {K % 'source_entity'} as source, {K % 'target_entity'} as target, relation_type, weight, loaded_at, description
        from relations where {T % 'source_entity'} <> '' and {T % 'target_entity'} <> '') where source <> target),
    links as (select source as u, target as v from edges union select target, source from edges)"""


@query("P16_edges", f"with {_EDGES} select row_id, source, target, relation_type, weight from edges")
def _(spark, d):
    return G.edges_of(table(spark, d, "relations")).drop("loaded_at")


@query("K11_simple_edges", f"""with {_EDGES}, g as (select least(source, target) as a, greatest(source, target) as b, arg_max({{'t': relation_type, 'w': weight}}, {{'a': loaded_at, 'b': row_id}}) as l from edges group by 1, 2)
    select a, b, l.t as relation_type, l.w as weight from g""")
def _(spark, d):
    return G.simple_edges(G.edges_of(table(spark, d, "relations")))


@query("A08_graph_stats", f"with {_EDGES} select count(distinct u) as n_nodes, count(*) // 2 as n_edges, round((count(*) // 2) * 2.0 / count(distinct u), 6) as average_degree from links")
def _(spark, d):
    return G.graph_stats(G.edges_of(table(spark, d, "relations")))


_SEEDS = f"seeds as (select distinct {K % 'entity_id'} as node from seed_entities)"
_HOPS = f"""{_EDGES}, {_SEEDS},
    one as materialized (select distinct v as node from links join seeds on u = node where v not in (select node from seeds)),
    two as materialized (select distinct v as node from links join one on u = node where v not in (select node from seeds) and v not in (select node from one)),
    hops as materialized (select node, 0 as depth from seeds union all select node, 1 from one union all select node, 2 from two)"""


@query("X12_two_hops", f"with {_HOPS} select node, depth from hops")
def _(spark, d):
    seeds = table(spark, d, "seed_entities").select(key_of("entity_id").alias("node"))
    return G.k_hop(seeds, G.edges_of(table(spark, d, "relations")), 2)


@query("X12_induced_edges", f"with {_HOPS}, a as materialized (select row_id, source, target from edges semi join hops on source = node) select row_id, source, target from a semi join hops on target = node")
def _(spark, d):
    edges = G.edges_of(table(spark, d, "relations"))
    seeds = table(spark, d, "seed_entities").select(key_of("entity_id").alias("node"))
    return G.induced(edges, G.k_hop(seeds, edges, 2)).select("row_id", "source", "target")


@query("P21_name_search", f"select row_id, entity_name = '北侧' as exact, entity_name from entities where contains(lower(entity_name), '北侧') or contains(lower(entity_name), 'culvert')")
def _(spark, d):
    low = F.lower("entity_name")
    return table(spark, d, "entities").filter(low.contains("北侧") | low.contains("culvert")).select("row_id", (F.col("entity_name") == "北侧").alias("exact"), "entity_name")


# a stated set of queries that doesn't grow: words of the seed entities' kinds and of the corpus
_WORDS = ["水箱", "电缆", "culvert", "strainer", "检索器", "gateway", "防水层", "parapet"]
_QUERY = f"q as (select unnest({_WORDS!r}) as query)"
_ENTITY_HITS = f"""eh as (select query, key, score from (select query, key, max(round(length(query) / length(text), 6)) as score from q
        join (select {K % 'entity_id'} as key, {K % 'entity_name'} as text from entities) e on contains(text, query) where key <> '' group by 1, 2)
        qualify row_number() over (partition by query order by score desc, key) <= 10)"""
_LOCAL = f"""{_EDGES}, {_QUERY}, {_ENTITY_HITS},
    local as (select query, 'entity' as kind, key, score from eh
        union select distinct query, 'entity', v, 0.5 from eh join links on u = key where (query, v) not in (select (query, key) from eh)
        union select query, 'relation', cast(row_id as varchar), 0.6 from eh join edges on key = source or key = target)"""
_GLOBAL = f"""rh as (select query, key, score from (select query, cast(row_id as varchar) as key, max(round(length(query) / length({K % 'description'}), 6)) as score
        from q join relations on contains({K % 'description'}, query) group by 1, 2) qualify row_number() over (partition by query order by score desc, key) <= 10),
    ends as (select distinct query, unnest([{K % 'source_entity'}, {K % 'target_entity'}]) as node from rh join relations on cast(row_id as varchar) = key),
    found as (select query, node, source_chunk_id from ends join entities on {K % 'entity_id'} = node where node <> ''),
    overall as (select query, 'relation' as kind, key, score from rh union select query, 'entity', node, 0.8 from found
        union select query, 'chunk', source_chunk_id, 0.0 from found where {T % 'source_chunk_id'} <> '')"""
_RANK = "select query, kind, key, score, cast(row_number() over (partition by query, kind order by score desc, key) as integer) as rank from"


def _queries(spark):
    return questions(spark, _WORDS).select("query")


def _local(spark, d):
    return G.local_search(_queries(spark), table(spark, d, "entities"), G.edges_of(table(spark, d, "relations")))


def _global(spark, d):
    return G.global_search(_queries(spark), table(spark, d, "relations"), table(spark, d, "entities"))


@query("X08_local_search", f"with {_LOCAL} {_RANK} local")
def _(spark, d):
    return G.merge_contexts([_local(spark, d)])


@query("X09_global_search", f"with {_QUERY}, {_GLOBAL} {_RANK} overall")
def _(spark, d):
    return G.merge_contexts([_global(spark, d)])


@query("X11_U01_mixed_search", f"with {_LOCAL}, {_GLOBAL} {_RANK} (select * from local union select * from overall)")
def _(spark, d):
    return G.merge_contexts([_local(spark, d), _global(spark, d)])


# the same searches by vectors: queries are the vectors with ids divisible by 20; row_id and doc_id name the vectors of entities (each by its first row), relations and documents
_FLOOR = 0.05
_NEAR = f"""{_EDGES}, e as (select vec_id as id, cast(embedding as double[]) as v from embeddings),
    keyed as (select {K % 'entity_id'} as key, min(row_id) as id from entities where {T % 'entity_id'} <> '' group by 1),
    named as (select 'entity' as kind, id, key from keyed union all select 'relation', row_id, cast(row_id as varchar) from relations union all select 'chunk', doc_id, cast(doc_id as varchar) from documents),
    near as (select cast(query_id as varchar) as query, kind, key, score from (select q.id as query_id, kind, key, e.id, round(list_dot_product(q.v, e.v), 6) + 0.0 as score from e q, e join named using (id) where q.id % 20 = 0)
        where score >= {_FLOOR} qualify row_number() over (partition by query_id, kind order by score desc, id) <= 10),
    eh as (select query, key, score from near where kind = 'entity'), rh as (select query, key, score from near where kind = 'relation')"""
_LOCAL_NEAR = f"{_NEAR}, local as {_LOCAL.partition('local as ')[2]}"
_GLOBAL_NEAR = f"ends as {_GLOBAL.partition('ends as ')[2]}"


def _near(spark, d, rows, key: str):
    """The ten nearest of rows (id, key) for each query vector: query, key, score."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(0).cast("bigint").alias("grp"))
    found = V.nearest(e.filter("id % 20 = 0"), e.join(rows.select("id"), "id", "left_semi"), 10, least=_FLOOR)
    return found.join(rows, "id").select(F.col("query_id").cast("string").alias("query"), F.col(key).cast("string").alias("key"), "score")


def _near_entities(spark, d):
    e = table(spark, d, "entities").filter(~is_blank("entity_id"))
    return _near(spark, d, e.groupBy(key_of("entity_id").alias("key")).agg(F.min("row_id").alias("id")), "key")


def _near_relations(spark, d):
    return _near(spark, d, table(spark, d, "relations").select(F.col("row_id").alias("id")), "id")


def _near_chunks(spark, d):
    return _near(spark, d, table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id")


def _kind(df, kind):
    return df.select("query", F.lit(kind).alias("kind"), "key", "score")


def _near_local(spark, d):
    return G.around_entities(_near_entities(spark, d), G.edges_of(table(spark, d, "relations")))


def _near_global(spark, d):
    return G.around_relations(_near_relations(spark, d), table(spark, d, "relations"), table(spark, d, "entities"))


@query("X07_X10_vector_search", f"with {_NEAR} {_RANK} near")
def _(spark, d):
    return G.merge_contexts([_kind(_near_entities(spark, d), "entity"), _kind(_near_relations(spark, d), "relation"), _kind(_near_chunks(spark, d), "chunk")])


@query("X08_local_by_vectors", f"with {_LOCAL_NEAR} {_RANK} local")
def _(spark, d):
    return G.merge_contexts([_near_local(spark, d)])


@query("X09_global_by_vectors", f"with {_NEAR}, {_GLOBAL_NEAR} {_RANK} overall")
def _(spark, d):
    return G.merge_contexts([_near_global(spark, d)])


@query("X11_mixed_by_vectors", f"with {_LOCAL_NEAR}, {_GLOBAL_NEAR} {_RANK} (select * from local union select * from overall union select query, kind, key, score from near where kind = 'chunk')")
def _(spark, d):
    return G.merge_contexts([_near_local(spark, d), _near_global(spark, d), _kind(_near_chunks(spark, d), "chunk")])


_MODE = {
    "local": "select * from local", "global": "select * from overall", "hybrid": "select * from local union select * from overall",
    "mix": "select * from local union select * from overall union select query, kind, key, score from near where kind = 'chunk'",
}
_MODES = ", ".join(f"m_{m} as ({_RANK} ({q}))" for m, q in _MODE.items())
_BAD = "unknown mode naive; known: local, global, hybrid, mix"


@query("X11_X13_U02_modes", f"with {_LOCAL_NEAR}, {_GLOBAL_NEAR}, {_MODES} {' union all '.join(f'select *, {m!r} as mode from m_{m}' for m in _MODE)} union all select distinct query, 'error', '{_BAD}', 0.0, 1, 'naive' from near where kind = 'chunk'")
def _(spark, d):
    searches = {"local": _near_local(spark, d), "global": _near_global(spark, d), "vector": _kind(_near_chunks(spark, d), "chunk")}
    out = None
    for mode in ("local", "global", "hybrid", "mix", "naive"):
        part = G.unified(searches, mode)
        out = part if out is None else out.unionByName(part)
    return out


@query("J03_U03_neighbours", f"with {_HOPS} select node from one")
def _(spark, d):
    seeds = table(spark, d, "seed_entities").select(key_of("entity_id").alias("node"))
    return G.k_hop(seeds, G.edges_of(table(spark, d, "relations")), 1).filter("depth = 1").select("node")


@query("K12_S16_graph_files", f"with {_EDGES} select distinct source, target from edges")
def _(spark, d):
    at = f"{checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
    edges = G.edges_of(table(spark, d, "relations")).select("source", "target").distinct()
    files.write_graphml(at, edges.select(F.explode(F.array("source", "target")).alias("node")).distinct(), edges)
    # a node that only its edges name is none of the graph's, so edges come back through the nodes
    return G.induced(files.graphml(spark, f"{at}/edges")[1], files.graphml(spark, f"{at}/nodes")[0]).select("source", "target")


@query("J04_endpoints", f"with {_EDGES}, n as (select distinct {K % 'entity_id'} as node from entities where {T % 'entity_id'} <> '') select row_id, source, target from edges where source in (select node from n) and target in (select node from n)")
def _(spark, d):
    nodes = table(spark, d, "entities").filter(~is_blank("entity_id")).select(key_of("entity_id").alias("node"))
    return G.induced(G.edges_of(table(spark, d, "relations")), nodes).select("row_id", "source", "target")


@query("J05_documents_of_entities", f"with n as (select distinct {K % 'entity_id'} as node from seed_entities) select document_id, count(*) as n_rows from relations where {K % 'source_entity'} in (select node from n) or {K % 'target_entity'} in (select node from n) group by 1")
def _(spark, d):
    nodes = table(spark, d, "seed_entities").select(key_of("entity_id").alias("node")).distinct()
    r = table(spark, d, "relations").select("row_id", "document_id", F.explode(F.array_distinct(F.array(key_of("source_entity"), key_of("target_entity")))).alias("node"))
    return r.join(nodes, "node", "left_semi").select("row_id", "document_id").distinct().groupBy("document_id").agg(F.count("*").alias("n_rows"))


@query("A07_distinct_entities", f"select document_id, count(distinct {K % 'entity_id'}) as n_entities from entities where {T % 'entity_id'} <> '' group by 1")
def _(spark, d):
    e = table(spark, d, "entities").filter(F.length(strip("entity_id")) > 0)
    return e.groupBy("document_id").agg(F.countDistinct(key_of("entity_id")).alias("n_entities"))
