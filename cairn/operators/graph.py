"""Building and searching a graph of entities (nodes) and relations (edges)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.fields import keyword_list, moment
from cairn.functions.text import is_blank, strip
from cairn.operators.ranking import top_per_group
from cairn.operators.references import key_of

#: Scores of what a search finds by following the graph instead of by likeness.
NEIGHBOUR, EDGE, ENDPOINT = 0.5, 0.6, 0.8


def _distinct_text(df: DataFrame, by: Sequence[str], text: str, sep: str, order: str | None = None) -> DataFrame:
    """The different non-blank texts of each group joined in order (of the texts, or of each text's smallest ``order``).

    Equal texts are merged before they are gathered, so copies of a record don't add up in one task.
    """
    one = df.filter(~is_blank(text)).groupBy(*by, F.col(text).alias("t")).agg(F.min(order if order else text).alias("o"))
    parts = F.array_sort(F.collect_list(F.struct("o", "t")))
    return one.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias(text))


def merge_entities(entities: DataFrame, seq: str = "row_id") -> DataFrame:
    """One row per name and type: entity_name, entity_type, first_id, n, description (sorted set joined by `` | ``).

    The first row gives what else there is: entity_id, source_chunk_id, document_id. Null names and types make groups
    of their own; a group with blank descriptions only has a null one.
    """
    by = ["entity_name", "entity_type"]
    rows = entities.withColumns({c: F.coalesce(c, F.lit("")) for c in by})
    first = F.min_by(F.struct("entity_id", "source_chunk_id", "document_id"), seq)
    head = rows.groupBy(*by).agg(F.min(seq).alias("first_id"), F.count("*").alias("n"), first.alias("f")).select(*by, "first_id", "n", "f.*")
    return head.join(_distinct_text(rows, by, "description", " | "), by, "left")


def merge_relations(relations: DataFrame, seq: str = "row_id") -> DataFrame:
    """One row per source, target and type: n, weight (sum, 1 where null), the first row's keywords, description (sorted set joined by `` | ``)."""
    by = ["source_entity", "target_entity", "relation_type"]
    rows = relations.withColumns({c: F.coalesce(c, F.lit("")) for c in by})
    first = F.min_by(F.struct("keywords"), seq)
    head = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("weight", F.lit(1.0))), 6).alias("weight"), first.alias("f")).select(*by, "n", "weight", "f.*")
    return head.join(_distinct_text(rows, by, "description", " | "), by, "left")


def upsert_entities(stored: DataFrame, new: DataFrame, by: str = "entity_id") -> DataFrame:
    """The stored entities after the new ones came in: one row per key, type and document of the latest row.

    Keys are entity ids (or names, by another column) without white space and case; descriptions are joined by ``;`` in
    the order in which each first came, and one that is there already isn't added again. Rows with a blank key are left out.
    """
    rows = stored.unionByName(new).withColumn("key", key_of(by)).filter(~is_blank(by))
    latest = F.max_by(F.struct("entity_type", "document_id"), F.struct("loaded_at", "row_id"))
    head = rows.groupBy("key").agg(latest.alias("l"), F.count("*").alias("n"))
    text = _distinct_text(rows, ["key"], "description", ";", "row_id")
    return head.join(text, "key", "left").select("key", F.col("l.entity_type").alias("entity_type"), F.col("l.document_id").alias("document_id"), "n", "description")


def upsert_relations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored relations after the new ones: one row per source, target and type with summed weight and united keywords."""
    rows = stored.unionByName(new).filter(~is_blank("source_entity") & ~is_blank("target_entity"))
    rows = rows.withColumns({"source": key_of("source_entity"), "target": key_of("target_entity"), "kind": F.coalesce("relation_type", F.lit(""))})
    by = ["source", "target", "kind"]
    head = rows.groupBy(*by).agg(F.round(F.sum(F.coalesce("weight", F.lit(1.0))), 6).alias("weight"))
    words = rows.select(*by, F.explode(keyword_list("keywords")).alias("w")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("keywords"))
    text = _distinct_text(rows, by, "description", ";", "row_id")
    return head.join(words, by, "left").join(text, by, "left")


def upsert_metadata(stored: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Metadata of every document: counts of what was extracted; the latest status and namespace, ``processing`` if it is new."""
    last = F.max(F.struct(F.coalesce(moment("updated_at"), F.expr("timestamp_ntz '0001-01-01 00:00:00'")).alias("at"), F.coalesce("status", F.lit("")).alias("status")))
    one = stored.filter("document_id is not null").groupBy("document_id").agg(F.max("namespace").alias("namespace"), last.alias("l"))
    one = one.select("document_id", "namespace", F.nullif("l.status", F.lit("")).alias("status"))
    ents = entities.filter("document_id is not null").groupBy("document_id").agg(F.count("*").cast("int").alias("entity_count"))
    rels = relations.filter("document_id is not null").groupBy("document_id").agg(F.count("*").cast("int").alias("relation_count"))
    all_ = one.join(ents, "document_id", "full").join(rels, "document_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return all_.select("document_id", "namespace", F.coalesce("status", F.lit("processing")).alias("status"), zero("entity_count"), zero("relation_count"))


def edges_of(relations: DataFrame) -> DataFrame:
    """The edges of the graph by key: row_id, source, target, relation_type, weight. Blank ends and loops are left out."""
    rows = relations.filter(~is_blank("source_entity") & ~is_blank("target_entity"))
    rows = rows.select("row_id", key_of("source_entity").alias("source"), key_of("target_entity").alias("target"), "relation_type", "weight", "loaded_at")
    return rows.filter("source <> target")


def simple_edges(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair of nodes with what the latest row says: a, b, relation_type, weight."""
    last = F.max_by(F.struct("relation_type", "weight"), F.struct("loaded_at", "row_id"))
    g = edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(last.alias("l"))
    return g.select("a", "b", F.col("l.relation_type").alias("relation_type"), F.col("l.weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each connection once in either direction: u, v."""
    return edges.select(F.col("source").alias("u"), F.col("target").alias("v")).unionByName(edges.select(F.col("target").alias("u"), F.col("source").alias("v"))).distinct()


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges (unordered pairs) and average degree (0 for an empty graph) in one row."""
    links = both_ways(edges)
    nodes = links.agg(F.countDistinct("u").alias("n_nodes"), F.floor(F.count("*") / 2).alias("n_edges"))
    return nodes.withColumn("average_degree", F.coalesce(F.round(F.try_divide(F.col("n_edges") * 2.0, "n_nodes"), 6), F.lit(0.0)))


def k_hop(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """The nodes within ``depth`` steps of any seed and how near they are: node, depth. A seed is at 0, linked or not.

    Breadth first: each level joins the last one's nodes with the edges and leaves out what was reached before. The
    loop runs ``depth`` times, not once per node.
    """
    links = both_ways(edges)
    reached = seeds.select(F.col("node")).distinct().withColumn("depth", F.lit(0))
    level = reached.select("node")
    for n in range(1, depth + 1):
        nxt = level.join(links, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct()
        level = nxt.join(reached.select("node"), "node", "left_anti")
        reached = reached.unionByName(level.withColumn("depth", F.lit(n)))
    return reached


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    n = nodes.select("node").distinct()
    a = edges.join(n.withColumnRenamed("node", "source"), "source", "left_semi")
    return a.join(n.withColumnRenamed("node", "target"), "target", "left_semi")


def named_like(queries: DataFrame, rows: DataFrame, name: str, key: Column, k: int) -> DataFrame:
    """Per query the k rows whose text holds the query, by the share of it: query, key, score.

    Equal keys count once with their best score. The queries are few (a stated set); each row is compared with all of
    them in its task, nothing is shuffled before the best k.
    """
    q = queries.select(F.lower(strip("query")).alias("query")).filter("query <> ''").distinct()
    text = F.lower(strip(name))
    hit = rows.select(key.alias("key"), text.alias("text")).filter("key <> '' and text <> ''").join(q, F.expr("instr(text, query) > 0"))
    hit = hit.groupBy("query", "key").agg(F.max(F.round(F.length("query") / F.length("text"), 6)).alias("score"))
    return top_per_group(hit, ["query"], [F.col("score").desc(), F.col("key")], k).drop("rank")


def local_search(queries: DataFrame, entities: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Entities like the query, their neighbours and the edges between: query, kind, key, score."""
    return around_entities(named_like(queries, entities, "entity_name", key_of("entity_id"), k), edges)


def around_entities(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Found entities (query, key, score), their neighbours and the edges between: query, kind, key, score."""
    links = both_ways(edges)
    near = hits.join(links, F.col("key") == F.col("u")).select("query", F.col("v").alias("node"))
    near = near.join(hits.select("query", F.col("key").alias("node")), ["query", "node"], "left_anti").distinct()
    ways = hits.select("query", F.col("key").alias("node"))
    used = ways.join(edges, F.col("node") == F.col("source")).unionByName(ways.join(edges, F.col("node") == F.col("target")))
    parts = [
        hits.select("query", F.lit("entity").alias("kind"), "key", "score"),
        near.select("query", F.lit("entity").alias("kind"), F.col("node").alias("key"), F.lit(NEIGHBOUR).alias("score")),
        used.select("query", F.lit("relation").alias("kind"), F.col("row_id").cast("string").alias("key"), F.lit(EDGE).alias("score")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def global_search(queries: DataFrame, relations: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
    """Relations like the query, their ends among the entities and the chunks of those: query, kind, key, score (0 for chunks)."""
    return around_relations(named_like(queries, relations, "description", F.col("row_id").cast("string"), k), relations, entities)


def around_relations(hits: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Found relations (query, key, score), their ends among the entities and the chunks of those: query, kind, key, score (0 for chunks)."""
    rows = relations.select(F.col("row_id").cast("string").alias("key"), "source_entity", "target_entity")
    ends = hits.join(rows, "key").select("query", F.explode(F.array(key_of("source_entity"), key_of("target_entity"))).alias("node")).distinct()
    known = entities.filter(~is_blank("entity_id")).select(key_of("entity_id").alias("node"), "source_chunk_id")
    found = ends.join(known, "node")
    parts = [
        hits.select("query", F.lit("relation").alias("kind"), "key", "score"),
        found.select("query", F.lit("entity").alias("kind"), F.col("node").alias("key"), F.lit(ENDPOINT).alias("score")),
        found.filter(~is_blank("source_chunk_id")).select("query", F.lit("chunk").alias("kind"), F.col("source_chunk_id").alias("key"), F.lit(0.0).alias("score")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


#: Which searches a mode unites.
MODES = {"local": ("local",), "global": ("global",), "hybrid": ("local", "global"), "mix": ("local", "global", "vector")}


def unified(searches: dict[str, DataFrame], mode: str = "mix", k: int | None = None) -> DataFrame:
    """The results of the searches that a mode unites: mode, query, kind, key, score, rank.

    searches: local, global and vector, each query, kind, key, score; those that the mode doesn't name aren't run. An
    unknown mode gives one row of kind ``error`` for each query of the vector search.
    """
    if mode in MODES:
        return merge_contexts([searches[m] for m in MODES[mode]], k).withColumn("mode", F.lit(mode))
    asked = searches["vector"].select("query").distinct()
    said = f"unknown mode {mode}; known: {', '.join(MODES)}"
    return asked.select("query", F.lit("error").alias("kind"), F.lit(said).alias("key"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"), F.lit(mode).alias("mode"))


def merge_contexts(parts: Sequence[DataFrame], k: int | None = None) -> DataFrame:
    """Results of several searches as one list per query and kind: query, kind, key, score, rank.

    Rows that agree in all fields count once; the same key with two scores stays twice. Higher scores first, then keys.
    """
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_per_group(out.distinct(), ["query", "kind"], [F.col("score").desc(), F.col("key")], k or 2**31 - 1)
