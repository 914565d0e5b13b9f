"""Queries of the general data problems (2 and 3) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import WHITE_SPACE
from cairn.operators.packed import split_packed
from cairn.operators.references import orphan_references, orphan_report, parents_of, references_of
from cairn.sources.tables import table

WS_SQL = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = references_of(table(spark, d, "relations"), "relations", ["source_entity", "target_entity"])
    refs = refs.unionByName(references_of(table(spark, d, "entity_index"), "entity_index", ["entity_id"]))
    parents = parents_of(table(spark, d, "entities")).unionByName(parents_of(table(spark, d, "seed_entities")))
    return orphan_references(refs, parents)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "row_id", "field")


def p2_states(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "row_id", "field", "state")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "doc_101_labeled"), "hit_id", "headers_norm")


def p3_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each header occurs, and at how many different positions."""
    return p3_found(spark, d).groupBy("val").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("n_pos"))


_KEY = f"lower(trim(%s, {WS_SQL}))"
_ORPHANS = f"""
    par as (
        select {_KEY % 'entity_id'} as key, loaded_at as a, deleted_at as b from entities
        union all
        select {_KEY % 'entity_id'}, loaded_at, deleted_at from seed_entities),
    ref as (
        select 'relations' as ref_table, row_id, 'source_entity' as field, {_KEY % 'source_entity'} as key, loaded_at as t from relations
        union all
        select 'relations', row_id, 'target_entity', {_KEY % 'target_entity'}, loaded_at from relations
        union all
        select 'entity_index', row_id, 'entity_id', {_KEY % 'entity_id'}, loaded_at from entity_index),
    orphans as (
        select ref_table, row_id, field, t,
            case when exists (select 1 from par where par.key = ref.key and par.a <= ref.t) then 'deleted'
                 when exists (select 1 from par where par.key = ref.key and par.a is not null) then 'late'
                 else 'missing' end as state
        from ref
        where key <> '' and not exists (
            select 1 from par where par.key = ref.key and par.a <= ref.t and (par.b is null or par.b > ref.t)))"""

QUERIES = {"p2_found": p2_found, "p2_states": p2_states, "p2_report": p2_report, "p3_found": p3_found, "p3_value_counts": p3_value_counts}

SQL = {
    "p2_found": f"with {_ORPHANS} select ref_table, row_id, field from orphans",
    "p2_states": f"with {_ORPHANS} select ref_table, row_id, field, state from orphans",
    "p2_report": f"with {_ORPHANS} select ref_table, strftime(t, '%Y-%m') as month, state, count(*) as n from orphans group by all",
}
