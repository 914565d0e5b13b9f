"""Problem 2: references to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.shared import cut
from cairn.functions.text import is_blank, strip

STATES = ("missing", "deleted", "late")
#: Into how many parts references are dealt where those of heavy slices are marked as such.
DEALS = 64


def key_of(c: Column | str) -> Column:
    """A key as it is compared: without outer white space, in lower case."""
    return F.lower(strip(c))


def references_of(df: DataFrame, table: str, fields: Sequence[str], row_id: str = "row_id", at: str = "loaded_at") -> DataFrame:
    """One row per non-blank reference: ref_table, row_id, field, key, ts."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = df.select(F.lit(table).alias("ref_table"), F.col(row_id).alias("row_id"), F.col(at).alias("ts"), F.explode(pairs).alias("p"))
    rows = rows.filter(~is_blank("p.value"))
    return rows.select("ref_table", "row_id", F.col("p.field").alias("field"), key_of("p.value").alias("key"), "ts")


def parents_of(df: DataFrame, key: str = "entity_id", start: str = "loaded_at", end: str = "deleted_at") -> DataFrame:
    """One row per parent record with the time it holds: key, start, end (null while it stands)."""
    rows = df.filter(~is_blank(key) & F.col(start).isNotNull())
    return rows.select(key_of(key).alias("key"), F.col(start).alias("start"), F.col(end).alias("end"))


def orphan_references(references: DataFrame, parents: DataFrame, slice_seconds: int = 86_400, most: int = 50_000) -> DataFrame:
    """References whose key no parent record holds at the reference's time: ref_table, row_id, field, ts, state.

    A parent holds from ``start`` (included) to ``end`` (excluded; null: for good). state is ``missing`` if no parent
    ever had the key, ``late`` if parents came only after the reference, and ``deleted`` if all earlier ones had
    ended. A reference without a time is held by none: ``late`` if the key has a parent at any time, else ``missing``.
    Several parents of one key, overlapping or repeated, count together; repeated references each give a row.

    Both streams are cut by key and time slice, co-partitioned and sorted, and merged in one pass that carries the
    latest end seen so far. What earlier slices of a key hand on is summed up per slice first, so a key that holds a
    third of all rows is spread over as many tasks as it has slices. A slice with more than ``most`` references of one
    key (a bulk load that stamps one time) is dealt out further, by salt: each part gets the slice's parents, of which
    one per point in time is kept, and is merged alone.
    """
    never = F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00"))
    # references without a time have a slice of their own before all others
    slice_of = lambda c: F.coalesce(F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / slice_seconds), F.lit(-(1 << 62)))
    par = parents.select("key", F.col("start").alias("ts"), F.coalesce("end", never).alias("until")).withColumn("slice", slice_of("ts"))
    par = par.groupBy("key", "slice", "ts").agg(F.max("until").alias("until"))
    ref = references.select("key", "ts", "ref_table", "row_id", "field").withColumn("slice", slice_of("ts"))
    ref = ref.withColumn("deal", F.pmod(F.xxhash64("row_id", "field"), F.lit(DEALS)))

    # per key and slice: the latest end that parents of the slice reach, what all earlier slices hand on, and the references
    ends = par.groupBy("key", "slice").agg(F.max("until").alias("until"), F.lit(0).cast("bigint").alias("n"))
    asked = cut(ref.groupBy("key", "slice").agg(F.lit(None).cast("timestamp_ntz").alias("until"), F.count("*").alias("n")))
    by_key = Window.partitionBy("key")
    before = by_key.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = ends.unionByName(asked).groupBy("key", "slice").agg(F.max("until").alias("until"), F.sum("n").alias("n"))
    carried = per.withColumn("carry", F.max("until").over(before)).withColumn("known", F.count("until").over(by_key) > 0)
    salts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0).cast("bigint")))
    carried = carried.select("key", "slice", F.explode(salts).alias("salt"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("carry").alias("until"), "known", F.lit(0).alias("kind"))

    # heavy slices, if there are any, are known by their counts; references meet them by key, slice and deal, so no task reads a whole one
    zero = F.lit(0).cast("bigint")
    heavy = asked.filter(F.col("n") > most).select("key", "slice", F.ceil(F.col("n") / most).alias("parts"))
    if heavy.isEmpty():
        ref, par = ref.withColumn("salt", zero), par.withColumn("salt", zero)
    else:
        dealt = heavy.withColumn("deal", F.explode(F.sequence(zero, F.lit(DEALS - 1).cast("bigint"))))
        ref = ref.join(dealt, ["key", "slice", "deal"], "left")
        ref = ref.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("field", "row_id"), F.col("parts")), zero))
        par = par.join(heavy, ["key", "slice"], "left")
        par = par.withColumn("salt", F.explode(F.sequence(zero, F.coalesce(F.col("parts") - 1, zero))))

    none = lambda t: F.lit(None).cast(t)
    row = F.struct("ref_table", "row_id", "field")
    kind = ref.select(row.alias("r")).schema["r"].dataType
    stream = (
        carried.withColumn("ref", none(kind))
        .unionByName(par.select("key", "slice", "salt", "ts", "until", none("boolean").alias("known"), F.lit(1).alias("kind"), none(kind).alias("ref")))
        .unionByName(ref.select("key", "slice", "salt", "ts", none("timestamp_ntz").alias("until"), none("boolean").alias("known"), F.lit(2).alias("kind"), row.alias("ref")))
    )
    # the carried row has no time and sorts first; at equal times parents come before references
    merged = Window.partitionBy("key", "slice", "salt").orderBy(F.col("kind") > 0, F.col("ts").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = F.max("until").over(merged)
    known = F.max("known").over(merged)
    out = stream.withColumn("held", F.when(F.col("ts").isNotNull(), held)).withColumn("known", known).filter("kind = 2")
    state = F.when(F.col("held") > F.col("ts"), None).when(F.col("held").isNotNull(), "deleted").when(F.col("known"), "late").otherwise("missing")
    return out.select("ref.*", "ts", state.alias("state")).filter("state is not null")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month of the reference's time and state: ref_table, month (yyyy-MM, null without a time), state, n."""
    return orphans.groupBy("ref_table", F.date_format("ts", "yyyy-MM").alias("month"), "state").agg(F.count("*").alias("n"))
