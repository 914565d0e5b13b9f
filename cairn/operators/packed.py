"""Problem 3: several values packed in one field."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import packed
from cairn.functions.shared import cut, tasks
from cairn.functions.text import is_blank

#: Bits for a mark or quote left standing unprotected inside a value, for each separator of a dialect, for spelling a character.
STRAY_BITS, SEPARATOR_BITS, CHARACTER_BITS = 12.0, 4.0, 8.0
#: Characters of parses that a task holds before it hands them on.
MOST_HELD = 4_000_000


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["field", "seps", "quoting", "own", "vals"], [pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.list_(pa.string())]
    out: list[list] = [[], [], [], [], []]
    held = 0
    for b in batches:
        for field in b.column("field").to_pylist():
            for seps, quoting, stray, values in packed.parses(packed.unwrap(field)):
                # what the dialect itself costs; one that tears a quote apart explains nothing and spells the field out
                quotes = sum((v[0] in packed.QUOTES) + (v[-1] in packed.QUOTES.values()) for v in values if len(v) > 1)
                own = SEPARATOR_BITS * len(seps) + STRAY_BITS * (max(0, stray) + quotes)
                own += CHARACTER_BITS * len(field) * sum(map(packed.broken, values))
                for x, v in zip(out, (field, seps, quoting, own, [v for v in values if v])):
                    x.append(v)
                held += 2 * len(field)
                if held > MOST_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)
                    out, held = [[], [], [], [], []], 0
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, fields, seps, quoting = (b.column(c).to_pylist() for c in ("id", "field", "seps", "quoting"))
        out: list[list] = [[], [], []]
        for i, f, s, q in zip(ids, fields, seps, quoting):
            for pos, v in enumerate(packed.slots(f, s, q), 1):
                if v:
                    for x, y in zip(out, (i, pos, v)):
                        x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field("id").type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["id", "pos", "val"])


def cheapest_dialects(fields: DataFrame) -> DataFrame:
    """For each distinct field (column field, not blank) the dialect with the shortest description: field, seps, quoting, bits.

    A parse costs the code lengths of its values plus its separators and the marks it leaves unprotected inside values.
    The code length of a value is log2(N / n) for n of all N values that any candidate parse of any field gives, plus
    its spelling divided by n: what the corpus repeats is cheap, what a wrong split or a missed split produces is dear.
    Equal costs go to the dialect with more separators, then to the one that reads quotes, then by the marks.
    """
    cand = cut(fields.repartition(tasks(fields.sparkSession), "field").mapInArrow(_candidates, "field string, seps string, quoting boolean, own double, vals array<string>"))
    # a field's candidates name the same value several times; it counts once per field
    each = cand.select(F.xxhash64("field").alias("f"), "seps", "quoting", F.explode("vals").alias("v"))
    codes = each.select("f", "v").distinct().groupBy("v").agg(F.count("*").alias("n"))
    codes = cut(codes.select(F.xxhash64("v").alias("h"), F.length("v").alias("len"), "n"))
    total = codes.agg(F.sum("n")).first()[0] or 1
    bits = F.log2(F.lit(float(total)) / F.col("n")) + F.col("len") * CHARACTER_BITS / F.col("n")
    spent = (
        each.select("f", "seps", "quoting", F.xxhash64("v").alias("h"))
        .join(codes.select("h", bits.alias("bits")), "h")
        .groupBy("f", "seps", "quoting")
        .agg(F.sum("bits").alias("bits"))
    )
    scored = cand.select("field", F.xxhash64("field").alias("f"), "seps", "quoting", "own").join(spent, ["f", "seps", "quoting"], "left")
    cost = F.round(F.col("own") + F.coalesce("bits", F.lit(0.0)), 6)
    rank = F.struct(cost.alias("cost"), (-F.length("seps")).alias("n"), (~F.col("quoting")).alias("q"), F.col("seps").alias("s"))
    best = scored.groupBy("field").agg(F.min(rank).alias("m"))
    return best.select("field", F.col("m.s").alias("seps"), (~F.col("m.q")).alias("quoting"), F.col("m.cost").alias("bits"))


def split_packed(df: DataFrame, id_col: str = "hit_id", field: str = "headers_norm") -> DataFrame:
    """One row per value packed in a field: the id, pos (int, slots from 1) and val.

    A null or blank field gives no row; a slot without a value counts but gives none. Rows with the same field text
    share one dialect, found on the distinct texts, and each row is parsed by it. Repeated rows give repeated values;
    fields of any length are read whole, with any number of marks; other columns are ignored.
    """
    rows = df.filter(~is_blank(field)).select(F.col(id_col).alias("id"), F.col(field).alias("field"))
    chosen = cheapest_dialects(rows.select("field").distinct())
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.join(chosen.select("field", "seps", "quoting"), "field").mapInArrow(_parse, f"id {id_type}, pos int, val string")
    return out.select(F.col("id").alias(id_col), "pos", "val")
