from datetime import datetime, timedelta

import pytest

from cairn.operators.references import orphan_references, orphan_report, parents_of, references_of

T = datetime(2025, 1, 1)
REL = "row_id bigint, source_entity string, target_entity string, loaded_at timestamp_ntz, ref_table string, ts int"
ENT = "entity_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, key string"


def day(n):
    return None if n is None else T + timedelta(days=n)


def found(spark, rel, ent, **kw):
    r = spark.createDataFrame([(i, s, t, day(at), "clash", 1) for i, s, t, at in rel], REL)
    e = spark.createDataFrame([(k, day(a), day(b), "clash") for k, a, b in ent], ENT)
    out = orphan_references(references_of(r, "relations", ["source_entity", "target_entity"]), parents_of(e), **kw)
    return {(x.row_id, x.field[0], x.state) for x in out.collect()}


@pytest.mark.parametrize("slice_seconds", [86_400, 10_000_000_000])
def test_states(spark, slice_seconds):
    ent = [("E1", 0, None), ("e2", 0, 5), ("e2", 9, None), ("e3", 8, None), ("e4", 1, 3), ("e4", 1, 3), (None, 0, None), ("", 0, None), ("e5", None, None)]
    rel = [
        (1, " e1　", "E1", 3),
        (2, "e2", "e2", 5),
        (3, "e2", "missing", 4),
        (4, "e3", "e4", 2),
        (5, "e4", None, 4),
        (6, "  ", "", 4),
        (7, "e2", "e2", 10),
        (8, "e1", "gone", None),
        (9, "e5", "e1", 0),
    ]
    assert found(spark, rel, ent, slice_seconds=slice_seconds) == {
        (2, "s", "deleted"),
        (2, "t", "deleted"),
        (3, "t", "missing"),
        (4, "s", "late"),
        (5, "s", "deleted"),
        (8, "s", "late"),
        (8, "t", "missing"),
        (9, "s", "missing"),
    }


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    ent = []
    for _ in range(300):
        a = rng.randrange(60)
        ent.append((f"k{min(rng.randrange(20), 8)}", a, rng.choice([None, a + rng.randrange(1, 20)])))
    rel = [(i, f"k{min(rng.randrange(25), 8)}" if rng.random() < 0.9 else "nobody", f"k{rng.randrange(25)}", rng.randrange(80)) for i in range(400)]
    want = set()
    for i, s, t, at in rel:
        for f, k in (("s", s), ("t", t)):
            mine = [(a, b) for e, a, b in ent if e == k]
            if any(a <= at and (b is None or b > at) for a, b in mine):
                continue
            want.add((i, f, "deleted" if any(a <= at for a, _ in mine) else "late" if mine else "missing"))
    assert found(spark, rel, ent) == want


def test_empty(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [(1, "a", "b", 1)], []) == {(1, "s", "missing"), (1, "t", "missing")}
    assert found(spark, [], [("a", 0, None)]) == set()


def test_report(spark):
    r = spark.createDataFrame([(1, "a", None, day(3)), (2, "a", "b", day(40)), (3, "a", None, None)], "row_id bigint, source_entity string, target_entity string, loaded_at timestamp_ntz")
    e = spark.createDataFrame([], ENT)
    out = orphan_report(orphan_references(references_of(r, "relations", ["source_entity", "target_entity"]), parents_of(e)))
    assert {(x.month, x.n) for x in out.collect()} == {("2025-01", 1), ("2025-02", 2), (None, 1)}


def test_hub_on_one_day(spark):
    """References of one key and one time are dealt out over several merges; the states stay the same."""
    ent = [("hub", 0, 3), ("hub", 3, 5), ("hub", 3, 4), ("later", 9, None)]
    rel = [(i, "hub" if i % 3 else "later", "hub", 3 if i % 2 else 5) for i in range(900)] + [(901, "hub", "hub", None)]
    want = {(i, "t", "deleted") for i in range(900) if not i % 2} | {(i, "s", "deleted") for i in range(900) if i % 3 and not i % 2}
    want |= {(i, "s", "late") for i in range(900) if not i % 3} | {(901, "s", "late"), (901, "t", "late")}
    for most in (50_000, 100, 1):
        assert found(spark, rel, ent, most=most) == want


def test_no_task_gets_a_hub(spark):
    """One key at one time with 100,000 references: no merge holds more than a few per cent of them."""
    from pyspark.sql import functions as F

    refs = spark.range(100_000).select(F.lit("r").alias("ref_table"), F.col("id").alias("row_id"), F.lit("f").alias("field"), F.lit("hub").alias("key"), F.lit(day(1)).cast("timestamp_ntz").alias("ts"))
    parents = spark.createDataFrame([("hub", day(0), day(1))], "key string, start timestamp_ntz, end timestamp_ntz")
    out = orphan_references(refs, parents, most=2_000).withColumn("p", F.spark_partition_id())
    assert out.count() == 100_000 and out.filter("state = 'deleted'").count() == 100_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan.split("windowspecdefinition")[1]
