import random

import pytest

from cairn.llm.mixing import mix, mix_goals, mix_shares

SIZED = "doc_id bigint, source string, n_tokens bigint, repeats int, rate double, cls int, salt int"
TARGETS = "source string, target_share double, max_repeats int"


def make(spark, docs, targets):
    return spark.createDataFrame([(*d, 1, 1.0, 1, 1) for d in docs], SIZED), spark.createDataFrame(targets, TARGETS)


def test_goals_fill_up_to_the_caps(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 890), (None, 0)], "source string, size bigint")
    targets = spark.createDataFrame([("a", 0.5, 10), ("b", 0.3, 2), ("c", 0.1, 1), ("none", 0.1, 4)], TARGETS)
    got = {r.source: round(r.goal, 6) for r in mix_goals(sizes, targets).collect()}
    left = 1000 - 20
    assert got == {"a": round(left * 0.5 / 0.6, 6), "b": 20.0, "c": round(left * 0.1 / 0.6, 6), "none": 0.0}
    capped = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    assert {r.source: r.goal for r in mix_goals(sizes, capped).collect()} == {"a": 100.0, "b": 10.0}


def test_shares_and_caps(spark):
    rng = random.Random(3)
    docs = [(i, "big" if rng.random() < 0.6 else rng.choice(["mid", "small", "unlisted"]), int(rng.lognormvariate(5, 1))) for i in range(4000)]
    targets = [("big", 0.3, 1), ("mid", 0.4, 8), ("small", 0.2, 8), ("absent", 0.1, 3)]
    df, t = make(spark, docs, targets)
    rows = mix(df, t).collect()
    cap = {s: m for s, _, m in targets}
    assert sorted(r.doc_id for r in rows) == sorted(d for d, s, _ in docs if s in cap)
    assert all(0 <= r.repeats <= cap[r.source] for r in rows)
    shares = {r.source: r for r in mix_shares(df, t).collect()}
    assert shares["absent"].mix_size == 0
    assert sum(r.mix_size for r in shares.values()) == pytest.approx(sum(n for *_, n in docs), rel=0.01)
    for s, want in (("big", 0.3), ("mid", 0.4), ("small", 0.2)):
        assert shares[s].actual_share == pytest.approx(want / 0.9, rel=0.02)
    again = {(r.doc_id, r.repeats) for r in mix(df.repartition(7), t).collect()}
    assert again == {(r.doc_id, r.repeats) for r in rows}


def test_odd_rows(spark):
    docs = [(1, "a", 0), (2, "a", None), (3, "a", 5), (4, None, 5), (None, "a", 5), (3, "a", 5)]
    df, t = make(spark, docs, [("a", 1.0, 1), (None, 0.5, 1), ("b", None, 2), ("c", 0.1, None)])
    got = sorted((r.doc_id or 0, r.repeats) for r in mix(df, t).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    empty, none = make(spark, [], [])
    assert mix(empty, t).count() == 0
    assert mix(df, none).count() == 0
    assert mix_shares(empty, t).filter("mix_size > 0").count() == 0
