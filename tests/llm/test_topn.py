import random

from cairn.llm.topn import top_n

SCHEMA = "query string, score double, chunk_id string, grp string, item string, rnk int, size int, salt int"


def run(spark, rows, n=3, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash", 1, 1, 1) for r in rows], SCHEMA)
    return [tuple(x) for x in top_n(df, n, **kw).orderBy("query", "rnk").collect()]


def brute(rows, n):
    best = {}
    for q, s, c in rows:
        q = (q or "").strip()
        if q and c is not None and s is not None and s == s:
            best[q, c] = max(s, best.get((q, c), float("-inf")))
    out = []
    for q in sorted({q for q, _ in best}):
        top = sorted(((-s, c) for (x, c), s in best.items() if x == q))[:n]
        out += [(q, c, -s, i) for i, (s, c) in enumerate(top, 1)]
    return out


def test_ties_copies_and_bad_rows(spark):
    rows = [
        ("a", 0.5, "z"), ("a ", 0.5, "y"), ("　a", 0.5, "x"), ("a", 0.5, "w"), ("a", 0.9, "z"), ("a", 0.9, "z"),
        ("b", float("inf"), "1"), ("b", float("nan"), "2"), ("b", None, "3"), ("b", -1.0, None),
        (None, 1.0, "1"), (" 　", 1.0, "1"), ("c", -0.0, "𝄞"), ("c", 0.0, "￮"), ("x" * 100_000, 1.0, "long"),
    ]
    assert run(spark, rows) == brute(rows, 3)


def test_hot_group_and_light_groups_agree_with_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"q{rng.randrange(30)}", round(rng.random(), 2), f"c{rng.randrange(900)}") for _ in range(3000)]
    want = brute(rows, 10)
    for heavy, slice_rows in ((20_000, 10_000), (100, 20), (0, 1)):
        assert run(spark, rows, 10, heavy=heavy, slice_rows=slice_rows) == want


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None, None)]) == []
