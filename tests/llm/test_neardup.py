import random
from itertools import combinations

import numpy as np
import pytest

from cairn.llm import neardup as N

SCHEMA = "hit_id bigint, chunk_id string, text string, content string, item string, rep string, body string, r bigint"


def hits(spark, rows):
    return spark.createDataFrame([(i, *r, "c", "c", "c", 1) for i, r in enumerate(rows)], SCHEMA)


def words(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz水泵阀门管道") for _ in range(n))


def corpus(rng):
    rows = []
    for i in range(60):
        base = words(rng, rng.randrange(80, 200))
        rows.append((f"d{i}-0", base, None))
        for k in range(rng.randrange(0, 4)):
            t = list(base)
            for _ in range(rng.randrange(0, 9)):
                p = rng.randrange(len(t))
                t[p : p + rng.randrange(0, 3)] = list(words(rng, rng.randrange(0, 3)))
            rows.append((f"d{i}-{k + 1}", "other text", "".join(t)))
    return rows


def brute(rows, least=0.7):
    body = {}
    for c, t, k in rows:
        if c is not None:
            b = k if k and k.strip() else t
            b = "".join((b or "").split())
            if len(b) >= 5:
                body[c] = b
    return {(a, b): j for a, b in combinations(sorted(body), 2) if (j := N.jaccard(body[a], body[b], 5)) >= least}


@pytest.mark.parametrize("small, hot, block", [(20, 2000, 2000), (2, 2000, 2000), (2, 3, 3)])
def test_all_pairs(spark, monkeypatch, small, hot, block):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(7)
    rows = corpus(rng)
    rows += rows[:20] + [(None, "abcdefgh", "abcdefgh"), ("short", "ab c", None), ("blank", " ", "　"), ("null", None, None), ("copy", "y", rows[0][1]), ("spaced", "y", " ".join(rows[0][1]))]
    got = [tuple(r) for r in N.item_pairs(*N.near_duplicates(hits(spark, rows))).collect()]
    want = brute(rows)
    assert len(got) == len(set(got))
    missed = {p: j for p, j in want.items() if p not in set(got)}
    assert not set(got) - set(want)
    assert len(missed) <= 0.005 * len(want), missed


def test_bound_is_a_guarantee(spark):
    """Signatures that differ in any BOUND symbols share a key."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 2**16, N.PARTS * N.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        b[rng.choice(len(a), N.BOUND, replace=False)] += np.uint16(1)
        k = N._masked(np.stack([a, b]), N.ERRORS)
        shared = np.array(sorted(set(k[0]) & set(k[1])), np.uint64)
        assert len(shared)
        # and second keys of the other chunks, whichever key they met under
        for key in shared:
            second = N._divided(np.array([key, key]), np.stack([a, b]))
            assert set(second[0]) & set(second[1])


def test_hot_buckets_are_divided(spark):
    """500 signatures that agree in four symbols of one chunk and in nothing else: their second buckets hold next to no pair."""
    rng = np.random.default_rng(8)
    sig = rng.integers(0, 2**16, (500, N.PARTS * N.SYMBOLS), dtype=np.uint16)
    sig[:, 2 * N.SYMBOLS : 2 * N.SYMBOLS + 4] = 7
    key = np.array([k for k, n in zip(*np.unique(N._masked(sig, N.ERRORS), return_counts=True)) if n == 500], np.uint64)
    assert len(key) == 1
    _, n = np.unique(N._divided(np.repeat(key, 500), sig), return_counts=True)
    assert (n * (n - 1) // 2).sum() < 0.01 * 500 * 499 / 2


def test_a_pair_leaves_one_bucket(spark, monkeypatch):
    """A dense group gives each of its pairs once, before anything is made distinct."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**16, N.PARTS * N.SYMBOLS, dtype=np.uint16)
    sig = np.repeat(base[None, :], 40, axis=0)
    for row in sig:
        row[rng.choice(len(row), 3, replace=False)] += rng.integers(1, 900, 3, dtype=np.uint16)
    r, seen = np.arange(40), []
    keys = N._masked(sig, N.ERRORS)
    for key in np.unique(keys):
        at = np.flatnonzero((keys == key).any(axis=1))
        i, j = N._agreeing(r[at], sig[at], r[at], sig[at])
        ok = N._first_here(sig[at][i], sig[at][j], np.full(len(i), key).view(np.int64), None)
        seen += list(zip(at[i[ok]].tolist(), at[j[ok]].tolist()))
    assert len(seen) == len(set(seen)) == 40 * 39 // 2
    signed = spark.createDataFrame([(int(i), bytearray(s.tobytes())) for i, s in zip(r, sig)], "r bigint, sig binary")
    for hot in (2000, 39):
        monkeypatch.setattr(N, "HOT", hot)
        assert N.candidates(signed).count() == 40 * 39 // 2


def test_groups_and_copies(spark):
    rng = random.Random(9)
    base = words(rng, 150)
    rows = [(f"a{i:03}", base, None) for i in range(30)] + [("b", base[:-4] + "zzzz", None), ("c", base[:-8] + "yyyyzzzz", None), ("lone", words(rng, 90), None)]
    pairs, members = N.near_duplicates(hits(spark, rows))
    assert {(r.a, r.b) for r in pairs.collect()} == {("a000", "b"), ("a000", "c"), ("b", "c")}
    g = {r["item"]: (r.group_id, r.n_links) for r in N.groups(pairs, members).collect()}
    assert g["a029"] == ("a000", 2) and g["c"] == ("a000", 2) and g["lone"] == ("lone", 0)
    few = N.item_pairs(pairs, members, copies=5).count()
    assert few == 29 + 3
    assert N.item_pairs(pairs, members).count() == 30 * 29 // 2 + 2 * 30 + 1


def test_components(spark):
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(25)] + [("x", "y"), ("z", "z")]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{i:02}": "n00" for i in range(26)} | {"x": "x", "y": "x"}


def test_empty(spark):
    pairs, members = N.near_duplicates(hits(spark, []))
    assert N.item_pairs(pairs, members).count() == 0
    assert N.groups(pairs, members).count() == 0
    assert N.item_pairs(*N.near_duplicates(hits(spark, [(None, None, None), ("a", None, None)]))).count() == 0
