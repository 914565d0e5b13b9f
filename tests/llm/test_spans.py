import random

import numpy as np
import pytest

from cairn.llm import spans as S
from cairn.llm.fm_index import FMIndex, WaveletMatrix

SCHEMA = "doc_id bigint, text string, a bigint, h string, lo int, seg string"


def brute(docs, least):
    seen = {}
    for i, t in docs:
        if i is not None and t:
            for k in range(len(t) - least + 1):
                seen.setdefault(t[k : k + least], set()).add(i)
    cover = {}
    for i, t in docs:
        if i is not None and t:
            for k in range(len(t) - least + 1):
                if len(seen[t[k : k + least]]) > 1:
                    cover.setdefault(i, set()).update(range(k, k + least))
    out = set()
    for i, at in cover.items():
        start = prev = None
        for k in sorted(at):
            if prev is None or k > prev + 1:
                if prev is not None:
                    out.add((i, start + 1, prev - start + 1))
                start = k
            prev = k
        out.add((i, start + 1, prev - start + 1))
    return out


def run(spark, docs, least=200, **kw):
    df = spark.createDataFrame([(*d, 1, "clash", 1, "clash") for d in docs], SCHEMA)
    got = [tuple(r) for r in S.shared_spans(df, least, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def passage(rng, n):
    return "".join(rng.choice("abcdefgh 水泵阀门，。\n") for _ in range(n))


def corpus(rng):
    shared = [passage(rng, n) for n in (120, 199, 200, 201, 350, 900)]
    docs = []
    for i in range(60):
        t = ""
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            cut = rng.randrange(0, 60) if rng.random() < 0.4 else 0
            t += passage(rng, rng.randrange(0, 150)) + s[cut:]
        docs.append((i, t + passage(rng, rng.randrange(0, 100))))
    return docs


@pytest.mark.parametrize("shard", [400_000, 3000, 500])
def test_against_brute_force(spark, shard):
    """The smallest shard makes the common anchors hot."""
    docs = corpus(random.Random(11))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "short"), (None, docs[5][1]), (105, passage(random.Random(1), 250) * 2)]
    docs.append((5, docs[5][1]))  # the same row twice
    assert run(spark, docs, shard=shard) == brute(docs, 200)


@pytest.mark.parametrize("size", [70, 150, 185, 199])
def test_boilerplate(spark, size):
    """A passage shorter than a window stands in all documents; only where more is equal around it is anything shared."""
    rng = random.Random(size)
    b, tails = passage(rng, size), [passage(rng, 130) for _ in range(4)]
    docs = [(i, passage(rng, rng.randrange(100)) + b + (tails[i % 4] if i % 3 == 0 else passage(rng, 140))) for i in range(60)]
    want = brute(docs, 200)
    assert want and run(spark, docs, shard=2000) == want


def test_repetitive_text(spark):
    docs = [(1, "ab" * 400), (2, "x" + "ab" * 150 + "y"), (3, "a" * 500), (4, "a" * 230 + "b" * 300)]
    assert run(spark, docs) == brute(docs, 200)


def test_long_text(spark, monkeypatch):
    rng = random.Random(2)
    s = passage(rng, 300)
    long = passage(rng, 50_000) + s + passage(rng, 50_000)
    got = run(spark, [(1, long), (2, s), (3, passage(rng, 300))])
    assert (2, 1, 300) in got and any(d == 1 and a <= 50_001 and a + n >= 50_301 for d, a, n in got)
    want = S.anchors_of([long], 200)
    parts = [np.concatenate(x) for x in zip(*S._long(long, 200, step=7000))]
    windows = lambda r: {(int(h), k) for _, h, lo, hi in zip(*r) for k in range(lo, hi + 1)}
    assert windows(want) == windows(parts)


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, None), (None, "x" * 300), (2, "y" * 300)]) == set()


def test_share(spark):
    df = spark.createDataFrame([(1, "z" * 50 + "ab" * 100), (2, "ab" * 100), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_chars, r.shared_chars, r.share) for r in S.shared_share(df, S.shared_spans(df)).collect()}
    assert got == {1: (250, 200, 0.8), 2: (200, 200, 1.0), 3: (0, 0, None), 4: (0, 0, None)}


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 37, 5000)
    w = WaveletMatrix(s, 37)
    at, c = rng.integers(0, 5001, 300), rng.integers(0, 37, 300)
    assert w.rank(c, at).tolist() == [int((s[:i] == x).sum()) for i, x in zip(at, c)]


def test_matching_statistics():
    rng = random.Random(0)
    for _ in range(60):
        least, base = rng.choice([3, 5, 8]), "".join(rng.choice("abc中") for _ in range(60))
        texts = []
        for _ in range(rng.randint(1, 12)):
            a = rng.randrange(50)
            texts.append("".join(rng.choice("abc") for _ in range(rng.randint(1, 15))) + base[a : a + rng.randint(0, 30)])
        own = np.array([rng.choice([-1, 1, 2, 3]) for _ in texts])
        arr = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        ask = np.flatnonzero(own >= 0)
        if len(ask):
            held = {}
            for t, o in zip(texts, own):
                for i in range(len(t) - least + 1):
                    held.setdefault(t[i : i + least], set()).add(int(o))
            got = FMIndex(arr, own, least + 1).matches([arr[i] for i in ask], own[ask], least)
            for k, i in enumerate(ask):
                t = texts[i]
                want = [x for x in range(len(t) - least + 1) if held[t[x : x + least]] - {int(own[i])}]
                assert got[k].tolist() == want
