import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.BYTE_BPE_50K.path), reason="no vocabulary here")
SCHEMA = "doc_id bigint, text string, ids string, cores string, h string"
PIECES = st.sampled_from(["it's", " word", "水箱，", "。", "  ", "\n\n", "123", "4.5", "don't", "'s", " ", "\t", "é", "ｆ", "𝄞", "<|endoftext|>", "...", "A", "-", "　", "中文字", "​", "፩", "龥"])


def ids(text):
    return T.encoder(T.BYTE_BPE_50K).encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_safe_points_divide_without_a_trace(text):
    raw = text.encode()
    at = [0, *T.safe_points(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
    parts = [raw[a:b].decode() for a, b in zip(at, at[1:])]
    assert [i for p in parts for i in ids(p)] == ids(text)


def test_special_strings_are_ordinary_text():
    assert 50256 not in ids("a<|endoftext|>b")


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in texts], SCHEMA)
    return [(r.doc_id, r.ids) for r in T.encode_corpus(df).collect()]


def test_exact_for_all_texts(spark):
    rng = random.Random(5)
    word = lambda: rng.choice([" pump", " 水箱", "，", ". ", " 12", "\r\n", "valve", "的", "'s", "  "])
    shared = ["".join(word() for _ in range(400)) for _ in range(6)]
    texts = [(i, "".join(word() for _ in range(rng.randrange(50))) + rng.choice(shared) + "".join(word() for _ in range(rng.randrange(50)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "   \n"), (103, "a"), (104, shared[0]), (105, shared[0]), (106, "​﻿" + shared[1]), (107, "x" * 5000)]
    texts += [(7, shared[2] + "same id, other text"), (None, shared[3]), (108, shared[0] * 30)]
    got = run(spark, texts)
    want = [(i, ids(t) if t else []) for i, t in texts]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_cores_are_shared(spark):
    body = " ".join(f"pump {i} feeds valve {i * 7}." for i in range(200))
    df = spark.createDataFrame([(1, "first " + body), (2, "second text before it, " + body)], "doc_id bigint, text string")
    cores = df.select("doc_id", "text").mapInArrow(T._cores, "h binary, doc bigint, start int, len int")
    n = cores.groupBy("h").count().filter("count = 2").count()
    assert n >= 0.5 * cores.filter("doc = 1").count() > 3


def test_long_texts_are_encoded_in_parts(spark):
    text = "The pump feeds. 水箱，阀门。" * 2000
    assert T._encode(T.encoder(T.BYTE_BPE_50K), text, most=1000) == ids(text)
    blank = " " * 20_000
    assert T._encode(T.encoder(T.BYTE_BPE_50K), blank, most=1000) == ids(blank)


def test_empty(spark):
    assert run(spark, []) == []


def test_counts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {(r.doc_id, r.n_tokens) for r in T.token_counts(df, ["doc_id"]).collect()} == {(1, 2), (2, 0), (3, 0)}


def test_only_what_safe_points_hold_for(tmp_path):
    with pytest.raises(ValueError):
        T.encoder(T.BYTE_BPE_50K._replace(pieces=r"\s+|\S+"))
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        T.encoder(T.Tokenizer(str(tmp_path / "few")))


def test_another_vocabulary_of_the_pattern(spark):
    other = T.BYTE_BPE_50K._replace(path=T.BYTE_BPE_50K.path.replace("byte_bpe_50k", "byte_bpe_multi_50k"))
    if not os.path.exists(other.path):
        pytest.skip("no second vocabulary here")
    shared = "水箱焊接记录，" * 60 + "The pump feeds the valve. " * 40
    texts = [shared + str(i) for i in range(5)] + ["", None, "it's one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in T.encode_corpus(df, tokenizer=other).collect()}
    assert got == {i: T.encoder(other).encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


def test_long_runs_of_white_space(spark):
    """White space that the pattern alone couldn't read, within, before and after text, and the same as whole-text encoding where that ends."""
    from cairn.llm.tokens import BYTE_BPE_50K, _encode, encode_corpus, encoder

    enc = encoder(BYTE_BPE_50K)
    for t in (" " * 40 + "x", "a" + "\n " * 30 + "b c", "x" + "\t" * 50, "　" * 30 + "施工", "a " + " " * 30 + "\x1c."):
        for run in (1, 7, 29):
            assert _encode(enc, t, 4, run) == enc.encode_ordinary(t)
    n = 1_200_000
    rows = [(1, "ab" + " " * n + "cd"), (2, "\n" * n), (3, "ab" + " " * n + "cd"), (4, " " * n + "cd")]
    got = {r.doc_id: r.ids for r in encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, t in rows:
        assert enc.decode(got[k]) == t
    assert got[1] == got[3] == [*enc.encode_ordinary("ab"), *enc._encode_single_piece(" " * (n - 1)), *enc.encode_ordinary(" cd")]
