"""Small fixtures for the rules that SQL can't check, and for odd input."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import chunks as C
from cairn.functions import fields as X
from cairn.operators import chunking, dialogue, evaluation, graph, lifecycle, pipeline, replies, tables, vectors
from cairn.sources import files, store


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first().x


def test_table_rules(spark):
    md = "a\n\n| h1 | h2 |\n|---|---|\n|  | <br> |\n| 1 | 2 |\n|---|---|\n| 3 | - |"
    assert one(spark, X.clean_table("m"), m=md) == "a\n| h1 | h2 |\n|---|---|\n| 1 | 2 |\n|---|---|\n| 3 | - |"
    assert one(spark, X.first_rule_only("m"), m=md).count("|---|---|") == 1


@pytest.mark.parametrize(
    "md, want",
    [
        ("| 序号 | 特征描述 |\n|---|---|\n| 1 | 规格 |", False),
        ("| 序号 | 特征描述 |\n|---|---|\n| 1 | - |", True),
        ("| a | b | c |\n|---|---|---|\n| a | b | c |\n| 合计 | 1 | 2 |", True),
        ("| a | b |", True),
        ("| a | b |\n|---|---|\n|  |  |", True),
        ("| a | b |\n|---|---|\n| 小计 | 5 |", True),
        ("| a | b |\n|---|---|\n| x | 5 |", False),
        ("no table", True),
    ],
)
def test_placeholder(spark, md, want):
    assert one(spark, tables.is_placeholder(tables.cells(F.col("m"))), m=md) is want


def test_islands_break_on_gap_and_on_equal_page(spark):
    df = spark.createDataFrame([("g", p, i) for i, p in enumerate([1, 2, 2, 3, 5, 6])], "g string, page int, i int")
    got = [(r.first_page, r.last_page) for r in tables.merged_tables(df, ["g"], "page", ["i"], F.lit("x")).orderBy("first_page", "last_page").collect()]
    assert got == [(1, 2), (2, 3), (5, 6)]


def test_iou(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, tables.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)), a=1) == pytest.approx(1 / 7)
    assert one(spark, tables.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), a=1) == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。.\n!", max_size=400), st.integers(20, 60), st.integers(0, 19))
def test_chunkers_end_and_cover(text, size, overlap):
    for out in (C.bounded(text, size, overlap, 5), C.sentences(text, size), C.paragraphs(text, size), C.recursive(text, size, overlap)):
        assert all(out)
    assert all(len(c) <= size for c in C.recursive(text, size, overlap))
    kept = "".join(C.bounded(text, size, 0, 5)).replace(" ", "").replace("\n", "")
    assert kept == text.replace(" ", "").replace("\n", "")


def test_fixed_chunks_cover(spark):
    df = spark.createDataFrame([(1, "x" * 2500), (2, None), (3, ""), (4, "y")], "doc_id bigint, text string")
    got = chunking.fixed(df, 1000, 200).orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.start, len(r.chunk)) for r in got] == [(1, 0, 1000), (1, 800, 1000), (1, 1600, 900), (4, 0, 1)]
    with pytest.raises(ValueError):
        chunking.fixed(df, 100, 100)
    assert chunking.chunked(df, "no such", size=1000, overlap=200).count() == 4


def test_vectors_equal_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)] + [(999, None, 0)], "id bigint, vec array<double>, grp bigint")
    q = df.filter("id % 50 = 0")
    for metric, s in (("ip", m @ m.T), ("l2", -((m[:, None] - m[None]) ** 2).sum(-1))):
        got = {(r.query_id, r.rank): r.id for r in vectors.nearest(q, df, 5, metric).collect()}
        s = s.round(6)
        for i in range(0, 300, 50):
            want = np.lexsort((np.arange(300), -s[i]))[:5]
            assert [got[(i, k)] for k in range(1, 6)] == want.tolist()
    assert vectors.nearest(q, df.limit(0), 5).count() == 0


def test_probed_lists_find_nearly_all(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(8, 16)) * 3
    m = np.concatenate([c + rng.normal(size=(60, 16)) for c in centre])
    df = spark.createDataFrame([(i, [float(x) for x in v], i // 60) for i, v in enumerate(m)], "id bigint, vec array<double>, grp bigint")
    q = df.filter("id % 20 = 0")
    r = vectors.recall_of(vectors.probed(q, df, vectors.centroids(df), 3, 10), vectors.nearest(q, df, 10)).first()
    assert r.n_exact == 240 and r.recall >= 0.9


def test_k_hop_goes_all_the_way(spark):
    edges = spark.createDataFrame([(i, f"n{i}", f"n{i + 1}", "t", 1.0, None) for i in range(5)], "row_id bigint, source string, target string, relation_type string, weight double, loaded_at timestamp_ntz")
    seeds = spark.createDataFrame([("n0",), ("alone",)], "node string")
    for k in range(4):
        got = {(r.node, r.depth) for r in graph.k_hop(seeds, edges, k).collect()}
        assert got == {("alone", 0)} | {(f"n{i}", i) for i in range(k + 1)}
    assert graph.graph_stats(edges).first().average_degree == pytest.approx(2 * 5 / 6, abs=1e-6)
    assert graph.graph_stats(edges.limit(0)).first().average_degree == 0


def test_merge_contexts_is_idempotent(spark):
    a = spark.createDataFrame([("q", "entity", "x", 0.5), ("q", "entity", "x", 0.6)], "query string, kind string, key string, score double")
    got = [(r.key, r.score, r.rank) for r in graph.merge_contexts([a, a]).orderBy("rank").collect()]
    assert got == [("x", 0.6, 1), ("x", 0.5, 2)]


def test_records(spark):
    reply = '("entity"<|>"Pump"<|>device<|>moves water)##("relationship"<|>A<|>B<|>feeds<|>k<|>oops)##("relationship"<|>A<|>A<|>feeds<|>k<|>2)##("entity"<|>short)##junk<|COMPLETE|>'
    got = [(r.kind, r.first, r.second, r.weight) for r in replies.records(spark.createDataFrame([(1, reply), (2, ""), (3, None)], "id int, reply string"), "id").collect()]
    assert got == [("entity", "Pump", "device", None), ("relationship", "A", "B", 1.0)]


def test_json_repair_and_keywords(spark):
    bad = 'Sure:\n{"high_level": ["a", " ", "b",], // note\n "low_level": "no list" /* x */}\nbye'
    fixed = X.repaired_json("r")
    assert one(spark, replies.keywords_of(fixed, "high_level"), r=bad) == ["a", "b"]
    assert one(spark, replies.keywords_of(fixed, "low_level"), r=bad) == []
    assert one(spark, replies.keywords_of(fixed, "high_level"), r="nothing") == []


def test_ranked_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, 0), ("q", 2, 1), ("q", 3, 1)], "query string, rank int, rel int")
    totals = spark.createDataFrame([("q", 3), ("none", 0), ("empty", 2)], "query string, n_rel bigint")
    got = {r.query: r for r in evaluation.ranked_metrics(ranked, totals, 10).collect()}
    assert got["q"].precision == 0.2 and got["q"].reciprocal_rank == 0.5 and got["q"].recall == pytest.approx(2 / 3, abs=1e-6)
    assert got["q"].average_precision == pytest.approx((1 / 2 + 2 / 3) / 3, abs=1e-6)
    assert got["none"].recall is None and got["none"].precision == 0
    assert got["empty"].recall == 0 and got["empty"].ndcg == 0


def test_adaptive_loop_is_bounded(spark):
    q = spark.createDataFrame([("water pump",), ("最新 price",), ("lost",)], "question string")
    r = spark.createDataFrame([("water pump", 0, "nothing"), ("water pump", 1, "the water pump"), ("lost", 0, "else")], "question string, round int, text string")
    got = {x.question: (x.state, x.rounds_used) for x in dialogue.answered(q, r).collect()}
    assert got == {"water pump": ("answered", 1), "最新 price": ("web", 0), "lost": ("given up", 2)}


def test_waterfall_and_lookup(spark):
    h = spark.createDataFrame([("q", f"c{i}", s) for i, s in enumerate([0.9, 0.8, 0.7, 0.1])] + [("r", "c", 0.2)], "query string, chunk_id string, score double")
    assert {(x.chunk_id, x.stage) for x in pipeline.waterfall(h, 0.6, 3).collect()} == {("c0", "first"), ("c1", "first"), ("c2", "first"), ("c", "second")}
    look = spark.createDataFrame([(1, " "), (1, "b"), (1, "a"), (None, "n")], "k int, v string")
    got = pipeline.looked_up(spark.createDataFrame([(1,), (2,), (None,)], "k int"), look, ["k"], "v").collect()
    assert {(x.k, x.v) for x in got} == {(1, "b"), (2, None), (None, None)}


def test_lifecycle(spark):
    assert [one(spark, lifecycle.tier(F.lit(n)), a=1) for n in (0, 7, 8, 30, 31)] == ["hot", "hot", "warm", "warm", "cold"]
    assert one(spark, lifecycle.expired(F.lit(900), F.lit(0)), a=1) is False
    assert one(spark, lifecycle.memory_bytes(F.lit(1024), F.lit(1_000_000)), a=1) == 1024 * 1e6 * 6


def test_decoding_and_html(spark):
    df = spark.createDataFrame([("a", "水箱".encode("gbk")), ("b", "水箱".encode()), ("c", bytes([0xFF, 0x41])), ("d", None)], "path string, content binary")
    assert {r.path: r.text for r in files.texts(df).collect()} == {"a": "水箱", "b": "水箱", "c": "\xffA", "d": None}
    assert one(spark, files.html_text(F.col("h")), h="<p>a &amp;lt; b</p><script>x<y</script>") == "a &lt; b"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "t.tsv").write_text("date\tn\n1/2/2025\t3\n1/3/2025\t（NULL）\n", encoding="utf8")
    (tmp_path / "sub" / "g.graphml").write_text('<graphml><graph><node id="a"/><node id="b"/><edge source="a" target="b"/></graph></graphml>')
    assert [tuple(r) for r in files.tsv(spark, str(tmp_path / "t.tsv"), "date string, n int").collect()] == [("1/2/2025", 3), ("1/3/2025", None)]
    nodes, edges = files.graphml(spark, str(tmp_path / "sub"))
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("a", "b")]
    assert files.files(spark, str(tmp_path), "*.tsv").count() == 1


def test_collections(spark, tmp_path):
    c = store.create("parquet", spark, str(tmp_path / "c"), "id", "v")
    c.insert(spark.createDataFrame([("a", [1.0], "t"), (None, [2.0], "t"), ("c", None, "t")], "id string, v array<double>, text string"))
    assert c.rows().count() == 2
    assert c.delete(c.rows().filter("id = 'a'")).compact(1).rows().count() == 1
    with pytest.raises(ValueError):
        store.create("other", spark, "x", "id")
    with pytest.raises(TypeError):
        store.register("bad", int)


def test_history_over_parts(spark):
    rows = [("a", i, f"t{i}", i // 3) for i in range(10)] + [("b", 0, "x", 0), ("b", 9, None, 4), ("b", 10, "y", 4)]
    df = spark.createDataFrame(rows, "c string, n int, text string, p int")
    got = {(r.c, r.n): r.history for r in dialogue.history(df, ["c"], ["n"], "text", 2, F.col("p")).collect()}
    assert len(got) == 13
    assert got["a", 0] == "" and got["a", 1] == "t0"
    assert all(got["a", i] == f"t{i - 2} | t{i - 1}" for i in range(2, 10))
    assert got["b", 9] == "x" and got["b", 10] == "x"


def test_very_wide_table_rows(spark):
    """Rows of tens of thousands of cells or line breaks are read like short ones."""
    from cairn.functions.fields import clean_table, first_rule_only

    n = 30_000
    rule = "|---" * n + "|"
    t = f"| a |\n{rule}\n{rule}\n| " + "<br/>" * n + " |\n| x |"
    row = spark.createDataFrame([(t,)], "t string").repartition(1).select(first_rule_only("t").alias("a"), clean_table("t").alias("b")).first()
    assert row.a.count("\n") == 3 and row.a.startswith(f"| a |\n{rule}\n| <br/>")
    assert row.b == f"| a |\n{rule}\n{rule}\n| x |"


def test_recursive_chunks_of_a_text_without_marks():
    from cairn.functions.chunks import recursive

    out = recursive("0123456789" * 30_000, 4000, 400)
    assert all(len(x) == 4000 for x in out[:-1]) and all(a[-400:] == b[:400] for a, b in zip(out, out[1:]))
    assert len(out) == 84
