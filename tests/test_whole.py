"""Jobs that are done whole: nothing of a text, a conversation or a search is left out."""

import shutil
from collections import defaultdict

import __spark_entry__ as entry

QUERIES = entry.queries()


def test_whole_texts(spark, data):
    """Every symbol of every chunk is in its document's parts, and prompts, answers and citations hold whole texts."""
    rows = {(r.document_id, r.chunk_id, r.text) for r in spark.read.parquet(f"{data}/doc_101_labeled.parquet").collect() if r.chunk_id is not None and r.text is not None}
    docs = defaultdict(list)
    for doc, chunk, text in rows:
        _, page, idx = chunk.rsplit("-", 2) if not chunk.rsplit("-", 2)[0].endswith("-") else (None, -1, -1)
        docs[doc].append((int(page), int(idx), chunk, text))
    want = {doc: "\n\n".join(x[3] for x in sorted(c)) for doc, c in docs.items()}
    parts = defaultdict(list)
    for r in QUERIES["F25_whole_texts"](spark, data).collect():
        parts[r.document_id].append((r.part, r.body))
    assert max(map(len, parts.values())) > 1
    assert {doc: "\n\n".join(b for _, b in sorted(p)) for doc, p in parts.items()} == want
    parents = defaultdict(list)
    for r in QUERIES["J01_whole_parents"](spark, data).collect():
        parents[r.query, r.document_id].append((r.part, r.body))
    assert all("\n\n".join(b for _, b in sorted(p)) == want[doc] for (_, doc), p in parents.items())
    texts = {t for _, _, t in rows}
    answers = QUERIES["X31_whole_answers"](spark, data).collect()
    assert any(len(r.answer) > 80 for r in answers)
    assert all(r.answer in texts and r.prompt.startswith(f"问题：{r.query}\n{r.answer}") for r in answers)
    cited = {r.query: r.context for r in QUERIES["F24_cited_texts"](spark, data).collect()}
    assert all(f"[文档1] {r.answer}\n来源：" in cited[r.query] for r in answers if r.answer in cited[r.query])
    assert sum(r.answer in cited[r.query] for r in answers) > len(answers) / 2


def test_whole_history(spark, data):
    """A turn's part and the parts before it hold every earlier turn of the conversation, not the last two."""
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{data}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect():
        turns[r.user_id].append((r.ts, r.event_id, r.event_type))
    parts = {(r.user_id, r.part): r.history for r in QUERIES["W07_history_parts"](spark, data).collect()}
    got = {}
    for r in QUERIES["W07_whole_history"](spark, data).collect():
        got[r.event_id] = " | ".join(x for x in [*(parts[r.user_id, p] for p in range(r.part)), r.history] if x)
    want = {t[1]: " | ".join(x[2] for x in sorted(c)[:i]) for c in turns.values() for i, t in enumerate(sorted(c))}
    assert max(p for _, p in parts) >= 1
    assert got == want


def test_searches_by_vectors(spark, data, tmp_path):
    """A document that is near in the vectors comes out of hybrid, vector and mixed search, though it holds no word of the query."""
    for name in ("entities", "relations"):
        shutil.copy(f"{data}/{name}.parquet", tmp_path)
    axis = lambda i: [float(j == i % 8) for j in range(8)]
    spark.createDataFrame([(20, "zzz"), (21, "corroded parapet"), (22, "yyy")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # the question of query 3 has vector 60, as have documents 20 and 21; 22 points elsewhere
    vecs = [(60, axis(1)), (20, axis(1)), (21, [0.5 * x for x in axis(1)]), (22, axis(2)), (40, axis(3))]
    spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    at = str(tmp_path)
    hybrid = [(r.id, r.score) for r in QUERIES["X06_dense_and_sparse"](spark, at).filter("query_id = 3").orderBy("rank").collect()]
    assert hybrid == [(20, 0.7), (21, 0.65), (22, 0.0)]
    want = [("20", 1.0), ("21", 0.5)]
    for name in ("X07_X10_vector_search", "X11_mixed_by_vectors"):
        rows = QUERIES[name](spark, at).filter("query = '60' and kind = 'chunk' and score > 0").orderBy("rank").collect()
        assert [(r.key, r.score) for r in rows] == want, name
    # vectors 20 and 60 are alike, each names a relation, and an entity if it is the first row of one
    first = {}
    for r in sorted(spark.read.parquet(f"{at}/entities.parquet").select("row_id", "entity_id").collect()):
        if r.entity_id and r.entity_id.strip():
            first.setdefault(r.entity_id.strip().lower(), r.row_id)
    found = QUERIES["X08_local_by_vectors"](spark, at).filter("query = '60' and kind = 'entity' and score = 1").collect()
    assert {r.key for r in found} == {k for k, n in first.items() if n in (20, 60)} != set()
    found = QUERIES["X09_global_by_vectors"](spark, at).filter("query = '60' and kind = 'relation' and score = 1").collect()
    assert {r.key for r in found} == {"20", "60"}
