import numpy as np
import pytest

from cairn.operators import index as I
from cairn.operators import vectors as V


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in v] if v is not None else None, 0) for i, v in enumerate(x)], "id bigint, vec array<float>, grp bigint")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 1500)] * 3 + rng.normal(size=(1500, 16)) * 0.5
    corpus = frame(spark, [*x, None]).cache()
    return corpus, corpus.filter("id % 50 = 0")


def test_lists_find_clusters_in_a_tenth_of_the_rows(clustered):
    corpus, queries = clustered
    exact = V.nearest(queries, corpus, 10)
    found = I.search_lists(queries, corpus, I.fit(corpus, 1, 40)[0], 4, 10, 40)
    r = V.recall_of(found, exact).first()
    assert r.recall >= 0.9
    assert found.groupBy("query_id").count().filter("count > 10").count() == 0


def test_codes_and_scores_are_exact_after_reranking(clustered):
    corpus, queries = clustered
    exact = V.nearest(queries, corpus, 10)
    books = I.fit(corpus, 4, 64)
    found = I.search_codes(queries, I.product_codes(corpus, books), corpus, books, 10, 100)
    assert V.recall_of(found, exact).first().recall >= 0.9
    want = {(r.query_id, r.id): r.score for r in exact.collect()}
    both = [r for r in found.collect() if (r.query_id, r.id) in want]
    assert both and all(abs(r.score - want[r.query_id, r.id]) < 1e-5 for r in both)


def test_the_fit_sees_a_bounded_sample_and_every_row_is_coded(clustered):
    corpus, _ = clustered
    assert np.array_equal(I.fit(corpus, 2, 8, sample=100), I.fit(corpus.repartition(7), 2, 8, sample=100))
    blocks = I.product_codes(corpus, I.fit(corpus, 2, 8, sample=100)).collect()
    assert sorted(i for b in blocks for i in b.ids) == list(range(1500))
    with pytest.raises(ValueError):
        I.product_codes(corpus, np.zeros((1, 257, 16)))


def test_few_rows_and_none(spark):
    one = frame(spark, [[1.0, 0.0]])
    assert [tuple(r) for r in I.search_lists(one, one, I.fit(one, 1, 9)[0], 3, 10, 20).collect()] == [(0, 0, 1.0, 1)]
    none = frame(spark, [])
    books = I.fit(none, 2, 4)
    assert I.search_codes(none, I.product_codes(none, books), none, books, 10, 20).count() == 0
    assert I.search_lists(none, none, I.fit(none, 1, 4)[0], 2, 10, 20).count() == 0
