"""An index over vectors: product codes, and trained lists with eight-bit codes. It is fitted on a bounded sample and holds every row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.ranking import top_per_group
from cairn.operators.vectors import dot, rerank

#: Rows that the fit sees at most, and rounds of it.
SAMPLE, ROUNDS = 20_000, 12
#: Rows of one block of codes, and of one block of queries; a task scores one by the other.
CODE_BLOCK, QUERY_BLOCK = 32_768, 128
#: Into how many parts rows of a list are dealt before they are packed, so that a large list is no single task.
DEALS = 8


def centers_of(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centers of rows by Lloyd's rounds, begun with rows at even distances; the same for the same rows in the same order."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, x[:, i], len(c)) for i in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fit(corpus: DataFrame, parts: int, k: int, sample: int = SAMPLE) -> np.ndarray:
    """Centers of the corpus' vectors cut into ``parts`` equal parts: an array parts x (at most k) x dimensions of a part.

    The fit sees the ``sample`` rows with the smallest hash of their id: a bound that doesn't grow with the corpus,
    and the same rows in every run. Each part is fitted in a task of its own; what comes back are the centers.
    """
    rows = corpus.filter("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(sample)
    width = F.ceil(F.size("vec") / parts).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("vec", p * width + 1, width))
    each = rows.select("id", F.posexplode(each).alias("part", "x"))

    def centers(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        c = centers_of(np.stack(group["x"].to_list()), k)
        return pd.DataFrame({"part": int(group["part"].iloc[0]), "code": range(len(c)), "center": list(c)})

    found = each.groupBy("part").applyInPandas(centers, "part int, code int, center array<double>").toPandas().sort_values(["part", "code"])
    if found.empty:
        return np.zeros((parts, 0, 0))
    return np.stack([np.stack(g["center"].to_list()) for _, g in found.groupby("part")])


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _code(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of ids and of the number of the nearest center of each part."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def block() -> pa.RecordBatch:
        ids, codes = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary())], names=["ids", "codes"])

    for batch in batches:
        if batch.num_rows:
            x = _vectors(batch.column("vec"))
            w = books.shape[2]
            codes = [(x[:, p * w : (p + 1) * w] @ c.T - 0.5 * (c * c).sum(1)).argmax(1).astype(np.uint8) for p, c in enumerate(books)]
            held.append((batch.column("id").to_numpy(), np.stack(codes, axis=1)))
            if sum(len(i) for i, _ in held) >= CODE_BLOCK:
                yield block()
                held = []
    if held:
        yield block()


def product_codes(corpus: DataFrame, books: np.ndarray) -> DataFrame:
    """Every row of the corpus (id, vec) as one byte per part: blocks of ids and codes. Null vectors are left out."""
    if books.shape[1] > 256:
        raise ValueError("a code is one byte: at most 256 centers a part")
    return corpus.filter("vec is not null").select("id", "vec").mapInArrow(partial(_code, books=books), "ids array<bigint>, codes binary")


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, QUERY_BLOCK):
            b = batch.slice(i, QUERY_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([b.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([_vectors(b.column("vec")).tobytes()], pa.binary())], names=["qids", "qm"])


def _first(qids: np.ndarray, ids: np.ndarray, s: np.ndarray, n: int) -> pa.RecordBatch:
    """The n best columns of each row of scores."""
    n = min(n, s.shape[1])
    best = np.argpartition(-s, n - 1, axis=1)[:, :n] if n else np.zeros((len(s), 0), int)
    at = np.repeat(np.arange(len(s)), n)
    return pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(ids[best.reshape(-1)]), pa.array(s[at, best.reshape(-1)].astype(np.float64))], names=["query_id", "id", "score"])


def _score_codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            q = np.frombuffer(row["qm"]).reshape(len(row["qids"]), -1)
            codes, w = np.frombuffer(row["codes"], np.uint8).reshape(len(row["ids"]), -1), books.shape[2]
            s = np.zeros((len(q), len(codes)), np.float32)
            for p, c in enumerate(books):
                s += (q[:, p * w : (p + 1) * w] @ c.T).astype(np.float32)[:, codes[:, p]]
            yield _first(np.array(row["qids"]), np.array(row["ids"]), s, n)


def _reranked(found: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, candidates: int) -> DataFrame:
    top = top_per_group(found, ["query_id"], [F.col("score").desc(), F.col("id")], candidates).select("query_id", "id")
    both = top.join(corpus.select("id", "vec"), "id").join(queries.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), "query_id")
    return rerank(both, dot(F.col("qvec"), F.col("vec")), k).select("query_id", "id", "score", "rank")


def search_codes(queries: DataFrame, codes: DataFrame, corpus: DataFrame, books: np.ndarray, k: int, candidates: int) -> DataFrame:
    """The k nearest by inner product among the ``candidates`` that the product codes put first: query_id, id, score, rank.

    All codes are scored, one byte per part instead of a vector; only candidates meet their vectors again, for the
    exact score. queries are a stated set that meets the codes block by block.
    """
    q = queries.filter("vec is not null").select("id", "vec").mapInArrow(_ask, "qids array<bigint>, qm binary")
    found = codes.join(q).mapInArrow(partial(_score_codes, books=books, n=candidates), "query_id bigint, id bigint, score double")
    return _reranked(found, queries, corpus, k, candidates)


def _listed(batches: Iterator[pa.RecordBatch], lists: np.ndarray, lo: np.ndarray, step: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _vectors(batch.column("vec"))
            own = (x @ lists.T - 0.5 * (lists * lists).sum(1)).argmax(1).astype(np.int32)
            codes = np.clip(np.round((x - lo) / step), 0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "id", "code"])


def _probing(batches: Iterator[pa.RecordBatch], lists: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _vectors(batch.column("vec"))
            near = np.argsort(-(x @ lists.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            at = np.repeat(np.arange(len(x)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1)), batch.column("id").take(pa.array(at)), pa.array([x[i].tobytes() for i in at], pa.binary())], names=["list", "id", "code"])


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list as blocks of up to ``most`` rows of one list."""
    of, ids, codes = None, [], []

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(codes)], pa.binary())], names=["list", "ids", "codes"])

    for batch in batches:
        for number, i, c in zip(*(batch.column(x).to_pylist() for x in ("list", "id", "code"))):
            if ids and (number != of or len(ids) >= most):
                yield block()
                ids, codes = [], []
            of = number
            ids.append(i)
            codes.append(c)
    if ids:
        yield block()


def _score_lists(batches: Iterator[pa.RecordBatch], lo: np.ndarray, step: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            q = np.frombuffer(row["qm"]).reshape(len(row["qids"]), -1)
            x = np.frombuffer(row["codes"], np.uint8).reshape(len(row["ids"]), -1) * step + lo
            yield _first(np.array(row["qids"]), np.array(row["ids"]), q @ x.T, n)


def _by_list(rows: DataFrame, most: int) -> DataFrame:
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(DEALS))).repartition("list", "deal").sortWithinPartitions("list")
    return dealt.drop("deal").mapInArrow(partial(_packed, most=most), "list int, ids array<bigint>, codes binary")


def search_lists(queries: DataFrame, corpus: DataFrame, lists: np.ndarray, probes: int, k: int, candidates: int) -> DataFrame:
    """The k nearest by inner product in the ``probes`` lists that each query is nearest to: query_id, id, score, rank.

    lists: the trained centers. Every row is put into the list of its nearest center as eight-bit codes on the
    range of the centers' own values, drawn out by half; codes are scored block by block, candidates exactly.
    """
    if not lists.size:
        return corpus.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    # the range of a dimension as the centers show it, widened: what lies outside is clipped and found by its other dimensions
    mid, half = (lists.max(0) + lists.min(0)) / 2, np.maximum((lists.max(0) - lists.min(0)) / 2, 1e-9) * 1.5
    lo, step = mid - half, 2 * half / 255
    rows = corpus.filter("vec is not null").select("id", "vec").mapInArrow(partial(_listed, lists=lists, lo=lo, step=step), "list int, id bigint, code binary")
    asked = queries.filter("vec is not null").select("id", "vec").mapInArrow(partial(_probing, lists=lists, probes=probes), "list int, id bigint, code binary")
    q = _by_list(asked, QUERY_BLOCK).withColumnsRenamed({"ids": "qids", "codes": "qm"})
    found = _by_list(rows, CODE_BLOCK).join(q, "list").mapInArrow(partial(_score_lists, lo=lo, step=step, n=candidates), "query_id bigint, id bigint, score double")
    return _reranked(found, queries, corpus, k, candidates)
