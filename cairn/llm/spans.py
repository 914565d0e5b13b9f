"""Problem 8: long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.shared import cut, spread, tasks
from cairn.llm.fm_index import FMIndex

#: Code points of an anchor, and of the texts that one shard's index holds.
ANCHOR, SHARD = 64, 400_000
#: Code points of the anchors by which texts around one anchor are divided again if they don't fit a shard; at last a whole window.
LONGER = (128, 176, 192)
_MIX, _BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def window_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k code points from each position on (of the last k - 1 positions: of no meaning)."""
    with np.errstate(over="ignore"):
        one = _mixed(points.astype(np.uint64) + np.uint64(1))
        h, n, power = one.copy(), 1, _BASE
        for bit in bin(k)[3:]:
            # from n to 2n code points, and to one more where k has the bit
            h[:-n] = h[:-n] * power + h[n:] if n < len(h) else h[:-n]
            n, power = n * 2, power * power
            if bit == "1":
                h[:-n] = h[:-n] * _BASE + one[n:] if n < len(h) else h[:-n]
                n, power = n + 1, power * _BASE
        return _mixed(h)


def _minima(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of the w values from each position on."""
    n = 1
    while n * 2 <= w:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    return np.minimum(v[: len(v) - (w - n)], v[w - n :]) if w > n else v


def anchors_of(texts: list[str], least: int, size: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """The anchors of texts of at least ``least`` code points: text number, anchor hash, first and last window start.

    Of each window of ``least`` code points the anchor is its part of ``size`` code points with the smallest hash (the
    leftmost of equal ones), so equal windows have equal anchors. Neighbouring windows with one anchor make one row.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum(lengths)])
    h = window_hashes(points, size)[: len(points) - size + 1]
    at = np.arange(len(h), dtype=np.uint64)
    low = np.uint64(0xFFFFFF)
    best = _minima((h & ~low) | at, least - size + 1)
    start = np.arange(len(best))
    text = np.searchsorted(off, start, "right") - 1
    whole = start + least <= off[text + 1]
    start, text, anchor = start[whole], text[whole], (best[whole] & low).astype(np.int64)
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    text = text[first]
    return text, h[anchor[first]].view(np.int64), start[first] - off[text], start[last] - off[text]


def _anchors(batches: Iterator[pa.RecordBatch], least: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, size, i = batch.column(0), batch.column(1).to_pylist(), 0, 0
        for j, t in enumerate(texts):
            size += len(t)
            if size > 800_000 or j == len(texts) - 1:
                part = [x if len(x) >= least else "" for x in texts[i : j + 1]]
                if any(part) and sum(map(len, part)) < (1 << 24):
                    yield _anchor_rows(ids, i, anchors_of(part, least, anchor))
                elif any(part):
                    yield from (_anchor_rows(ids, j, r) for r in _long(part[-1], least, anchor))
                    if any(part[:-1]):
                        yield _anchor_rows(ids, i, anchors_of(part[:-1], least, anchor))
                size, i = 0, j + 1


def _long(text: str, least: int, anchor: int = ANCHOR, step: int = 1 << 22) -> Iterator[tuple[np.ndarray, ...]]:
    """The anchors of one very long text, in parts that overlap by less than a window."""
    for a in range(0, len(text) - least + 1, step):
        t, h, lo, hi = anchors_of([text[a : a + step + least - 1]], least, anchor)
        yield t, h, lo + a, hi + a


def _anchor_rows(ids: pa.Array, first: int, rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    text, h, lo, hi = rows
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), ids.take(pa.array(first + text)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["a", "doc", "lo", "hi"])


def _segments(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts, lists = batch.column("doc"), batch.column("text").to_pylist(), batch.column("found").to_pylist()
        out: list[list] = [[], [], [], [], []]
        for k, (t, found) in enumerate(zip(texts, lists)):
            for x in found:
                for o, v in zip(out, (k, x["a"], x["lo"], x["hi"] - x["lo"] + 1, t[x["lo"] : x["hi"] + least])):
                    o.append(v)
        k, a, lo, n, seg = out
        keep = [i for i, (s, m) in enumerate(zip(seg, n)) if len(s) == m + least - 1]  # rows that share an id but not a text
        pick = lambda x, t: pa.array([x[i] for i in keep], t)
        yield pa.RecordBatch.from_arrays([docs.take(pick(k, pa.int64())), pick(a, pa.int64()), pick(lo, pa.int32()), pick(n, pa.int32()), pick(seg, pa.string())], names=["doc", "a", "lo", "n", "seg"])


def _search(shard: pd.DataFrame, least: int) -> pd.DataFrame:
    """Runs of window starts of the shard's texts that other documents share."""
    texts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in shard["seg"]]
    own, _ = pd.factorize(shard["low"])
    several = (shard["low"] != shard["high"]).to_numpy()
    own = np.where(several, -1, own)
    rows: list[tuple] = [(h, 0, len(t) - least) for h, t, m in zip(shard["h"], texts, several) if m]
    ask = np.flatnonzero(~several)
    if len(ask) and len(texts) > 1:
        index = FMIndex(texts, own, depth=least + 1)
        for i, starts in zip(ask, index.matches([texts[i] for i in ask], own[ask], least)):
            if len(starts):
                breaks = np.flatnonzero(np.diff(starts) > 1)
                for x, y in zip(starts[np.concatenate([[0], breaks + 1])], starts[np.append(breaks, len(starts) - 1)]):
                    rows.append((shard["h"].iloc[i], int(x), int(y)))
    return pd.DataFrame(rows, columns=["h", "x", "y"])


def _runs(rows: DataFrame, bounds: DataFrame | None, least: int, shard: int, sizes: tuple[int, ...]) -> DataFrame:
    """Runs of window starts that rows (doc, text) share with rows of other documents: doc, x, y.

    bounds: doc, low, high, the smallest and largest document that hold a row's text; None where each row is one
    document's. sizes: the code points of the anchors; what one anchor gathers beyond a shard is divided by the next.
    """
    doc_type = rows.schema["doc"].dataType.simpleString()
    found = cut(rows.mapInArrow(partial(_anchors, least=least, anchor=sizes[0]), f"a bigint, doc {doc_type}, lo int, hi int"))
    held = found.withColumns({"low": F.col("doc"), "high": F.col("doc")}) if bounds is None else found.join(bounds, "doc")
    shared = held.groupBy("a").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("a")
    lists = found.join(shared, "a").groupBy("doc").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("found"))
    cuttings = rows.join(lists, "doc").mapInArrow(partial(_segments, least=least), f"doc {doc_type}, a bigint, lo int, n int, seg string")
    cuttings = cut(cuttings.withColumn("h", F.unhex(F.md5("seg"))))

    owned = cuttings.withColumns({"low": F.col("doc"), "high": F.col("doc")}) if bounds is None else cuttings.join(bounds, "doc")
    distinct = cut(owned.groupBy("a", "h", "seg").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    around = distinct.groupBy("a").agg(F.sum(F.length("seg")).alias("size"))
    total, largest = around.agg(F.sum("size"), F.max("size")).first()
    last = len(sizes) == 1  # the anchor is the window then, and equal windows are one text
    placed = distinct.join(around, "a")
    usual = placed if last else placed.filter(F.col("size") <= shard)
    # shards are groups of bounded size; they are dealt to a set number of tasks, which isn't merged, as the work is in their CPU
    bucket = F.pmod(F.xxhash64("a"), F.lit(2 * max(1, -(-(total or 0) // shard))))
    usual = usual.select("h", "seg", "low", "high", bucket.alias("bucket")).repartition(tasks(rows.sparkSession), "bucket")

    def search(texts: pd.DataFrame) -> pd.DataFrame:
        return _search(texts, least)

    runs = usual.groupBy("bucket").applyInPandas(search, "h binary, x int, y int")
    if not last and (largest or 0) > shard:
        hot = cut(placed.filter(F.col("size") > shard).groupBy("h").agg(F.min("seg").alias("text"), F.min("low").alias("low"), F.max("high").alias("high")))
        hot = hot.withColumnRenamed("h", "doc")
        inner = _runs(hot.select("doc", "text"), hot.select("doc", "low", "high"), least, shard, sizes[1:])
        runs = runs.unionByName(inner.withColumnRenamed("doc", "h"))
    return cuttings.select("h", "doc", "lo").join(runs, "h").select("doc", (F.col("lo") + F.col("x")).alias("x"), (F.col("lo") + F.col("y")).alias("y"))


def shared_spans(docs: DataFrame, least: int = 200, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """The longest runs of shared characters of each document: doc_id, span_start (int, from 1), span_len (int).

    A character is shared if it lies in ``least`` or more code points that also occur, exactly, in the text of another
    doc_id. Null texts, null ids and texts shorter than ``least`` give no row; rows that repeat an id count as one
    document; what recurs only within a document is not shared; other columns are ignored.

    Every window of ``least`` code points has an anchor chosen by its content alone, so equal windows meet under equal
    anchors. Anchors that occur in one document only are dropped by counting. What lies around the others is cut out,
    equal cuttings are merged into one, and the cuttings are divided among shards by anchor. Each shard holds an
    FM-index over a wavelet matrix and streams its cuttings through it: backward search gives their matching
    statistics against other documents, and the runs of window starts with ``least`` or more go back to all documents
    that hold the cutting. The cuttings around an anchor that are more than a shard holds (a short boilerplate in very
    many documents) are treated as documents in turn, with longer anchors, of which the last is a whole window: so
    every window goes through an index of bounded size.
    """
    rows = spread(docs.filter(F.col(doc_id).isNotNull() & (F.length(text) >= least)).select(F.col(doc_id).alias("doc"), F.col(text).alias("text")))
    sizes = (min(ANCHOR, least), *(n for n in LONGER if ANCHOR < n < least), least)
    pieces = _runs(rows, None, least, shard, sizes).select("doc", F.col("x").alias("s"), (F.col("y") + least).alias("e"))
    order = Window.partitionBy("doc").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1))
    pieces = pieces.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = pieces.groupBy("doc", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return spans.select(F.col("doc").alias(doc_id), (F.col("s") + 1).cast("int").alias("span_start"), (F.col("e") - F.col("s")).cast("int").alias("span_len"))


def shared_share(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document how much of it is shared: doc_id, n_chars, n_spans, shared_chars, share (null for an empty or null text)."""
    per = spans.groupBy(doc_id).agg(F.count("*").alias("n_spans"), F.sum("span_len").alias("shared_chars"))
    rows = docs.select(doc_id, F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars")).join(per, doc_id, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(doc_id, "n_chars", zero("n_spans"), zero("shared_chars"), F.try_divide(zero("shared_chars").cast("double"), "n_chars").alias("share"))
