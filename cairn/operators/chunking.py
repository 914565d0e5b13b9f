"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import chunks as C
from cairn.functions.shared import spread
from cairn.functions.text import strip


def fixed(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of ``size`` characters that overlap: doc_id, idx (from 0, over non-blank chunks), start, chunk.

    Closed form, without a loop: the last window ends with the text. Null, empty and blank texts give no row.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    n = F.lit(1) + F.greatest(F.lit(0), F.ceil((F.length(text) - size) / (size - overlap))).cast("int")
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * (size - overlap))
    parts = F.transform(starts, lambda s: F.struct(s.alias("start"), strip(F.substring(F.col(text), s + 1, F.lit(size))).alias("chunk")))
    rows = docs.filter(F.length(text) > 0).select(id_col, F.posexplode(F.filter(parts, lambda p: F.length(p["chunk"]) > 0)).alias("idx", "p"))
    return rows.select(id_col, "idx", F.col("p.start").alias("start"), F.col("p.chunk").alias("chunk"))


def token_chunks(docs: DataFrame, size: int = 500, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of ``size`` words without overlap: doc_id, idx, chunk (words joined by one space). Null and blank texts give no row."""
    words = F.split(strip(text), r"[ \t\n\r\x0B\f\x{00A0}\x{3000}]+")
    rows = docs.filter(F.length(strip(text)) > 0).select(id_col, words.alias("w"))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / size).cast("int") - 1), lambda i: F.array_join(F.slice("w", i * size + 1, F.lit(size)), " "))
    return rows.select(id_col, F.posexplode(parts).alias("idx", "chunk"))


def _cut(batches: Iterator[pa.RecordBatch], f: Callable[[str], list[str]], id_col: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, idx, out = [], [], []
        for k, t in enumerate(b.column("text").to_pylist()):
            for i, chunk in enumerate(f(t) if t else []):
                at.append(k)
                idx.append(i)
                out.append(chunk)
        yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(at, pa.int64())), pa.array(idx, pa.int32()), pa.array(out, pa.string())], names=[id_col, "idx", "chunk"])


def chunked(docs: DataFrame, strategy: str = "fixed", id_col: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """Chunks of every document: doc_id, idx, chunk. Strategies: fixed, sentence, paragraph, bounded, recursive; any other is taken as fixed."""
    how = {
        "sentence": partial(C.sentences, most=options.get("size", 1000)),
        "paragraph": partial(C.paragraphs, most=options.get("size", 1000)),
        "bounded": partial(C.bounded, size=options.get("size", 1000), overlap=options.get("overlap", 200)),
        "recursive": partial(C.recursive, size=options.get("size", 1000), overlap=options.get("overlap", 200)),
    }.get(strategy)
    if how is None:
        return fixed(docs, options.get("size", 1000), options.get("overlap", 200), id_col, text).drop("start")
    if options.get("overlap", 200) >= options.get("size", 1000):
        raise ValueError("overlap must be less than size")
    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, F.col(text).alias("text"))).mapInArrow(partial(_cut, f=how, id_col=id_col), f"`{id_col}` {kind}, idx int, chunk string")
