"""Problem 6: encoding the corpus with a public tokenizer, chunks shared by documents encoded once."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.shared import cut, spread
from cairn.functions.text import WHITE_SPACE

# Fixed value: the pattern by which byte_bpe_50k divides a text into pieces before merging bytes within each.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer(NamedTuple):
    """A byte-level BPE tokenizer: where the cluster keeps its file of ranks, and the pattern that divides texts into pieces."""

    path: str
    pieces: str = PIECES


BYTE_BPE_50K = Tokenizer("/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Bytes that one rolling hash covers, and the mean length of a chunk in bytes as a power of two.
WINDOW, CHUNK_BITS = 16, 8
#: White space in one run beyond which the tokenizer's pattern would run out of its stack; and a run of it.
LONG_RUN, _RUN = 100_000, re.compile(f"[{WHITE_SPACE}]+")

_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder(tokenizer: Tokenizer):
    """The tokenizer, loaded once per worker. It has no special tokens: their strings are ordinary text.

    Safe points are proven for PIECES, so a tokenizer of another pattern is refused, as is a file without a rank for
    every byte, which couldn't encode every text.
    """
    import tiktoken

    if tokenizer.pieces != PIECES:
        raise ValueError("texts can be cut at safe points for the pattern PIECES only")
    with open(tokenizer.path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError(f"{tokenizer.path} has no rank for some byte")
    return tiktoken.Encoding("ranks", pat_str=tokenizer.pieces, mergeable_ranks=ranks, special_tokens={})


def safe_points(b: np.ndarray) -> np.ndarray:
    """Byte positions before which a piece always begins, whatever stands further left or right.

    Every piece that holds a letter ends in a letter, and every piece that holds a digit ends in one. So a piece begins
    wherever an ASCII letter or digit is followed by another kind of ASCII character, or a Chinese character (here
    U+5000 to U+8FFF) by such an ASCII character or by one of five Chinese punctuation marks. Text between two such
    points is encoded alone exactly as in its document.
    """
    other = ~_ALNUM[b] & (b < 128)
    safe = np.zeros(len(b), bool)
    safe[1:] = _ALNUM[b[:-1]] & other[1:]
    if len(b) > 6:
        lead = (b >= 0xE5) & (b <= 0xE8)
        p0, p1, p2 = b[3:-2], b[4:-1], b[5:]
        mark = (p0 == 0xEF) & (p1 == 0xBC) & ((p2 == 0x8C) | (p2 == 0x9A) | (p2 == 0x9B))
        mark |= (p0 == 0xE3) & (p1 == 0x80) & ((p2 == 0x81) | (p2 == 0x82))
        safe[3:-2] |= lead[:-5] & (mark | other[3:-2])
    return np.flatnonzero(safe)


def cut_points(b: np.ndarray) -> np.ndarray:
    """Where a rolling hash of the last WINDOW bytes has its low CHUNK_BITS zero: the same places in equal content."""
    h, n = _GEAR[b], 1
    while n < WINDOW:
        h[n:] = h[n:] + (h[:-n] << np.uint32(n))
        n *= 2
    at = np.flatnonzero((h >> np.uint32(12)) & np.uint32((1 << CHUNK_BITS) - 1) == 0) + 1
    return at


def _texts(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes: first row, row after the last, their bytes, and the offsets of the rows in them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk the part between its first and last safe point: its digest, document, byte position and length."""
    from xxhash import xxh3_128_digest

    for batch in batches:
        ids = batch.column(0)
        for i, j, b, off in _texts(batch.column(1)):
            if not len(b):
                continue
            cuts, doc_at = cut_points(b), np.unique(off)
            # a hash that reaches over the start of its document would depend on the row before
            near = doc_at[np.searchsorted(doc_at, cuts, "right") - 1]
            cuts = cuts[cuts - near >= WINDOW]
            cuts = np.unique(np.concatenate([cuts, doc_at]))
            safe = np.unique(np.concatenate([safe_points(b), doc_at]))
            inner = np.searchsorted(doc_at, safe, "right") - 1
            safe = safe[(safe - doc_at[inner] >= 8) | (safe == doc_at[inner])]  # bytes of the row before prove nothing
            s = safe[np.searchsorted(safe, cuts[:-1])]
            e = safe[np.searchsorted(safe, cuts[1:], "right") - 1]
            keep = e > s
            s, e = s[keep], e[keep]
            row = np.searchsorted(off, s, "right") - 1
            view = memoryview(b)
            digests = [xxh3_128_digest(view[x:y]) for x, y in zip(s.tolist(), e.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), ids.take(pa.array(i + row)), pa.array((s - off[row]).astype(np.int32)), pa.array((e - s).astype(np.int32))], names=["h", "doc", "start", "len"])


def _valid(core: dict, text: bytes) -> bool:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(text[core["start"] : core["start"] + core["len"]]) == core["h"]


def _encode_cores(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer)
    for batch in batches:
        h, ids = [], []
        for text, cores in zip(batch.column("text").to_pylist(), batch.column("cores").to_pylist()):
            raw = text.encode()
            for c in cores:
                if _valid(c, raw):
                    h.append(c["h"])
                    ids.append(array("i", _encode(enc, raw[c["start"] : c["start"] + c["len"]].decode())).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(ids, pa.binary())], names=["h", "ids"])


def _encode_bounded(enc, text: str, most: int) -> list[int]:
    """The ids of a text; a very long one is encoded in parts that end at safe points, to bound memory."""
    if len(text) <= most:
        return enc.encode_ordinary(text)
    raw = text.encode()
    at, out, last = safe_points(np.frombuffer(raw, np.uint8)), [], 0
    for p in [*at[np.unique(np.searchsorted(at, np.arange(most, len(raw), most)).clip(max=max(0, len(at) - 1)))].tolist(), len(raw)] if len(at) else [len(raw)]:
        if p > last:
            out += enc.encode_ordinary(raw[last:p].decode())
            last = p
    return out


def _encode(enc, text: str, most: int = 1 << 20, long_run: int = LONG_RUN) -> list[int]:
    """The ids of a text of any length and content.

    White space of more than ``long_run`` characters in a row is merged apart from the pattern: all of it is one piece at
    the text's end, elsewhere all but its last character, which belongs to what follows.
    """
    if len(text) <= long_run:
        return enc.encode_ordinary(text)
    out, last = [], 0
    for m in _RUN.finditer(text):
        if m.end() - m.start() > long_run:
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += _encode_bounded(enc, text[last : m.start()], most)
            out += enc._encode_single_piece(text[m.start() : end])
            last = end
    return out + _encode_bounded(enc, text[last:], most)


def _assemble(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer) -> Iterator[pa.RecordBatch]:
    """Ids of whole documents: shared cores as they were encoded, what joins them re-encoded from the text."""
    enc = encoder(tokenizer)
    for batch in batches:
        docs, texts, cores = (batch.column(c) for c in ("doc", "text", "cores"))
        flat, ends, first = array("i"), [0], 0
        for k, (text, known) in enumerate(zip(texts.to_pylist(), cores.to_pylist())):
            if text:
                if known:
                    raw, last = text.encode(), 0
                    for c in sorted(known, key=lambda c: c["start"]):
                        if c["start"] >= last and _valid(c, raw):
                            flat.extend(_encode(enc, raw[last : c["start"]].decode()))
                            flat.frombytes(c["ids"])
                            last = c["start"] + c["len"]
                    flat.extend(_encode(enc, raw[last:].decode()))
                else:
                    flat.extend(_encode(enc, text))
            ends.append(len(flat))
            if len(flat) > 4_000_000 or k == len(texts) - 1:
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([docs.slice(first, k + 1 - first), ids], names=["doc", "ids"])
                flat, ends, first = array("i"), [0], k + 1


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: Tokenizer = BYTE_BPE_50K) -> DataFrame:
    """The token ids of every document, without special tokens: doc_id, ids (array<int>).

    Exactly what the tokenizer gives for the whole text; a null or empty text gives an empty list; repeated rows give
    repeated rows; other columns are ignored.

    Texts are cut where a rolling hash of their bytes says so, so equal passages are cut alike. Of each chunk the core
    between its first and last safe point is encoded alone as in any document; cores that occur more than once are
    encoded once and joined back, and what stands between cores (chunk ends and chunks that occur once) is encoded in
    its document from safe point to safe point. A core is used only where its digest fits the text, so rows that
    share an id but not a text stay right. Only digests, positions and the ids of shared cores are shuffled, besides
    the texts of documents that join them.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = spread(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")))
    cores = cut(rows.filter("doc is not null and text is not null").mapInArrow(_cores, f"h binary, doc {id_type}, start int, len int"))
    shared = cores.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    uses = cores.join(shared, "h")
    owner = uses.groupBy("h").agg(F.min(F.struct("doc", "start", "len")).alias("o")).select(F.col("o.doc").alias("doc"), F.struct("h", "o.start", "o.len").alias("c"))
    owners = owner.groupBy("doc").agg(F.collect_list("c").alias("cores"))
    encoded = cut(rows.join(owners, "doc").select("text", "cores").mapInArrow(partial(_encode_cores, tokenizer=tokenizer), "h binary, ids binary"))
    known = uses.join(encoded.dropDuplicates(["h"]), "h").groupBy("doc").agg(F.collect_list(F.struct("start", "len", "h", "ids")).alias("cores"))
    out = rows.join(known, "doc", "left").mapInArrow(partial(_assemble, tokenizer=tokenizer), f"doc {id_type}, ids array<int>")
    return out.select(F.col("doc").alias(doc_id), "ids")


def _count(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer)
    for batch in batches:
        n = [len(_encode(enc, t)) if t else 0 for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(n, pa.int64())], names=[*(c for c in batch.schema.names if c != "text"), "n_tokens"])


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: Tokenizer = BYTE_BPE_50K) -> DataFrame:
    """The columns ``keep`` and n_tokens (bigint), the number of the text's tokens; 0 for a null or empty text."""
    rows = spread(docs.select(*keep, F.col(text).alias("text")))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(partial(_count, tokenizer=tokenizer), f"{schema}, n_tokens bigint")
