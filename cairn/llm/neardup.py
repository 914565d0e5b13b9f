"""Problem 5: near-duplicate records with small edits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.shared import cut
from cairn.functions.text import is_blank, squeeze

#: The signature: PARTS chunks of SYMBOLS two-byte symbols each; ERRORS that one chunk may have and be found by.
PARTS, SYMBOLS, ERRORS = 6, 6, 2
#: Pairs that differ in at most BOUND symbols are found without fail, those in at most FAR compared exactly.
BOUND, FAR = PARTS * (ERRORS + 1) - 1, 22
#: Members up to which a bucket's pairs are made by a join, above which it is divided by a second key, and members of a block that is compared with another.
SMALL, HOT, BLOCK = 20, 2000, 2000
#: Characters of texts whose shingles a task keeps at hand.
KEPT = 1_500_000

_MIX, _BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(5).integers(1, 2**63, PARTS * SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


def bodies(hits: DataFrame, item: str = "chunk_id", content: str = "content", text: str = "text") -> DataFrame:
    """One row per non-null item: item, body (content, or text if that is null or blank, without white space; may be null)."""
    raw = F.when(is_blank(content), F.col(text)).otherwise(F.col(content))
    rows = hits.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), raw.alias("raw"))
    return rows.groupBy("item").agg(F.max("raw").alias("raw")).select("item", squeeze("raw").alias("body"))


def signatures_of(texts: list[str], shingle: int) -> np.ndarray:
    """One row of PARTS * SYMBOLS minimum hashes (32 bits) per text of at least ``shingle`` code points."""
    lengths = np.array([len(t) for t in texts], np.int64)
    p = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = p + np.uint64(1)
        for k in range(1, shingle):
            h[: len(p) - k] = h[: len(p) - k] * _BASE + p[k:] + np.uint64(1)
        ends = np.cumsum(lengths)
        whole = np.ones(len(p), bool)
        for k in range(1, shingle):
            whole[ends - k] = False
        h = _mixed(h[whole])
        starts = np.concatenate([[0], np.cumsum(lengths - shingle + 1)[:-1]])
        out = np.empty((len(texts), len(_SEEDS)), np.uint32)
        for i, a in enumerate(_SEEDS):
            out[:, i] = np.minimum.reduceat(((h * a) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _sign(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        items, texts = batch.column("item"), batch.column("body").to_pylist()
        size, i = 0, 0
        for j, t in enumerate(texts):
            size += len(t)
            if size > 400_000 or j == len(texts) - 1:
                part = texts[i : j + 1]
                minima = signatures_of(part, shingle)
                sig = _mixed(minima.astype(np.uint64)).astype(np.uint16)
                digest = [xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in part]
                yield pa.RecordBatch.from_arrays([items.slice(i, j + 1 - i), pa.array(digest, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["item", "digest", "sig"])
                size, i = 0, j + 1


def _symbols(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), PARTS * SYMBOLS)


def _choices(errors: int) -> list[list[int]]:
    """The symbols that each key is made of: of every chunk all but ``errors``, in every way."""
    return [[part * SYMBOLS + s for s in keep] for part in range(PARTS) for keep in combinations(range(SYMBOLS), SYMBOLS - errors)]


def _masked(sig: np.ndarray, errors: int) -> np.ndarray:
    """Per row the keys of all chunks with ``errors`` of their symbols left out in every way; the low bits name the chunk."""
    keys, wide = [], sig.astype(np.uint64)
    with np.errstate(over="ignore"):
        for n, keep in enumerate(_choices(errors)):
            h = np.full(len(sig), n + 1, np.uint64)
            for s in keep:
                h = _mixed(h * _BASE + wide[:, s] + np.uint64(1))
            keys.append((h & ~np.uint64(7)) | np.uint64(keep[0] // SYMBOLS))
    return np.stack(keys, axis=1)


def _divided(keys: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Second keys of members of hot buckets: the first key joined with each key of the other chunks that leaves out one symbol more.

    The first key's own chunk gives none: all members of a bucket agree in its symbols.
    """
    second = _masked(sig, ERRORS + 1)
    other = (second & np.uint64(7)) != (keys & np.uint64(7))[:, None]
    with np.errstate(over="ignore"):
        joined = _mixed(second * _BASE + keys[:, None])
    return joined[other].reshape(len(keys), -1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = _masked(_symbols(batch.column("sig").to_pylist()), ERRORS)
            r = np.repeat(batch.column("r").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(r)], names=["key", "r"])


def _second_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            b = batch.slice(i, 2000)
            first = b.column("key").to_numpy()
            keys = _divided(first.view(np.uint64), _symbols(b.column("sig").to_pylist()))
            at = np.repeat(np.arange(len(first)), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(first[at]), b.column("r").take(pa.array(at)), b.column("sig").take(pa.array(at))], names=["key", "first", "r", "sig"])


def _first_shared(a: np.ndarray, b: np.ndarray, errors: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signatures the number of the first key that both have (of a chunk other than ``skip``), and whether there is one."""
    equal = a == b
    both = np.stack([equal[:, keep].all(axis=1) & (True if skip is None else skip != keep[0] // SYMBOLS) for keep in _choices(errors)], axis=1)
    return both.argmax(axis=1), both.any(axis=1)


def _agreeing(ra: np.ndarray, a: np.ndarray, rb: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two blocks that differ in at most FAR symbols, the smaller number first."""
    if len(a) * len(b) < 4000:
        agree = (a[:, None, :] == b[None, :, :]).sum(axis=2)
    else:
        agree = np.zeros((len(a), len(b)), np.uint8)
        for s in range(PARTS * SYMBOLS):
            agree += a[:, s][:, None] == b[:, s][None, :]
    return np.nonzero((agree >= PARTS * SYMBOLS - FAR) & (ra[:, None] < rb[None, :]))


def _first_here(a: np.ndarray, b: np.ndarray, key: np.ndarray, first: np.ndarray | None) -> np.ndarray:
    """Whether the bucket that a pair of signatures was found in (a key; a second key with its first one) is the first that both share."""
    n, _ = _first_shared(a, b, ERRORS)
    own = _masked(a, ERRORS)[np.arange(len(a)), n].view(np.int64)
    if first is None:
        return own == key
    n, some = _first_shared(a, b, ERRORS + 1, first & 7)
    with np.errstate(over="ignore"):
        second = _mixed(_masked(a, ERRORS + 1)[np.arange(len(a)), n] * _BASE + first.view(np.uint64))
    return (own == first) & some & (second.view(np.int64) == key)


def _members(members: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([m["r"] for m in members], np.int64), _symbols([m["sig"] for m in members])


def _compare_buckets(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Near pairs of buckets given as one block (m) or as two (m and o), each from the first bucket that it shares."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        ra, a, rb, b, key, first = (np.concatenate(x) for x in zip(*held))
        ok = _first_here(a, b, key, first if two_keys else None)
        return pa.RecordBatch.from_arrays([pa.array(ra[ok]), pa.array(rb[ok])], names=["lo", "hi"])

    for batch in batches:
        two_keys = "first" in batch.schema.names
        for row in batch.to_pylist():
            r, sig = _members(row["m"])
            sides = [(r, sig, r, sig)]
            if row.get("o") is not None:
                r2, sig2 = _members(row["o"])
                sides = [(r, sig, r2, sig2), (r2, sig2, r, sig)]
            for ra, a, rb, b in sides:
                i, j = _agreeing(ra, a, rb, b)
                for at in range(0, len(i), most):
                    x, y = i[at : at + most], j[at : at + most]
                    held.append((ra[x], a[x], rb[y], b[y], np.full(len(x), row["key"], np.int64), np.full(len(x), row.get("first") or 0, np.int64)))
                    if sum(len(h[0]) for h in held) >= most:
                        yield flush()
                        held = []
        if held:
            yield flush()
            held = []


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates whose signatures differ in at most FAR symbols."""
    for batch in batches:
        if batch.num_rows:
            a, b = (_symbols(batch.column(c).to_pylist()) for c in ("sig_lo", "sig_hi"))
            yield batch.select(["lo", "hi"]).filter(pa.array((a != b).sum(axis=1) <= FAR))


def candidates(signed: DataFrame) -> DataFrame:
    """Pairs of different texts that a multi-index Hamming join finds, of signatures that differ in at most FAR symbols: lo, hi (each once), of signed (r, sig).

    The signature is split into PARTS chunks; for each, a key is made of every choice of symbols that leaves out the
    ERRORS a chunk may have. By the pigeonhole principle two signatures that differ in at most BOUND symbols have a
    chunk with at most ERRORS of them, so they share a key. Keys are counted first; a bucket of two gives its pair from the
    count itself, up to SMALL members by a join. Up to HOT members are compared in one task by their signatures, and what leaves
    it are near pairs only, from the first bucket that a pair shares, not from all. Larger buckets are divided by second keys, of the other chunks
    only, that leave out one symbol more: BOUND differences over the PARTS - 1 other chunks leave one with that few, so no
    pair within BOUND is lost. What is still large holds texts that agree in two chunks; it is compared block against block.
    """
    keys, sig = signed.select("r", "sig").mapInArrow(_keys, "key bigint, r bigint"), signed.select("r", "sig")
    counted = cut(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).filter("n > 1"))
    two = counted.filter("n = 2 and lo < hi").select("lo", "hi")
    # only keys of larger buckets are kept, and all ways of comparing start from them
    larger = cut(keys.join(counted.filter("n > 2").select("key", "n"), "key"))
    few = larger.filter(F.col("n") <= min(SMALL, HOT)).select("key", "r")
    few = few.withColumnRenamed("r", "lo").join(few.withColumnRenamed("r", "hi"), "key").filter("lo < hi").select("lo", "hi")
    small = two.unionByName(few).distinct()
    small = small.join(sig.withColumnsRenamed({"r": "lo", "sig": "sig_lo"}), "lo").join(sig.withColumnsRenamed({"r": "hi", "sig": "sig_hi"}), "hi").mapInArrow(_near, "lo bigint, hi bigint")
    gathered = F.collect_list(F.struct("r", "sig")).alias("m")
    wide = larger.filter(F.col("n") > min(SMALL, HOT)).join(sig, "r")
    usual = wide.filter(F.col("n") <= HOT).groupBy("key").agg(gathered).mapInArrow(_compare_buckets, "lo bigint, hi bigint")
    found = small.unionByName(usual)
    if not larger.filter(F.col("n") > HOT).isEmpty():
        hot = wide.filter(F.col("n") > HOT)
        second = cut(hot.mapInArrow(_second_keys, "key bigint, first bigint, r bigint, sig binary"))
        sizes = second.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
        block = second.join(sizes, "key").groupBy("key", "first", "blocks", F.pmod(F.hash("r"), "blocks").alias("own")).agg(gathered)
        block = cut(block)
        a = block.withColumn("with", F.explode(F.sequence("own", F.col("blocks") - 1)))
        b = block.select("key", F.col("own").alias("with"), F.col("m").alias("o"))
        # a block is compared with itself and with those after it
        pairs = a.join(b, ["key", "with"]).select("key", "first", "m", F.when(F.col("own") != F.col("with"), F.col("o")).alias("o"))
        found = found.unionByName(pairs.mapInArrow(_compare_buckets, "lo bigint, hi bigint"))
    return found.distinct()


def jaccard(a: str, b: str, shingle: int) -> float:
    """The similarity of the sets of the texts' substrings of ``shingle`` code points."""
    x, y = ({t[i : i + shingle] for i in range(len(t) - shingle + 1)} for t in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


class _Shingles:
    """The shingles of texts, kept until their texts have KEPT characters: a text of a dense group is taken apart once, not for each pair."""

    def __init__(self, shingle: int):
        self.shingle, self.held, self.size = shingle, {}, 0

    def of(self, text: str) -> set[str]:
        found = self.held.get(text)
        if found is None:
            found = {text[i : i + self.shingle] for i in range(len(text) - self.shingle + 1)}
            if self.size + len(text) > KEPT:
                self.held, self.size = {}, 0
            self.held[text] = found
            self.size += len(text)
        return found


def _compare(batches: Iterator[pa.RecordBatch], shingle: int, least: float) -> Iterator[pa.RecordBatch]:
    shingles = _Shingles(shingle)
    for batch in batches:
        j = np.zeros(batch.num_rows)
        for k, (a, b) in enumerate(zip(batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist())):
            x, y = shingles.of(a), shingles.of(b)
            both = len(x & y)
            j[k] = both / (len(x) + len(y) - both) if x or y else 0.0
        keep = pa.array(j >= least)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(j[j >= least])], names=["a", "b", "similarity"])


def near_duplicates(hits: DataFrame, shingle: int = 5, least: float = 0.7, item: str = "chunk_id", content: str = "content", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs of nearly equal texts and the items that have them: (pairs, members).

    pairs: a, b, similarity, where a and b are the representatives (smallest item) of two different texts and the sets
    of their substrings of ``shingle`` code points have a Jaccard similarity of ``least`` or more, computed exactly.
    members: item, rep for every non-null item whose body has at least ``shingle`` code points; items with equal
    bodies share a rep, so copies cost nothing in the search. Null and short bodies are in neither; other columns are
    ignored; an item counts once, however many rows have it.

    The search is a multi-index Hamming join over signatures of minimum hashes (see candidates). Texts of similarity
    s differ in a share of 1 - s of the symbols on average: at 0.7 the guarantee covers 99 % of the pairs, and with
    pairs that meet without being guaranteed to, 99.97 % are found; more at higher similarity. Candidates that differ
    in more than FAR symbols aren't compared: at 0.7 that is one pair in 37,000, at 0.75 one in a million.
    """
    item_type = hits.schema[item].dataType.simpleString()
    all_ = bodies(hits, item, content, text).filter(F.length("body") >= shingle)
    signed = cut(all_.mapInArrow(partial(_sign, shingle=shingle), f"item {item_type}, digest binary, sig binary"))
    reps = signed.groupBy("digest").agg(F.min("item").alias("rep"))
    members = signed.select("item", "digest").join(reps, "digest").select("item", "rep")
    # the number of a text: 64 bits of its digest; two texts with one number would both be compared
    number = F.xxhash64("digest").alias("r")
    texts = cut(signed.join(reps.withColumnRenamed("rep", "item"), ["digest", "item"]).select(number, "item", "sig"))
    near = cut(candidates(texts.select("r", "sig")))
    needed = near.select(F.explode(F.array("lo", "hi")).alias("r")).distinct().join(texts.select("r", "item"), "r")
    wanted = hits.join(needed.select(F.col("item").alias(item)), item, "left_semi")
    body = cut(bodies(wanted, item, content, text).join(needed, "item"))
    pairs = near.join(body.select(F.col("r").alias("lo"), F.col("item").alias("a"), F.col("body").alias("body_a")), "lo")
    pairs = pairs.join(body.select(F.col("r").alias("hi"), F.col("item").alias("b"), F.col("body").alias("body_b")), "hi")
    pairs = pairs.select("a", "b", "body_a", "body_b").mapInArrow(partial(_compare, shingle=shingle, least=least), f"a {item_type}, b {item_type}, similarity double")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"), members


def item_pairs(pairs: DataFrame, members: DataFrame, copies: int = 1000) -> DataFrame:
    """Pairs of items with nearly equal or equal texts: item_a, item_b (the smaller first).

    Every item of one text is paired with every item of the other, and items with the same text with each other. A
    text that more than ``copies`` items have is stood for by its representative: each of its items is paired with the
    representative, and only that one with items of other texts. So the pairs of a text grow with its items, not with
    their square, and together with the members say the same.
    """
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    sized = members.join(sizes, "rep")
    shown = sized.filter((F.col("n") <= copies) | (F.col("item") == F.col("rep")))
    ma, mb = shown.select(F.col("rep").alias("a"), F.col("item").alias("x")), shown.select(F.col("rep").alias("b"), F.col("item").alias("y"))
    across = pairs.select("a", "b").join(ma, "a").join(mb, "b").select("x", "y")
    some = sized.filter((F.col("n") > 1) & (F.col("n") <= copies))
    within = some.select("rep", F.col("item").alias("x")).join(some.select("rep", F.col("item").alias("y")), "rep").filter("x < y").select("x", "y")
    star = sized.filter((F.col("n") > copies) & (F.col("item") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("item").alias("y"))
    both = across.unionByName(within).unionByName(star)
    return both.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))


def components(edges: DataFrame) -> DataFrame:
    """The connected component of every node of edges (a, b): node, root (the smallest node of the component).

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the smallest it knows, until
    nothing changes, however many rounds that takes (their number is logarithmic). Every round is written to the
    checkpoint folder.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The group of every item: item, rep, group_id (the smallest representative of the group), n_links.

    n_links counts the other texts that the item's text is nearly equal to; an item without any is its own group.
    """
    comp = components(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    reps = comp.select(F.col("node").alias("rep"), "root").join(links, "rep", "left")
    out = members.join(reps, "rep", "left")
    return out.select("item", "rep", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
