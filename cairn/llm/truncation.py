"""Problem 4: text cut off by field limits or in transfer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.shared import cut, tasks
from cairn.functions.text import WHITE_SPACE, is_blank

#: The lengths of the endings that are looked up, and the weight of the share of the next shorter one.
ORDERS, WEIGHT = (1, 2, 3, 4, 5, 6, 7), 8.0
#: The share under which an ending counts as unfinished: anywhere, at a limit, and before a sign of a cut.
UNFINISHED, UNFINISHED_AT_LIMIT, UNFINISHED_SIGNED = 0.05, 0.15, 0.3
#: Neighbouring lengths on either side, how many times their hazard a limit has at least, and the false-discovery rate.
NEIGHBOURS, LIFT, RATE = 4, 2.0, 0.01
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)

# What systems put after a text they cut (marks with how often they stand at least, short signs, words
# after a round bracket), and characters that end a sentence.
RUNS = {".": 3, "…": 1, "\ufffd": 1, "—": 1, "-": 2, ">": 2}
SHORT_SIGN = re.compile(r"(?:\[[^\[\]]{1,12}\]?|【[^【】]{1,6}】?|（[^（）]{0,2}[略未续断][^（）]{0,2}）?|&[a-z#][a-z0-9]{0,4};?|<[a-z/]{0,4}|\\[nu]?[0-9a-f]{0,4})\Z")
NOTES = ("more", "cut", "cont", "truncated", "continued")
STOPS = "。.!?！？"
BRACKETS = ("()", "（）", "[]", "【】", "「」", "《》")
# Words whose ellipsis is the author's own.
OPEN_LISTS = re.compile(r"(?:等等?|\b(?:etc|and so on|and so forth))$")


def _sign_start(v: str, end: int) -> int:
    """Where the sign of a cut that ends at ``end`` begins; ``end`` if there is none."""
    c, i = v[end - 1], end
    while i and v[i - 1] == c and c in RUNS:
        i -= 1
    if end - i >= RUNS.get(c, 1) and i < end:
        return i - 1 if i and v[i - 1] in "[【" else i
    window = v[max(0, end - 14) : end]
    if m := SHORT_SIGN.search(window):
        return end - len(window) + m.start()
    p = v.rfind("(", 0, end)
    return p if p >= 0 and v.startswith(NOTES, p + 1, end) and v.find(")", p, end - 1) < 0 else end


def _bare(value: str) -> tuple[str, bool]:
    """The value without white space and signs of a cut at its end, and whether it had such a sign.

    Signs are taken off one by one from the end, so a long text of nothing but marks costs no more than its length.
    """
    v = value.rstrip(WHITE_SPACE)
    end = len(v)
    while end and (start := _sign_start(v, end)) < end:
        end = start
        while end and v[end - 1] in WHITE_SPACE:
            end -= 1
    return (v[:end], True) if 0 < end < len(v) else (v, False)


def _ended(bare: str) -> bool:
    """Whether a text ends in a stop outside of brackets, or as an open list does."""
    if OPEN_LISTS.search(bare):
        return True
    return bare[-1:] in STOPS and all(bare.count(a) <= bare.count(b) for a, b in BRACKETS)


def _shapes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with digits and capitals made alike, a start mark before each text; and where the texts end."""
    p = np.frombuffer(("\x01" + "\x01".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    p[(p >= 48) & (p <= 57)] = 57
    p[(p >= 65) & (p <= 90)] = 65
    return p, np.cumsum([len(t) + 1 for t in texts])


def _contexts(texts: list[str], kinds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order k a hash of the k symbols that end at each position (0 where they would reach over the text's start), and the ends."""
    p, ends = _shapes(texts)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.arange(len(p)) - np.repeat(starts, ends - starts) + 1
    kind = np.repeat(kinds.astype(np.uint64), ends - starts)
    out = []
    with np.errstate(over="ignore"):
        one, h = (p + np.uint64(7)) * _MIX, np.zeros(len(p), np.uint64)
        for k in range(1, max(ORDERS) + 1):
            # the k symbols up to i are the k - 1 up to i - 1 and one more
            h = np.concatenate([[np.uint64(0)], h[:-1]]) * _BASE + one
            if k not in ORDERS:
                continue
            x = h + (kind * np.uint64(16) + np.uint64(k)) * _MIX
            x = (x ^ (x >> np.uint64(31))) * _BASE
            x ^= x >> np.uint64(29)
            out.append(np.where(inside >= k, x, np.uint64(0)))
    return out, ends - 1


#: What _endings gives: rows of values, and rows of contexts (c) with how often they occur and how often a value ends with them.
_SCHEMA = "kind int, value string, lengths array<int>, stop boolean, sign boolean, ctx array<bigint>, c bigint, total bigint, ends bigint"
_TYPES = [("kind", pa.int32()), ("value", pa.string()), ("lengths", pa.list_(pa.int32())), ("stop", pa.bool_()), ("sign", pa.bool_()), ("ctx", pa.list_(pa.int64())), ("c", pa.int64()), ("total", pa.int64()), ("ends", pa.int64())]


def _rows(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in _TYPES], names=[c for c, _ in _TYPES])


class _Tally:
    """Contexts counted within a task."""

    def __init__(self) -> None:
        self.held: list[pa.Table] = []

    def add(self, x: np.ndarray, total: bool) -> None:
        c = pa.array(x.view(np.int64)).value_counts()
        n, none = c.field("counts"), pa.array(np.zeros(len(c), np.int64))
        self.held.append(pa.table({"c": c.field("values"), "total": n if total else none, "ends": none if total else n}))

    def merged(self) -> pa.Table:
        t = pa.concat_tables(self.held).group_by("c", use_threads=False).aggregate([("total", "sum"), ("ends", "sum")])
        return t.rename_columns({"total_sum": "total", "ends_sum": "ends"})

    def rows(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        """What is held, if it is more than ``most`` after adding up."""
        if sum(map(len, self.held)) > 3 * most // 2:
            self.held = [self.merged()] if self.held else []
            if sum(map(len, self.held)) > most:
                for b in self.held.pop().to_batches():
                    yield _rows({c: b.column(c) for c in ("c", "total", "ends")}, b.num_rows)


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each value its lengths, whether it ends in a stop (or an open list) or with a sign of a cut, and the contexts it ends with; and the tally of all contexts."""
    tally = _Tally()
    for batch in batches:
        values, kinds = batch.column("value").to_pylist(), batch.column("kind").to_numpy(zero_copy_only=False)
        pairs = [_bare(v) for v in values]
        bare, size, i = [b for b, _ in pairs], 0, 0
        for j, t in enumerate(bare):
            size += len(t)
            if size > 300_000 or j == len(bare) - 1:
                part = slice(i, j + 1)
                orders, last = _contexts(bare[part], kinds[part])
                for x in orders:
                    tally.add(x[x != 0], True)
                    tally.add(x[last][x[last] != 0], False)
                ctx = np.stack([x[last] for x in orders], axis=1).view(np.int64)
                lengths = [[len(v), len(v.encode("utf-8", "replace")), len(b), len(b.encode("utf-8", "replace"))] for v, b in zip(values[part], bare[part])]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, ctx.size + 1, len(ORDERS), dtype=np.int32)), pa.array(ctx.reshape(-1)))
                columns = {"kind": batch.column("kind").slice(i, len(ctx)), "value": batch.column("value").slice(i, len(ctx)), "lengths": pa.array(lengths, pa.list_(pa.int32()))}
                columns |= {"stop": pa.array([_ended(b) for b in bare[part]]), "sign": pa.array([s for _, s in pairs[part]]), "ctx": flat}
                yield _rows(columns, len(ctx))
                size, i = 0, j + 1
        yield from tally.rows(2_000_000)
    yield from tally.rows()


MEASURES = ["characters", "bytes", "characters before a sign", "bytes before a sign"]


def length_hazards(endings: DataFrame) -> DataFrame:
    """The hazard of each length and whether it is a limit: kind, measure, length, n, at_risk, hazard, expected, bound, limit.

    The hazard of a length is the share of the values that reach it which end there unfinished (a ratio under
    UNFINISHED_SIGNED and no stop): whole values end at favoured lengths, too, so they are only at risk.
    ``expected`` is how many would end there at the hazard of the lengths around it, ``bound`` the Chernoff bound of the chance of n or more if that
    is the mean of a Poisson count. By Benjamini and Hochberg's procedure over all lengths of all fields and
    measures, those with a bound small enough for the false-discovery rate and LIFT times the expected number are limits.
    The windows run over counts per length, which are no more than the longest value has characters; the procedure's
    ranks are counted per power of e of the bound, so no task ranks all lengths.
    """
    unfinished = ~F.col("stop") & (F.coalesce("ratio", F.lit(1.0)) < UNFINISHED_SIGNED)
    each = endings.select("kind", unfinished.alias("u"), F.posexplode("lengths").alias("measure", "length"))
    n = each.groupBy("kind", "measure", "length").agg(F.count_if("u").alias("n"), F.count("*").alias("all"))
    by = Window.partitionBy("kind", "measure").orderBy("length")
    n = n.withColumn("at_risk", F.sum("all").over(by.rangeBetween(0, Window.unboundedFollowing))).drop("all")
    n = n.withColumn("hazard", F.col("n") / F.col("at_risk"))
    # the neighbours' hazard by their events and risks; a length that no value has adds no event and about the same risk
    near = by.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    events, present = F.sum("n").over(near) - F.col("n"), F.count("*").over(near) - 1
    risk = F.sum("at_risk").over(near) - F.col("at_risk") + F.col("at_risk") * (2 * NEIGHBOURS - present)
    n = n.withColumn("expected", (events + 1) / risk * F.col("at_risk"))
    over = F.col("n") * F.ln(F.greatest(F.col("n"), F.lit(1)) / F.col("expected")) - F.col("n") + F.col("expected")
    n = n.withColumn("bound", F.when(F.col("n") > F.col("expected"), F.exp(-over)).otherwise(1.0))
    n = cut(n)
    tests = n.count()
    # a bound over the rate passes at no rank; the others are ranked within their power of e, after those of all smaller ones
    small = n.filter(F.col("bound") <= RATE).withColumn("power", F.floor(-F.ln(F.greatest("bound", F.lit(1e-300)))))
    powers = small.groupBy("power").agg(F.count("*").alias("c"))  # at most 691 rows
    before = F.sum("c").over(Window.orderBy(F.col("power").desc()).rowsBetween(Window.unboundedPreceding, -1))
    ranked = small.join(powers.select("power", F.coalesce(before, F.lit(0)).alias("before")), "power")
    place = F.col("before") + F.row_number().over(Window.partitionBy("power").orderBy("bound"))
    passed = ranked.withColumn("place", place).filter(F.col("bound") <= RATE * F.col("place") / F.lit(max(tests, 1))).agg(F.max("bound")).first()[0]
    return n.withColumn("limit", (F.col("bound") <= F.lit(-1.0 if passed is None else passed)) & (F.col("n") >= LIFT * F.col("expected")))


def endings_of(values: DataFrame) -> DataFrame:
    """Distinct non-blank values with what their endings show: kind, value, lengths, stop, sign, ratio.

    ratio: of all other places in values of the kind where the text's last symbols occur (digits alike, capitals
    alike), the share at which a value ends. The shares by the numbers of symbols in ORDERS are joined, each drawn towards
    that by fewer symbols as if it had been seen WEIGHT times. Whole values end as others end; a cut value ends where
    others go on.
    """
    distinct = values.filter(~is_blank("value")).select("kind", "value").distinct()
    # every value is read once: its own rows and the counts of contexts come from one pass
    both = cut(distinct.repartition(tasks(values.sparkSession), "kind", "value").mapInArrow(_endings, _SCHEMA))
    tails = both.filter("kind is not null").drop("c", "total", "ends")
    tally = both.filter("c is not null").groupBy(F.col("c").alias("ctx")).agg(F.sum("total").alias("total"), F.sum("ends").alias("ends"))
    asked = tails.select(F.xxhash64("kind", "value").alias("v"), F.posexplode("ctx").alias("k", "ctx")).filter("ctx <> 0")
    judged = asked.join(tally.filter("ends > 0"), "ctx").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("k", "ends", "total"))).alias("by"))
    share = lambda r, x: (x["ends"] - 1 + WEIGHT * r) / (x["total"] - 1 + WEIGHT)
    judged = judged.select("v", F.aggregate("by", F.lit(0.05), share).alias("ratio"))
    return tails.drop("ctx").withColumn("v", F.xxhash64("kind", "value")).join(judged, "v", "left").drop("v")


def cut_values(endings: DataFrame, hazards: DataFrame) -> DataFrame:
    """The values that lost their end and by which rule: kind, value, reason (limit, sign or transfer).

    A value is cut if its ending is unfinished: its ratio is under UNFINISHED_AT_LIMIT where one of its lengths is a
    limit, under UNFINISHED_SIGNED before a sign of a cut, or under UNFINISHED anywhere (a cut in transfer); and the
    text (before a sign, if it has one) doesn't end in a stop. An own ellipsis, a missing full stop or a length equal
    to a limit alone make no case.
    """
    # in bytes, a cut text may fall short of its limit by a part of a character
    short = F.when(F.col("measure") % 2 == 1, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    limits = hazards.filter("limit").select("kind", "measure", "length", F.explode(short).alias("less"))
    limits = limits.select("kind", F.col("measure").alias("m"), (F.col("length") - F.col("less")).alias("l")).distinct()
    at = endings.select("kind", "value", F.posexplode("lengths").alias("m", "l")).join(limits, ["kind", "m", "l"], "left_semi")
    at = at.select("kind", "value").distinct().withColumn("at_limit", F.lit(True))
    e = endings.filter("not stop").join(at, ["kind", "value"], "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))
    limit = F.when(F.col("at_limit") & (F.col("ratio") < UNFINISHED_AT_LIMIT), "limit")
    reason = limit.when(F.col("sign") & (F.col("ratio") < UNFINISHED_SIGNED), "sign").when(F.col("ratio") < UNFINISHED, "transfer")
    return e.withColumn("reason", reason).filter("reason is not null").select("kind", "value", "reason")


def text_values(tables: list[tuple[str, DataFrame, list[str]]], row_id: str = "row_id", source: str = "document_id") -> DataFrame:
    """The non-null values of the named fields of tables: ref_table, field, kind (int), row_id, source, value."""
    parts, kind = [], 0
    for name, df, fields in tables:
        for f in fields:
            const = lambda x: F.lit(x)
            parts.append(df.filter(F.col(f).isNotNull()).select(const(name).alias("ref_table"), const(f).alias("field"), const(kind).cast("int").alias("kind"), F.col(row_id).alias("row_id"), F.col(source).alias("source"), F.col(f).alias("value")))
            kind += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def truncated(values: DataFrame) -> DataFrame:
    """The rows of text_values with cut (boolean): whether the value lost its end; and reason, the rule by which (null if whole).

    Null values have no row; blank ones are whole; equal values of a field are judged once and alike, however many
    rows hold them; other columns are kept. An empty table gives no row.
    """
    endings = cut(endings_of(values))
    found = cut_values(endings, length_hazards(endings)).withColumn("cut", F.lit(True))
    return values.join(found, ["kind", "value"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))


def truncation_report(judged: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per namespace of the source and field: namespace (null if unknown), ref_table, field, n_values, n_cut, cut_share, n_limit, n_sign, n_transfer."""
    spaces = metadata.filter("document_id is not null").groupBy(F.col("document_id").alias("source")).agg(F.max("namespace").alias("namespace"))
    per = judged.join(spaces, "source", "left").groupBy("namespace", "ref_table", "field")
    by = [F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(f"n_{r}") for r in ("limit", "sign", "transfer")]
    out = per.agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"), *by)
    return out.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_values"), 6))
