import pytest

from cairn.functions import packed as P
from cairn.operators.packed import split_packed


def parse(field):
    return [(i, v) for i, v in enumerate(P.slots(field, P.MARKS, True), 1) if v]


@pytest.mark.parametrize(
    "field, want",
    [
        ("a|b", ["a", "b"]),
        ("a||b|", ["a", None, "b", None]),
        ("　a 　；　b", ["a", "b"]),
        ("'in;out'|b", ["in;out", "b"]),
        ('"size ""L"", boxed"|b', ['size "L", boxed', "b"]),
        ("'owner''s mark', owner's mark", ["owner's mark", "owner's mark"]),
        ('{"3/4\\" outlet";"b"}', ['3/4" outlet', "b"]),
        ('["a, b", \'c\',  ]', ["a, b", "c", None]),
        ("[a ; b]", ["a", "b"]),
        ("[a];[b]", ["[a]", "[b]"]),
        ("load (kN | static)|depth [m, avg]", ["load (kN | static)", "depth [m, avg]"]),
        ("部位（1；2）；b", ["部位（1；2）", "b"]),
        ("甲\\｜乙｜丙", ["甲｜乙", "丙"]),
        ("「a，b」、“c；d”", ["a，b", "c；d"]),
        ("“进口”件|b", ["“进口”件", "b"]),
        ('3/4" outlet|b"', ['3/4" outlet', 'b"']),
        ("'open|b", ["'open", "b"]),
        ("(open|b", ["(open", "b"]),
        ("a\nb\tc", ["a", "b", "c"]),
        ("one", ["one"]),
        ("a\\b", ["a\\b"]),
        ("a - b / c : d . e", ["a - b / c : d . e"]),
    ],
)
def test_slots(field, want):
    assert parse(field) == [(i, v) for i, v in enumerate(want, 1) if v]


def test_unclosed_and_odd_fields_do_not_crash():
    for f in ["", "\\", "'", "[", "]", "[]", "{}", "''", "|", "\\|", "「", "a" * 100_000 + "|b", "(" * 500 + "|"]:
        P.dialects(f)
        P.slots(f, P.MARKS, True)


SCHEMA = "hit_id bigint, headers_norm string, pos int, field string, val string"


def rows(spark, fields):
    df = spark.createDataFrame([(i, f, 9, "clash", "clash") for i, f in enumerate(fields)], SCHEMA)
    return {(r.hit_id, r.pos, r.val) for r in split_packed(df).collect()}


def test_operator(spark):
    common = [f"{a}|{b}|{c}" for a in ("unit", "area", "depth") for b in ("no.", "qty") for c in ("tax", "net")]
    fields = common + [None, "", " 　", "'unit;area'；depth", "unit|area", "unit|area", "unit;;net"]
    got = rows(spark, fields)
    n = len(common)
    assert {x for x in got if x[0] < n} == {(i, p, v) for i, f in enumerate(common) for p, v in enumerate(f.split("|"), 1)}
    assert {x[1:] for x in got if x[0] == n + 3} == {(1, "unit;area"), (2, "depth")}
    assert {x[1:] for x in got if x[0] == n + 4} == {x[1:] for x in got if x[0] == n + 5} == {(1, "unit"), (2, "area")}
    assert {x[1:] for x in got if x[0] == n + 6} == {(1, "unit"), (3, "net")}
    assert not {x for x in got if n <= x[0] < n + 3}


def test_empty(spark):
    assert rows(spark, []) == set()
    assert rows(spark, [None, ""]) == set()


@pytest.mark.parametrize("seps, others", [("|;", "，、"), ("|；", ",、"), ("|,;", "，、"), ("、|;", ",，")])
def test_many_marks(spark, seps, others):
    """Fields with four or five marks of which two or three separate: the parse whose values the corpus knows wins."""
    import random

    rng = random.Random(5)
    # values that hold one of the other marks each, and are known from fields of their own
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    names = [f"{word()}{m}{word()}" for m in others for _ in range(12000 // len(others))]
    known = [rng.choice(seps).join(rng.sample(names, 2)) for _ in range(9000)] + names
    want, fields = {}, list(known)
    for _ in range(12):
        values = [next(n for n in rng.sample(names, len(names)) if m in n) for m in others] + rng.sample(names, 2)
        rng.shuffle(values)
        marks = [seps[k % len(seps)] for k in range(len(values) - 1)]
        want[len(fields)] = list(enumerate(values, 1))
        fields.append("".join(v + m for v, m in zip(values, [*marks, ""])))
    got = rows(spark, fields)
    for i, values in want.items():
        assert sorted(x[1:] for x in got if x[0] == i) == values


def test_all_subsets_of_marks():
    for n in range(len(P.MARKS) + 1):
        field = "x" + "".join(f"{m}v" for m in P.MARKS[:n])
        assert len(set(P.dialects(field))) == 2**n


def test_long_field_with_all_marks(spark):
    field = "".join(f"v{i % 40}{P.MARKS[i % 6]}" for i in range(400))
    assert {v for _, _, v in rows(spark, [field] + [f"v{i}" for i in range(40)] * 3)} >= {f"v{i}" for i in range(40)}


def test_unclosed_brackets_and_quotes_in_long_fields():
    """What never closes is found once, not from every opening anew."""
    n = 200_000
    for unit in ("(", "“a,", "[(", "（;", "「x|"):
        field = unit * n
        marks = [i for i, c in enumerate(field) if c in P.MARKS]
        assert P.cuts(field, P.MARKS, True) == marks
        assert P.unwrap(field) == field
    assert P.cuts("(" * n + "a,b)" + ",c", ",", True) == [n + 4]
