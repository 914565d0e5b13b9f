import random
import time

from cairn.llm import truncation as T

ENT = "row_id bigint, document_id int, entity_name string, description string, kind string, source string, value string, cut string"
NOUN = ["pump", "valve", "strainer", "manifold", "gateway", "bracket", "parapet", "conduit"]
VERB = ["feeds", "supports", "follows", "protects", "measures", "replaces"]


def sentence(rng):
    return f"The {rng.choice(NOUN)} {rng.choice(VERB)} the {rng.choice(NOUN)} of block {rng.randrange(10, 99)} whenever {rng.choice(NOUN)} checks are due."


def text(rng, n):
    return " ".join(sentence(rng) for _ in range(n))


def table(spark, values):
    rows = [(i, 1 + i % 3, f"n{i}", v, "clash", "clash", "clash", "clash") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, ENT)


def judge(spark, values):
    v = T.text_values([("entities", table(spark, values), ["description"])])
    return {r.row_id for r in T.truncated(v).filter("cut").collect()}


def test_limits_and_transfer(spark):
    rng = random.Random(2)
    whole = [text(rng, rng.randrange(1, 5)) for _ in range(900)] + [f"{rng.choice(NOUN)} spare list" for _ in range(60)]
    whole = [w for w in whole if len(w) != 120]
    longer = [w for w in (text(rng, 3) for _ in range(400)) if w[119] not in " ." and w[118] != "."][:60]
    limit = [w[:120] for w in longer]
    signed = [w[:90] + s for w, s in zip(longer, ["...", "…", "[cut]", "【未完】", "�"] * 4)]
    transfer = [w[: rng.randrange(40, 60)].rstrip(" .") + "e"[:0] for w in longer[:20]]
    odd = [None, "", "   ", "Lists pumps, valves, etc...", text(rng, 3)]
    values = whole + limit + signed + transfer + odd + limit[:2]
    got = judge(spark, values)
    n = len(whole)
    cut = set(range(n, n + len(limit) + len(signed)))
    assert not {i for i in got if i < n}, "whole values are no case"
    assert len(cut & got) >= 0.97 * len(cut)
    t = set(range(n + len(limit) + len(signed), n + len(limit) + len(signed) + len(transfer)))
    assert len(t & got) >= 0.8 * len(t)
    last = len(values)
    assert {last - 2, last - 1} <= got, "equal values are judged alike"
    assert not got & set(range(last - 7, last - 2))


def test_limit_lengths_are_found(spark):
    rng = random.Random(4)
    values = [text(rng, rng.randrange(1, 4)) for _ in range(600)] + [text(rng, 3)[:101] for _ in range(50)]
    v = T.text_values([("entities", table(spark, values), ["description"])])
    limits = {r.length for r in T.length_hazards(T.endings_of(v)).filter("limit and measure = 0").collect()}
    assert limits == {101}


def test_empty_and_report(spark):
    assert judge(spark, []) == set()
    assert judge(spark, [None, ""]) == set()
    v = T.text_values([("entities", table(spark, ["a whole text.", None, ""]), ["description"])])
    meta = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (None, "y")], "document_id int, namespace string")
    got = {(r.namespace, r.n_values, r.n_cut) for r in T.truncation_report(T.truncated(v), meta).collect()}
    assert got == {("x", 1, 0), (None, 1, 0)}


def test_long_text(spark):
    assert judge(spark, ["x" * 300_000 + ".", "y"]) <= {0, 1}


def test_signs_come_off_from_the_end():
    from cairn.llm.truncation import _bare

    for value, want in [
        ("cut of...", "cut of"), ("cut of ..", None), ("cut of… [more]", "cut of"), ("cut of [...", "cut of"), ("cut of &am", "cut of"), ("cut of <b", "cut of"),
        ("cut of (continued on the next page)", "cut of"), ("cut (of)", None), ("cut of\\u00", "cut of"), ("cut of--  ……", "cut of"), ("施工【未完】", "施工"), ("施工（略）", "施工"), ("...", None), ("", None),
    ]:
        assert _bare(value) == ((value, False) if want is None else (want, True)), value


def test_long_runs_of_marks_end_soon():
    """A text of marks alone, closed or not, costs in proportion to its length."""
    from cairn.llm.truncation import _bare

    for unit in (".", "—", "-", "<", "[a", "[---", "&a", "。… "):
        for end in ("", "x"):
            start = time.process_time()
            _bare("ab" + unit * 50_000 + end)
            assert time.process_time() - start < 5, (unit, end)
