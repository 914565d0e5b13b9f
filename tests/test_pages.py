import pytest
from pyspark.sql import functions as F

from cairn.operators import pipeline as P
from cairn.operators import tables as B
from cairn.sources import files as S

CHUNK = "document_id string, group_id string, page_idx bigint, chunk_id string, stage string, text string, content string, markdown string, n_rows bigint, bbox array<int>, other string"
MD = "| a | b |\n|---|---|\n| 1 | 2 |"


def test_tables_over_pages(spark):
    rows = [
        ("d", "g", 0, "c0", "桩基", "【桩基】\n第1页表格\nx", "## 【桩基 - 第1页】\n\nx", MD + "\n|---|---|", 2, [5, 1, 9, 3]),
        ("d", "g", 1, "c1", "桩基", "【桩基】\n第2页表格\ny", "## h\ny", MD, 1, [2, 2, 7, 9]),
        ("d", "g", 1, "c2", "桩基", "again", "again", None, None, None),
        ("d", "g", 3, "c3", "", None, "", "", 1, [0, 0, 1, 1]),
        ("d", "", 4, "c4", None, "p", "p", "m", 1, None),
        ("d", "", 5, "c5", None, "q", "q", "m", 1, None),
        ("e", "g", 2, "c6", None, "r", "r", None, 1, [1, 1, 2, 2]),
        ("e", "g", 3, "c7", None, "s", "s", None, 1, None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], CHUNK)
    got = {r.chunk_id: r for r in B.merged_pages(df).collect()}
    assert set(got) == {"c0", "c2", "c3", "c4", "c5", "c6"}
    a = got["c0"]
    assert a.text == "【桩基】\n第1-2页表格（跨页合并）\nx\ny"
    assert a.content == "## 【桩基 - 第1-2页】（跨页合并）\n\n\nx\n\ny"
    assert a.markdown == MD + "\n\n" + MD and a.n_rows == 3 and a.pages == [0, 1] and a.bbox == [2, 1, 9, 9]
    assert got["c2"].text == "again" and got["c2"].n_pages == 1 and got["c4"].text == "p"
    assert got["c6"].text == "第3-4页表格（跨页合并）\nr\ns" and got["c6"].bbox == [1, 1, 2, 2] and got["c6"].markdown is None
    assert B.merged_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "md, want",
    [
        (None, True), ("", True), ("| a | b |", True), (MD, False), ("| a | b |\n|  |  |", True), ("| a | 特征描述 |\n| 1 |  |", True),
        ("| a | 特征描述 |\n| 1 | pipe |", False), ("| a | b | c |\n| a | b | c |\n| 合计 | 3 | 4 |", True), ("| a | b |\n| - | —. |", True), ("| a | b |\n| Col 7 | 金额 |", True),
    ],
)
def test_placeholders(spark, md, want):
    df = spark.createDataFrame([(md,)], "md string")
    assert df.select(B.is_placeholder(B.cells(F.col("md")))).first()[0] is want


def test_texts_around_a_table(spark):
    page = "far\nnear, 注\n" + MD + "\nbelow\n\n说明 below"
    df = spark.createDataFrame([("p", page), ("none", "no table"), ("null", None), ("only", MD)], "key string, content string")
    assert {r.key: r.description for r in B.nearby_texts(df, "key", least=1).collect()} == {"p": "near, 注\nfar\n说明 below\nbelow"}
    assert B.nearby_texts(df, "key").count() == 0
    assert [r.description for r in B.nearby_texts(df, "key", most=9, least=1).collect()] == ["near, 注\nbelow"]


def test_fields_and_conditions(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 5)], "id int, s string, n int")
    assert [tuple(r) for r in P.projected(df, {"s": "", "gone": None, "n": 0}).collect()] == [("a", None, 0), ("", None, 5)]
    ids = lambda where: [r.id for r in P.matching(df, where).collect()]
    assert ids({}) == [1, 2] and ids({"s": None}) == [2] and ids({"s": {"$ne": None}}) == [1] and ids({"n": {"$gt": 4, "$lte": 5}}) == [2] and ids({"s": {"$in": ["a"]}}) == [1]
    with pytest.raises(ValueError):
        P.matching(df, {"s": {"$like": "a"}})


def test_encodings_round_trip(spark):
    rows = [("a", "水箱 tank", "gbk"), ("b", "caféÿ", "latin-1"), ("c", "𝄞", "gbk"), ("d", "x", "no such"), ("e", None, "gbk"), ("f", "", None)]
    df = spark.createDataFrame(rows, "path string, text string, encoding string")
    assert {r.path: r.text for r in S.texts(S.encoded(df)).collect()} == {p: t for p, t, _ in rows}


def test_csv_with_a_mark(spark, tmp_path):
    rows = [(1, 'say "hi",\nthen go'), (2, None), (3, "，")]
    S.write_csv(spark.createDataFrame(rows, "id int, t string"), str(tmp_path / "x"), bom=True)
    assert sorted(tuple(r) for r in S.read_csv(spark, str(tmp_path / "x"), "id int, t string").collect()) == rows
