from cairn.llm import truncation as T


def test_all_endings_count(spark):
    """The ratio joins the shares by every number of symbols from 1 to 7."""
    values = ["the pump feeds the valve", "the pump feeds the valve and the gate", "a valve", "one valve leaks", "a big valve here", "olive", "solve it"]
    marked = ["\x01" + v for v in values]

    def ratio(v):
        r = 0.05
        for k in range(1, 8):
            s = v[-k:]
            if len(v) >= k:
                total = sum(w[i : i + k] == s for w in marked for i in range(len(w)))
                r = (sum(w.endswith(s) for w in marked) - 1 + T.WEIGHT * r) / (total - 1 + T.WEIGHT)
        return r

    df = spark.createDataFrame([(0, v) for v in values], "kind int, value string")
    got = {r.value: round(r.ratio, 9) for r in T.endings_of(df).collect()}
    assert got == {v: round(ratio(m), 9) for v, m in zip(values, marked)}
