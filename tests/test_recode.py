"""Sequences under their digests: what is sorted and shuffled for them."""

from pyspark.sql import functions as F

from lumirank.operators import vocab as VO


def test_sequences_are_neither_sorted_nor_shuffled(spark):
    """A first value of each key sorted all rows of a task, and the join carried the sequence itself."""
    rows = [(i, "^".join("abcdxy"[(i * j) % 6] for j in range(1, 8)) if i % 5 else None, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "row long, seq string, other long")
    v = spark.createDataFrame([(t, n + 1) for n, t in enumerate("abcd")], "token string, idx long")
    listed = VO.recode_lists(df, "seq", v)
    fixed = VO.encode_sequence(df, "seq", v, 4, oov=5)
    assert listed.columns == fixed.columns == df.columns
    code = {t: n + 1 for n, t in enumerate("abcd")}
    want = {i: s and "^".join(str(code.get(t, 0)) for t in s.split("^")) for i, s, _ in rows}
    assert {r["row"]: r["seq"] for r in listed.collect()} == want
    assert {r["row"]: list(r["seq"]) for r in fixed.collect()} == {i: [code.get(t, 5) for t in s.split("^")][:4] if s else [0] * 4 for i, s, _ in rows}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for d in (VO.recode_lists(df, "seq", v), VO.encode_sequence(df, "seq", v, 4, oov=5)):
            plan = d._jdf.queryExecution().executedPlan().toString()
            assert "SortAggregate" not in plan
            assert not any("Exchange" in line and "seq" in line for line in plan.splitlines())
        both = VO.encode_sequence(df, "seq", v, 4, oov=5, out="codes")
        assert both.columns == [*df.columns, "codes"] and both.filter(F.col("seq").isNull()).count() == 12
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
