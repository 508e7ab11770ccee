from pyspark.sql import functions as F

from roadstats.functions.exprs import ratio_half_up, zfill
from roadstats.operators.loads import first_wins


def test_zfill_pads_without_truncating(spark):
    df = spark.createDataFrame([("1",), ("7",), ("12345",), ("0037",)], "v string")
    got = [r[0] for r in df.select(zfill("v", 4)).collect()]
    assert got == ["0001", "0007", "12345", "0037"]


def test_ratio_half_up_is_exact(spark):
    rows = [(1, 8), (-1, 8), (5, 2), (-5, 2), (2, 3), (1, 3), (100125, 1000)]
    df = spark.createDataFrame(rows, "n long, d long")
    got = [r[0] for r in df.select(ratio_half_up("n", "d", 2)).collect()]
    assert got == [0.13, -0.13, 2.5, -2.5, 0.67, 0.33, 100.13]


def test_first_wins_with_hot_key(spark):
    rows = [(1 if i < 400 else i, 1000 - i, f"p{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "k int, ord int, payload string").repartition(8)
    out = {r["k"]: (r["ord"], r["payload"]) for r in first_wins(df, ["k"], ["ord"]).collect()}
    assert out[1] == (601, "p399")
    assert len(out) == 801
