"""Literal edge rows for the distributed rank (FIXTURES §C, W1–W3) and
partition-count invariance."""

from pyspark.sql import functions as F

from roadstats.operators.ranking import global_rank, percent_from_rank


def _rank(spark, rows, tiebreak, parts=4):
    df = spark.createDataFrame(rows, "id int, metric double, population int").repartition(parts)
    keyed = df.select(
        "id", "metric", F.lit("g").alias("grp"),
        F.col("metric").isNull().alias("k_null"),
        F.coalesce("metric", F.lit(0.0)).alias("k_val"),
        ((-F.col("population")).cast("double") if tiebreak else F.lit(0.0)).alias("k_tb"))
    r = global_rank(keyed, "grp", ["k_null", "k_val", "k_tb"])
    return {x["id"]: (x["rank"], x["pct"], x["metric"]) for x in
            r.withColumn("pct", percent_from_rank()).collect()}


def test_rank_with_population_tiebreak(spark):
    rows = [(1, 1.0, 200), (2, 1.0, 100), (3, 2.0, 50), (4, None, 10)]
    got = _rank(spark, rows, tiebreak=True)
    ranks = {k: (v[0] if v[2] is not None else None) for k, v in got.items()}
    assert ranks == {1: 1, 2: 2, 3: 3, 4: None}


def test_percent_rank_counts_nulls(spark):
    rows = [(1, 1.0, 1), (2, 2.0, 1), (3, 2.0, 1), (4, None, 1)]
    got = _rank(spark, rows, tiebreak=False)
    pct = {k: (v[1] if v[2] is not None else None) for k, v in got.items()}
    assert pct == {1: 0.0, 2: 33.33, 3: 33.33, 4: None}
    # pledged-scope ranks have no null guard: the null metric keeps rank 4
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 2, 3: 2, 4: 4}


def test_rank_partition_invariance(spark):
    rows = [(i, float((i * 7919) % 13) if i % 11 else None, (i * 31) % 97) for i in range(500)]
    base = _rank(spark, rows, tiebreak=True, parts=1)
    for parts in (8, 200):
        assert _rank(spark, rows, tiebreak=True, parts=parts) == base


def test_hot_key_rank(spark):
    # one metric value holds a third of the rows
    rows = [(i, 0.0 if i % 3 == 0 else float(i), 1) for i in range(300)]
    got = _rank(spark, rows, tiebreak=False, parts=8)
    zeros = {v[0] for k, v in got.items() if k % 3 == 0}
    assert zeros == {1}
    assert got[1][0] == 101  # 100 zeros precede the smallest non-zero value


def test_sort_positions_by_name(spark):
    from roadstats.operators import serving
    rows = [("01", "1", "Abc"), ("01", "2", "Ab"), ("01", "3", None), ("01", "4", "b"), ("01", "5", "Ab")]
    df = spark.createDataFrame(rows, "state_fips string, place_fips string, place_name string")

    def order(ascending):
        got = serving.sort_positions(df, "city", ascending=ascending).collect()
        return [r["place_fips"] for r in sorted(got, key=lambda r: r["position"])]
    assert order(True) == ["2", "5", "1", "4", "3"] and order(False) == ["4", "1", "2", "5", "3"]
