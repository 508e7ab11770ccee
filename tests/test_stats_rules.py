"""Literal rows for trend (A7), zero fill (A8) and hot cells."""

from roadstats.operators import city_stats as cs
from roadstats.operators import hotspots as hs

CRASH_COLS = ("st_case long, year int, state string, place_fips string, total_fatalities int, "
              "pedestrian_fatalities int, cyclist_fatalities int, motorist_fatalities int, "
              "other_fatalities int")


def _crash(i, year, place, fatal):
    return (i, year, "06", place, fatal, 0, 0, fatal, 0)


def test_trend_and_zero_fill(spark):
    rows = [_crash(0, y, "00009", 1) for y in range(2010, 2020)]          # defines 10 years
    rows += [_crash(100 + y, y, "0000A", 2) for y in range(2015, 2020)]   # recent only
    rows += [_crash(200 + y, y, "0000B", 3) for y in range(2010, 2015)]   # previous only
    rows += [_crash(300 + y, y, "0000C", 1 if y < 2015 else 2) for y in range(2010, 2020)]
    crashes = spark.createDataFrame(rows, CRASH_COLS)
    places = spark.createDataFrame(
        [("06", p, 200000, False) for p in ("00009", "0000A", "0000B", "0000C")]
        + [("06", "0000D", 500, True)],
        "state_fips string, place_fips string, population int, is_pledged boolean")
    got = {r["place_fips"]: r for r in cs.city_stats(crashes, places).collect()}
    assert got["00009"]["trend_pct_change"] == 0.0
    assert got["0000A"]["trend_pct_change"] is None       # previous window has no rows
    b = got["0000B"]                                        # only previous years
    assert b["avg_per_100k_5yr"] == 0.0 and b["avg_fatalities_5yr"] == 0.0   # A8 zero fill
    assert b["trend_pct_change"] is None                    # not -100 (Q13)
    c = got["0000C"]
    assert c["avg_fatalities_5yr"] == 2.0 and c["avg_per_100k_5yr"] == 1.0
    assert c["trend_pct_change"] == 100.0
    d = got["0000D"]                                        # eligible, no crashes
    assert d["avg_per_100k_5yr"] == 0.0 and d["trend_pct_change"] is None


def test_one_hot_cell(spark):
    counts = spark.createDataFrame(
        [("06", "00001", 0, i, n) for i, n in enumerate([1, 1, 1, 5])],
        "state_fips string, place_fips string, cx long, cy long, crash_count long")
    got = sorted((r["cy"], r["is_hot"]) for r in hs.rank_cells(counts).collect())
    assert got == [(0, False), (1, False), (2, False), (3, True)]
