"""Literal edge rows for the normalisation rules (FIXTURES.md §C)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadstats.functions import normalize as nz
from roadstats.operators import places as pl
from roadstats.sources.raw_files import resolve_years


def _coords(spark, rows):
    df = spark.createDataFrame(rows, "lat string, lon string")
    lon, lat, status = nz.coordinates("lat", "lon")
    return [(r["lon"], r["lat"], r["s"]) for r in
            df.select(lon.alias("lon"), lat.alias("lat"), status.alias("s")).collect()]


def test_coordinates_decimal_and_dms(spark):
    got = _coords(spark, [("33.9", "-117.1"), ("33561234", "117093000"),
                          ("33561234", "-117093000"), ("33.9", "-117"),
                          ("  33.9 ", "-117.1")])
    assert got[0] == (-117.1, 33.9, "ok_decimal")
    assert got[1][2] == "ok_dms"
    assert got[1][1] == pytest.approx(33.93676111111111, abs=1e-12)
    assert got[1][0] == pytest.approx(117.15833333333335, abs=1e-12)
    assert got[2][:2] == got[1][:2]          # the sign of a packed value is dropped
    assert got[3] == (-117.0, 33.9, "ok_decimal")   # one axis with "." -> both decimal
    assert got[4] == (-117.1, 33.9, "ok_decimal")


def test_coordinates_rejected(spark):
    rows = [("0", "-117.1"), ("33.9", "9999"), ("", "-117.1"), (None, "-117.1"),
            ("99999999", "117093000"), ("33.9", "777.7777"), ("abc.d", "-117.1"),
            ("nan", "1.5"), ("1.5d", "2.5")]
    got = _coords(spark, rows)
    assert all(lon is None and lat is None for lon, lat, _ in got)
    assert [s for *_, s in got] == ["sentinel", "sentinel", "blank", "blank", "out_of_range",
                                    "out_of_range", "unparsable", "out_of_range", "unparsable"]


def test_coordinates_known_hole(spark):
    (lon, lat, status), = _coords(spark, [("77777777", "117093000")])
    assert status == "ok_dms" and lat == pytest.approx(78.3049361111111, abs=1e-9)


def test_west_positive_option(spark):
    df = spark.createDataFrame([("33561234", "117093000")], "lat string, lon string")
    lon, lat, _ = nz.coordinates("lat", "lon", west_positive=True)
    assert df.select(lon.alias("x")).first()["x"] == pytest.approx(-117.15833333333335)


def test_dates(spark):
    rows = [("2020", "2", "30"), ("1995", "99", "1"), ("1995", "1", "0"), ("87", "5", "6"),
            ("5", "5", "6"), ("x", "1", "1"), (None, "1", "1"), (" 1999 ", "12", "31")]
    df = spark.createDataFrame(rows, "y string, m string, d string")
    got = [r["v"] for r in df.select(nz.crash_date("y", "m", "d").alias("v")).collect()]
    assert got == [None, None, None, dt.date(1987, 5, 6), dt.date(5, 5, 6), None, None,
                   dt.date(1999, 12, 31)]


def test_route_code_and_padding(spark):
    df = spark.createDataFrame([("1", "7", "12345", "1"), ("", "", "0", None), ("95", "12", "37", "x")],
                               "state string, county string, city string, route string")
    got = df.select(nz.padded_code("state", 2).alias("s"), nz.padded_code("county", 3).alias("c"),
                    nz.padded_code("city", 4).alias("t"),
                    nz.route_code("route", F.lit(True)).alias("r"),
                    nz.route_code("route", F.lit(False)).alias("r_absent")).collect()
    assert (got[0]["s"], got[0]["c"], got[0]["t"]) == ("01", "007", "12345")
    assert (got[1]["s"], got[1]["t"]) == ("00", "0000")
    assert [r["r"] for r in got] == [1, None, None]
    assert [r["r_absent"] for r in got] == [9, 9, 9]


def test_city_names(spark):
    rows = [("0000", "Springfield", True, None), ("9999", None, False, "X"),
            ("0037", "Not Applicable", True, "X"), ("0037", None, False, "Table Name"),
            ("0038", None, False, None), ("0037", None, True, "X")]
    df = spark.createDataFrame(rows, "code string, name string, has boolean, lookup string")
    got = [r["v"] for r in df.select(nz.city_name(F.col("code"), "name", F.col("has"),
                                                  F.col("lookup")).alias("v")).collect()]
    assert got == ["Unincorporated", "Unincorporated", "Unincorporated", "Table Name",
                   "ERROR", ""]


def test_population_names(spark):
    rows = [("Juneau city and borough, Alaska", "1", "02", "36450"),
            ("Athens-Clarke County unified government (balance), Georgia", "2", "13", "03440"),
            ("San Juan zona urbana, Puerto Rico", "3", "72", "76770"),
            ("Boise City city, Idaho", "4", "16", "08830")]
    raw = spark.createDataFrame(rows, "NAME string, B01003_001E string, state string, place string") \
        .withColumn("load_order", F.monotonically_increasing_id())
    got = {r["place_fips"]: (r["place_name"], r["state_name"])
           for r in pl.normalize_populations(raw).collect()}
    assert got["36450"] == ("Juneau", "Alaska")
    assert got["03440"] == ("Athens-Clarke County unified government (balance)", "Georgia")
    assert "76770" not in got
    assert got["08830"] == ("Boise City", "Idaho")


def test_pledge_canonicalisation(spark):
    rows = [("Washington DC", "Anywhere"), ("Macon", "Georgia"), ("Ft. Lauderdale", "Florida"),
            ("Springfield", "Atlantis")]
    df = spark.createDataFrame(rows, "city_name string, state_name string")
    got = [(r["city_name"], r["state_fips"]) for r in pl.canonical_pledges(spark, df).collect()]
    assert sorted(got) == sorted([("Washington", "11"), ("Macon-Bibb County", "13"),
                                  ("Fort Lauderdale", "12"), ("Springfield", "ERROR")])


def test_city_point_resolution(spark):
    rows = [("01", "00001", "Urban Honolulu", "HI", "", "", "failed"),
            ("01", "00002", "Nowhere", "HI", "", "", "failed"),
            ("01", "00003", "Somewhere", "HI", "", "21.3", "ok"),
            ("01", "00004", "Elsewhere", "HI", "-100.5", "40.25", "ok")]
    df = spark.createDataFrame(rows, "state_fips string, place_fips string, place_name string, "
                                     "state_name string, lon string, lat string, status string")
    got = {r["place_fips"]: (r["point_lon"], r["point_lat"], r["point_source"])
           for r in pl.resolve_points(spark, df).collect()}
    assert got["00001"] == (-157.8592, 21.30899, "override")
    assert "00002" not in got and "00003" not in got
    assert got["00004"] == (-100.5, 40.25, "geocoded")


def test_year_selection():
    assert resolve_years([2020, 2018, 2019, 2018]) == [2018, 2019, 2020]
    assert resolve_years(None, 2020, 2022) == [2020, 2021, 2022]
    with pytest.raises(ValueError):
        resolve_years([1980])
    with pytest.raises(ValueError):
        resolve_years(None, 2020, 2019)


def test_boundary_display_names_and_first_feature(spark):
    rows = [("15", "71550", "Urban Honolulu", "57", ("f1", 0), 0, 0, 0, 0.0, 0.0),
            ("15", "71550", "Urban Honolulu", "99", ("f2", 0), 0, 0, 0, 0.0, 0.0),
            ("06", "44000", "Los Angeles", "25", ("f1", 1), 0, 0, 0, 0.0, 0.0)]
    v = spark.createDataFrame(rows, "state_fips string, place_fips string, place_name string, "
                                    "place_type string, load_order struct<file:string,row:int>, "
                                    "part int, ring int, seq int, x double, y double")
    got = {r["place_fips"]: (r["display_name"], r["state_name"], r["place_type"])
           for r in pl.load_boundaries(spark, v).collect()}
    assert got == {"71550": ("Honolulu", "Hawaii", "57"),
                   "44000": ("Los Angeles", "California", "25")}
