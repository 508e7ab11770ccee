"""Raw file scans and keyed loads on small hand-written files (S1–S3, N7, N8,
L1, L2, L5, L6, J1), and ring simplification (G10)."""

import os

from pyspark.sql import functions as F

from roadstats.operators import raw_load as rl
from roadstats.operators import spatial as sa
from roadstats.sources import raw_files as rf
from roadstats.streaming import incremental as inc

CODES = [("06", "0037", "Los Angeles")]


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _fixture(root):
    # era with names and lower-case coordinates; a BOM on the header
    _write(f"{root}/fars_2019/ACCIDENT.CSV",
           "﻿ST_CASE,STATE,STATENAME,COUNTY,CITY,CITYNAME,ROUTE,FATALS,YEAR,MONTH,DAY,"
           "latitude,longitud\n"
           "10001,6,California,37,37,Los Angeles,1,2,2019,5,6,34.05,-118.25\n"
           "10001,6,California,37,37,Los Angeles,1,9,2019,5,6,34.05,-118.25\n"
           "x1,6,California,37,37,Los Angeles,1,1,2019,5,6,34.05,-118.25\n"
           "10002,123,California,37,37,,2,1,2019,5,6,,\n"
           "10003,6,,37,37,,,1,2019,5,6,9999,-118.25\n")
    # older era: no names, no ROUTE, upper-case coordinates, file name lower-case
    _write(f"{root}/fars_2020/accident.csv",
           "ST_CASE,STATE,COUNTY,CITY,FATALS,YEAR,MONTH,DAY,LATITUDE,LONGITUD\n"
           "20001,6,37,37,1,20,2,30,34561234,118150000\n"
           "20002,6,37,38,3,2020,1,1,34.1,-118.2\n")
    _write(f"{root}/fars_2019/PERSON.CSV",
           "ST_CASE,VEH_NO,PER_NO,AGE,SEX,PER_TYP,INJ_SEV,LOCATION\n"
           "10001,1,1,30,1,1,4,0\n"
           "10001,1,1,31,1,2,4,0\n"
           "10001,1,2,,1,5,4,0\n"
           "99999,1,1,40,2,5,4,0\n")


def _load(spark, root):
    typed = rl.normalize_crashes(spark, rf.scan_crash_files(spark, root),
                                 spark.createDataFrame(CODES, "state_code string, fars_city_code "
                                                              "string, fars_city_name string"))
    return rl.load_crashes(typed)


def test_crash_files_eras_outcomes(spark, tmp_path):
    root = str(tmp_path / "raw")
    _fixture(root)
    out = _load(spark, root)
    got = {(r["year"], r["st_case"], r["outcome"], r["reject_reason"]): r for r in out.collect()}
    outcomes = sorted((k[0], k[2], k[3]) for k in got)
    assert outcomes == sorted([
        (2019, "inserted", None), (2019, "skipped_duplicate", None), (2019, "error", "bad_st_case"),
        (2019, "error", "state_too_long"), (2019, "error", "bad_route"),
        (2020, "inserted", None), (2020, "inserted", None)])
    first = got[(2019, 10001, "inserted", None)]
    assert first["total_fatalities"] == 2            # first row in file order wins
    assert first["fars_city_name"] == "Los Angeles" and first["state_name"] == "California"
    assert (first["lon"], first["lat"]) == (-118.25, 34.05)
    old = got[(2020, 20002, "inserted", None)]
    assert old["route_code"] == 9 and old["road_label"] == "Unknown"   # ROUTE column absent
    assert old["state_name"] == "California"                           # from the FIPS table
    assert old["fars_city_name"] == "ERROR"                            # code 0038 not in table
    two_digit = got[(2020, 20001, "inserted", None)]
    assert two_digit["crash_date"] is None                             # 1920-02-30
    assert two_digit["coord_status"] == "ok_dms" and two_digit["lon"] > 0


def test_dataset_presence(spark, tmp_path):
    root = str(tmp_path / "raw")
    _fixture(root)
    pres = {r["year"]: r for r in rf.dataset_presence(rf.dataset_files(spark, root)).collect()}
    assert pres[2019]["loads_persons"] and not pres[2020]["loads_persons"]
    assert pres[2020]["loads_crashes"]


def test_person_load_orphans_and_duplicates(spark, tmp_path):
    root = str(tmp_path / "raw")
    _fixture(root)
    crashes = rl.inserted(_load(spark, root), rl.CRASH_KEY)
    persons = rl.load_persons(rl.normalize_persons(rf.scan_person_files(spark, root)), crashes)
    got = sorted((r["st_case"], r["person_number"], r["person_age"], r["outcome"])
                 for r in persons.collect())
    assert got == [(10001, 1, 30, "inserted"), (10001, 1, 31, "skipped_duplicate"),
                   (10001, 2, None, "error"), (99999, 1, 40, "skipped_orphan")]


def test_incremental_load_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "raw")
    _fixture(root)
    table = str(tmp_path / "crashes")
    codes = spark.createDataFrame(CODES, "state_code string, fars_city_code string, "
                                         "fars_city_name string")
    first = inc.load_new_files(spark, root, table, codes)
    assert first == {"new_files": 2, "rows_added": 3}
    again = inc.load_new_files(spark, root, table, codes)
    assert again == {"new_files": 0, "rows_added": 0}
    _write(f"{root}/fars_2021/ACCIDENT.CSV",
           "ST_CASE,STATE,COUNTY,CITY,FATALS,YEAR,MONTH,DAY,LATITUDE,LONGITUD\n"
           "30001,6,37,37,1,2021,3,3,,\n")
    third = inc.load_new_files(spark, root, table, codes)
    assert third == {"new_files": 1, "rows_added": 1}
    assert spark.read.parquet(table).count() == 4


def test_ring_simplification(spark):
    # unit square with collinear points on every edge, plus a second ring
    # with a notch deeper than the tolerance
    sq = [(0, 0), (0.5, 0), (1, 0), (1, 0.5), (1, 1), (0.5, 1), (0, 1), (0, 0.5)]
    notch = [(0, 0), (1, 0), (1, 1), (0.5, 0.6), (0, 1)]
    rows = [("01", "00001", 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(sq)]
    rows += [("01", "00002", 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(notch)]
    v = spark.createDataFrame(rows, "state_fips string, place_fips string, part int, ring int, "
                                    "seq int, x double, y double")
    out = sa.simplify_rings(v, tolerance=0.01)
    got = {r["place_fips"]: r["n"] for r in
           out.groupBy("place_fips").agg(F.count("*").alias("n")).collect()}
    assert got == {"00001": 4, "00002": 5}


def test_hot_duplicate_key_keeps_first_row(spark, tmp_path):
    root = str(tmp_path / "raw")
    rows = ["ST_CASE,STATE,COUNTY,CITY,FATALS,YEAR,MONTH,DAY,LATITUDE,LONGITUD"]
    for i in range(900):
        # every third row repeats crash 1; its FATALS records the file position
        key = 1 if i % 3 == 0 else 1000 + i
        rows.append(f"{key},6,37,37,{i},2019,1,1,,")
    _write(f"{root}/fars_2019/ACCIDENT.CSV", "\n".join(rows) + "\n")
    out = _load(spark, root)
    counts = {r["outcome"]: r["n"] for r in
              out.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert counts == {"inserted": 601, "skipped_duplicate": 299}
    first = out.filter((F.col("st_case") == 1) & (F.col("outcome") == "inserted")).collect()
    assert len(first) == 1 and first[0]["total_fatalities"] == 0


def test_loaded_keys_equal_inserted_keys(spark, tmp_path):
    root = str(tmp_path / "raw")
    _fixture(root)
    typed = rl.normalize_crashes(spark, rf.scan_crash_files(spark, root),
                                 spark.createDataFrame(CODES, "state_code string, fars_city_code "
                                                              "string, fars_city_name string"))
    a = sorted(tuple(r) for r in rl.loaded_keys(typed).collect())
    b = sorted(tuple(r) for r in rl.inserted(rl.load_crashes(typed), rl.CRASH_KEY).collect())
    assert a == b
