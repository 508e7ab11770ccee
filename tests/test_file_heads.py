"""Headers of many files in one job, and JSON arrays read by blocks."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from roadstats.operators import places as pl
from roadstats.sources import file_heads as fh
from roadstats.sources import place_files as pf
from roadstats.sources import raw_files as rf


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def jobs_of(spark, run):
    """(value, jobs that ran)"""
    sc = spark.sparkContext
    sc.setJobGroup("heads", "")
    try:
        out = run()
        return out, len(sc.statusTracker().getJobIdsForGroup("heads"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_first_records(spark, tmp_path):
    want = {}
    for i in range(300):
        body = "".join(f"{j},{j}\n" for j in range(i % 5))
        p = put(f"{tmp_path}/d {i % 3}/f{i}.csv", ("" if i % 50 == 7 else f"﻿A,B{i % 4}\n" if i % 2 else f"A,B{i % 4}\n") + body)
        if os.path.getsize(p):
            want[f"file:{p}"] = f"A,B{i % 4}" if i % 50 != 7 else "0,0"
    big = put(f"{tmp_path}/big.csv", "HEAD\n" + "x" * 99 + "\n" + ("line\n" * 400_000))
    want[f"file:{big}"] = "HEAD"
    paths = [f"file:{os.path.join(d, f)}" for d, _, fs in os.walk(tmp_path) for f in fs]
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500_000)  # the large file is in four blocks
    try:
        got, jobs = jobs_of(spark, lambda: fh.first_records(spark, paths))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
    assert jobs <= 2  # the listing of many paths, and the scan
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert fh.first_records(spark, []) == {}


def test_scan_of_many_eras(spark, tmp_path):
    head = "ST_CASE,STATE,COUNTY,CITY,FATALS,YEAR,MONTH,DAY"
    for y in range(1987, 2007):
        cols = head + (",ROUTE" if y % 2 else "") + (",latitude,longitud" if y % 3 else ",LATITUDE,LONGITUD")
        row = f"{y},6,1,1,1,{y},1,2" + (",3" if y % 2 else "") + f",3{y % 10}.5,-100.25"
        put(f"{tmp_path}/fars_{y}/ACCIDENT.CSV", f"{cols}\n{row}\n")
    put(f"{tmp_path}/fars_2007/ACCIDENT.CSV", "")
    got = {r["dataset_year"]: r for r in rf.scan_crash_files(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(1987, 2007))
    assert all(r["has_route"] == bool(y % 2) and r["ROUTE"] == ("3" if y % 2 else None) and r["LATITUDE"] == f"3{y % 10}.5" for y, r in got.items())


@pytest.mark.parametrize("block", [134217728, 1000, 7])
def test_array_files_by_blocks(spark, tmp_path, block):
    """Rows in any layout, and cells that hold brackets, commas, escapes and numbers, whatever block they fall in."""
    root = str(tmp_path)
    pop = [["NAME", "B01003_001E", "state", "place"], *[[f"City {i}, [x], Ohio", str(i), "39", f"{i:05d}"] for i in range(300)]]
    put(f"{root}/populations/39", json.dumps(pop).replace("], [", "],\n ["))
    other = [["state", "place", "NAME", "B01003_001E"], ["40", "1", 'quo\\"te, A', "5"], ["40", "2", "num", 7], ["40", "3", "none", None], ["72", "4", "x", "1"]]
    put(f"{root}/populations/40", json.dumps(other, indent=None))
    put(f"{root}/populations/41", json.dumps([["NAME", "B01003_001E", "state", "place"]]))
    put(f"{root}/populations/42", '[["NAME","B01003_001E","state","place"],["ok, B","1","42","1"],[broken "]')
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", min(block, 4194304))
    try:
        raw = pf.scan_populations(spark, root)
        got = sorted((r["state"], r["place"], r["NAME"], r["B01003_001E"]) for r in raw.where("state is not null").collect())
        blocks = raw.select("source_file", "load_order.block").distinct().count()
        out = {r["outcome"]: r["n"] for r in pl.load_populations(raw).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted([("39", f"{i:05d}", f"City {i}, [x], Ohio", str(i)) for i in range(300)]
                         + [("40", "1", 'quo\\"te, A', "5"), ("40", "2", "num", "7"), ("40", "3", "none", None), ("42", "1", "ok, B", "1"), ("72", "4", "x", "1")])
    assert out == {"inserted": 303, "error": 2}  # the population that is null, and the record that is no JSON
    assert blocks >= {134217728: 3, 1000: 10, 7: 100}[block]
