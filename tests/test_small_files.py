"""Sinks of one small file per folder (E4, E5): written by many tasks, listed and read by few."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from roadstats.plans import export as ex
from roadstats.plans import written_queries as wq
from roadstats.session import small_files_session


def _annual(spark, cities=60):
    return spark.range(cities * 2).select(
        F.format_string("%02d", F.col("id") % 3).alias("state_fips"),
        F.format_string("%05d", F.floor(F.col("id") / 2)).alias("place_fips"),
        (2000 + F.col("id") % 2).cast("int").alias("year"), F.col("id").alias("total_fatalities"))


def _folders(rows):
    return rows.withColumn("state_fips", F.format_string("%02d", F.col("place_fips").cast("int") % 3))


def test_folders_are_written_by_many_tasks_and_read_back_whole(spark, tmp_path):
    rows = _folders(_annual(spark))
    path = ex.write_annual(rows, f"file:{tmp_path}/out")
    files = [*Path(f"{tmp_path}/out").rglob("part-*.json")]
    assert len(files) == 60                                           # a file a city
    assert len({f.name.split("-")[1] for f in files}) > 2             # merged by bytes they were one task's
    assert not [*Path(f"{tmp_path}/out").rglob("*.json.crc")]
    back = ex.read_folders(spark, path, rows.schema, ("state_fips", "place_fips"))
    assert back.columns == rows.columns
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    lines = wq.in_order(wq.written_lines(spark, path, ("state_fips", "place_fips")), ("state_fips", "place_fips"))
    got = {(r["place_fips"], r["place"]): r["value"] for r in lines.collect()}
    assert len(got) == 120 and all(f'"year":{1999 + place}' in v for (_, place), v in got.items())


def test_a_folder_without_a_value_is_null(spark, tmp_path):
    rows = spark.createDataFrame([("01", None, 2000, 1), ("01", "00002", 2001, 2)],
                                 "state_fips string, place_fips string, year int, total_fatalities int")
    path = ex.write_annual(rows, f"{tmp_path}/out")
    back = ex.read_folders(spark, path, rows.schema, ("state_fips", "place_fips"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_small_files_session_keeps_the_settings(spark):
    own = small_files_session(spark)
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        assert own.conf.get(k) == spark.conf.get(k)
    assert spark.conf.get("spark.sql.files.openCostInBytes") != own.conf.get("spark.sql.files.openCostInBytes")


def _started():
    with open("/proc/stat") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("processes"))


def test_folders_are_written_without_a_process_for_each_file(spark, tmp_path):
    rows = _folders(_annual(spark, 1500)).localCheckpoint()
    ex.write_annual(_folders(_annual(spark, 20)), f"file:{tmp_path}/first")  # Python workers are there now
    before = _started()
    path = ex.write_annual(rows, f"file:{tmp_path}/out")
    started, at = _started() - before, Path(path.removeprefix("file:"))
    assert started < 1500  # Hadoop's local files took one each, and threads that read what it says
    assert len([*at.rglob("part-*.json")]) == 1500 and (at / "_SUCCESS").exists()


def test_folders_and_lines_are_those_of_sparks_writer(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a/b", "1", 2000, 1.5, None), ("a/b", "1", 1999, 2.0, "é\n\"x"), (None, "", 2001, None, "y"), ("", None, 2000, 0.1, "z"),
         ("50%=[#]", "né ^{'", 2002, 1e30, "w"), (" ", "\\:*?\x01\x7f", 2003, -0.0, "")],
        "state_fips string, place_fips string, year int, share double, note string")
    folders = ("state_fips", "place_fips")
    ex.write_annual(rows, f"{tmp_path}/own")
    rows.write.option("ignoreNullFields", False).partitionBy(*folders).json(f"{tmp_path}/sparks/annual_fatalities")

    def lines(root):
        found = {}
        for f in Path(f"{tmp_path}/{root}").rglob("part-*.json"):
            found.setdefault(str(f.parent.relative_to(f"{tmp_path}/{root}")), []).extend(f.read_bytes().splitlines())
        return {k: sorted(v) for k, v in found.items()}
    assert lines("own") == lines("sparks") and len(lines("own")) == 4
    ex.write_annual(rows.where("year = 2002"), f"{tmp_path}/own")  # what was there is replaced
    assert len(lines("own")) == 1
