"""Trees of small files in a local folder: listed and read by tasks, so that Spark's driver holds none of them."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roadstats.plans import export as ex
from roadstats.plans import written_queries as wq
from roadstats.sources import folder_files as ff

FOLDERS = ("state_fips", "place_fips")


def _points(spark, cities=50):
    """Two points a city and year, two years a city."""
    i = F.col("id")
    return spark.range(cities * 4).select(
        F.format_string("%02d", F.floor(i / 4) % 3).alias("state_fips"), F.format_string("%05d", F.floor(i / 4)).alias("place_fips"),
        i.alias("st_case"), (2001 + i % 2).cast("int").alias("year"), F.expr("date_add(date'2001-02-03', int(id))").alias("crash_date"),
        F.when(i % 5 > 0, i / 7).alias("lon"))


def _tree(root: Path, files: dict[str, bytes]) -> str:
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text)
    return str(root)


def test_crash_files_are_read_back_without_a_list_of_them_on_the_driver(spark, tmp_path):
    rows = _points(spark)
    path = ex.write_crash_points(rows, f"file:{tmp_path}/out")
    assert len([*Path(f"{tmp_path}/out").rglob("part-*.json")]) >= 100
    back = ex.read_folders(spark, path, rows.schema, FOLDERS)
    assert back.inputFiles() == []  # Spark's sources keep every file there
    assert back.dtypes == rows.dtypes
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_what_is_read_is_what_sparks_reader_reads(spark, tmp_path):
    rows = spark.createDataFrame(
        [("01", "1", 2000, 1.5, None), ("01", "1", 1999, 2.0, "é\n\"x\r "), (None, "2", 2001, None, " "), ("02", None, None, 0.1, ""),
         ("03", "3", 2002, 1e300, "\t{}")], "state_fips string, place_fips string, year int, share double, note string")
    path = ex.write_annual(rows, f"{tmp_path}/out")
    _tree(tmp_path / "out/annual_fatalities", {
        "state_fips=04/place_fips=4/part-00000.json": b'{"year":2003,"share":1}\n\n{"year":"x","note":7}\nno json\n{"year":2004',
        "state_fips=04/place_fips=4/part-00001.json": b"", "state_fips=04/place_fips=4/_part.json": b'{"year":1}\n',
        "state_fips=04/place_fips=4/.part.json": b'{"year":1}\n', "state_fips=04/_temporary/part-0.json": b'{"year":1}\n'})
    back = ex.read_folders(spark, path, rows.schema, FOLDERS)
    body = "year int, share double, note string"
    theirs = spark.read.option("recursiveFileLookup", "true").schema(body).json(path).select(
        *[ex.folder_value(F.col("_metadata.file_path"), f).alias(f) for f in FOLDERS], "*")
    assert sorted(map(str, back.collect())) == sorted(map(str, theirs.collect()))
    assert back.count() == 9


def test_names_of_files_are_those_that_spark_gives(spark, tmp_path):
    root = _tree(tmp_path / "a b", {f"{d}/part-{i}.json": b'{"year":1}\n' for i, d in enumerate(
        ("s=50%25=%5B%23%5D", "s=né ^{'", "s= /t=%5C%3A", "s=a+b&c;d,e@f$g!h(i)*~-.", "s=1", "s=\"<>|`"))})
    ours = {r["file"] for r in ff.file_texts(spark, root).collect()}
    theirs = spark.read.option("recursiveFileLookup", "true").text(root).select(F.col("_metadata.file_path")).collect()
    assert len(ours) == 6 and ours == {r[0].replace("file:///", "file:/") for r in theirs}


def test_reading_starts_no_job_and_is_dealt_to_many_tasks(spark, tmp_path):
    rows = _points(spark, 200).drop("crash_date")
    path = ex.write_annual(rows, f"file:{tmp_path}/out")
    sc = spark.sparkContext
    sc.setJobGroup("read_folders", "read_folders")
    try:
        back = ex.read_folders(spark, path, rows.schema, FOLDERS)
        assert not sc.statusTracker().getJobIdsForGroup("read_folders")  # as Spark's listing of all folders
    finally:
        sc.setJobGroup("other", "other")
    tasks = back.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 2 and sum(r["count"] for r in tasks) == 800


@pytest.mark.parametrize("where", ["root", "one/two/three/four"])
def test_long_files_come_in_pieces_of_whole_lines(spark, tmp_path, monkeypatch, where):
    lines = [f'{{"year":{i},"note":"{"x" * (i % 300)}"}}' for i in range(20_000)]
    _tree(tmp_path / "out", {f"{where}/part-0.json": "\n".join(lines).encode() + b"\n", f"{where}/part-1.json": b"last", "part-2.json": b"top\n"})
    texts = ff.file_texts(spark, f"{tmp_path}/out")
    assert texts.where("file like '%part-0.json'").count() > 1
    assert texts.agg(F.max(F.length("text"))).first()[0] < 2 * ff.PIECE_BYTES
    monkeypatch.setattr(wq, "small_files_session", None)  # Spark's sources would list and open each file
    got = {r["place"]: r["value"] for r in wq.in_order(wq.written_lines(spark, f"file:{tmp_path}/out")).collect()}
    assert [got[i + 1] for i in range(len(got))] in ([*lines, "last", "top"], ["top", *lines, "last"])


def test_sizes_are_those_of_the_files_and_no_file_is_listed_on_the_driver(spark, tmp_path, monkeypatch):
    rows = _points(spark).drop("crash_date")
    ex.write_annual(rows, f"file:{tmp_path}/out")
    ex.write_crashes_metadata(rows, f"file:{tmp_path}/out")
    monkeypatch.setattr(ex, "small_files_session", None)  # Spark's sources would list each file
    got = {r["sink"]: (r["files"], r["bytes"]) for r in ex.export_sizes(spark, f"file:{tmp_path}/out").collect()}
    want = {}
    for sink in ("annual_fatalities", "crashes_metadata"):
        sizes = [f.stat().st_size for f in Path(f"{tmp_path}/out/{sink}").rglob("part-*.json")]
        want[sink] = (len(sizes), sum(sizes))
    assert got == want and want["annual_fatalities"][0] == 50


def test_a_folder_is_made_once_and_with_what_lies_above_it(tmp_path, monkeypatch):
    looks = []
    monkeypatch.setattr(os.path, "exists", lambda p, real=os.path.exists: looks.append(p) or real(p))
    ex._make_folder(f"{tmp_path}/a/b")
    before = len(looks)
    for name in ("c", "c", "d"):
        ex._make_folder(f"{tmp_path}/a/{name}")
    assert len(looks) == before and sorted(os.listdir(f"{tmp_path}/a")) == ["b", "c", "d"]
