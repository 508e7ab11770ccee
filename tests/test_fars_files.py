"""The yearly stand-in files are written from many ranges: one file a year, in key order."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from roadstats.sources import raw_files as rf


def test_a_year_is_sorted_by_many_tasks_and_joined_in_order(spark, tmp_path):
    rows = spark.range(400).select(
        (1995 + F.col("id") % 2).cast("int").alias("_year"), ((F.col("id") * 7919) % 400).alias("_k"))
    rows = rows.select("*", rf._csv_line(["_k", "_year"]).alias("value"))
    root, stage = f"{tmp_path}/root", f"{tmp_path}/stage"
    written = []
    real = rf._reset
    try:  # the staged ranges, before they go
        rf._reset = lambda s, p: (written.extend(Path(stage).rglob("part-*.txt")), real(s, p))
        rf._write_per_year(spark, rows, stage, root, ["_k"], lambda y: ["K", "YEAR"], lambda y: "ACCIDENT.CSV")
    finally:
        rf._reset = real
    assert len(written) >= 2
    for year in (1995, 1996):
        files = [f.name for f in Path(f"{root}/fars_{year}").iterdir() if not f.name.startswith(".")]
        assert files == ["ACCIDENT.CSV"]
        lines = Path(f"{root}/fars_{year}/ACCIDENT.CSV").read_text().splitlines()
        assert lines[0] == "K,YEAR"
        keys = [int(x.split(",")[0]) for x in lines[1:]]
        assert keys == sorted(keys) and len(keys) == 200
        assert {x.split(",")[1] for x in lines[1:]} == {str(year)}
    assert not Path(stage).exists() and not Path(f"{stage}_joined").exists()


def test_several_ranges_of_one_year_stand_in_order(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", False)
    own.conf.set("spark.sql.shuffle.partitions", 5)
    rows = own.range(1000).select(F.lit(1999).alias("_year"), (999 - F.col("id")).alias("_k"))
    rows = rows.select("*", rf._csv_line(["_k"]).alias("value"))
    rf._write_per_year(spark, rows, f"{tmp_path}/s", f"{tmp_path}/r", ["_k"], lambda y: ["K"], lambda y: "PERSON.CSV")
    lines = Path(f"{tmp_path}/r/fars_1999/PERSON.CSV").read_text().splitlines()
    assert lines == ["K", *map(str, range(1000))]


def test_lines_are_what_the_csv_writer_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "  a ", None), (2, 'q"u,o', ""), (3, "", "-1.5")], "i int, s string, t string")
    rows.coalesce(1).write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{tmp_path}/c")
    file, = Path(f"{tmp_path}/c").glob("part-*.csv")
    assert [r[0] for r in rows.orderBy("i").select(rf._csv_line(rows.columns)).collect()] == file.read_text().splitlines()


def test_a_load_of_scanned_files_runs_in_light_tasks(spark, tmp_path):
    Path(f"{tmp_path}/fars_1999").mkdir()
    Path(f"{tmp_path}/fars_1999/ACCIDENT.CSV").write_text("ST_CASE,YEAR\n1,99\n2,99\n")
    rows = rf.scan_crash_files(spark, str(tmp_path))
    assert [r["ST_CASE"] for r in rows.orderBy("load_order").collect()] == ["1", "2"]
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        assert rows.join(spark.range(1)).sparkSession.conf.get(k) != spark.conf.get(k)
