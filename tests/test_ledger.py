"""Keyed loads in one aggregate, batches committed exactly once, and rewrites of changed years only."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from roadstats.operators import loads as ld
from roadstats.operators import quality as qa
from roadstats.operators import raw_load as rl
from roadstats.plans import jobs
from roadstats.sources import raw_files as rf
from roadstats.streaming import commits
from roadstats.streaming import incremental as inc
from tests.test_raw_load import CODES, _fixture, _write

HEAD = "ST_CASE,STATE,COUNTY,CITY,FATALS,YEAR,MONTH,DAY,LATITUDE,LONGITUD\n"
CODE_SCHEMA = "state_code string, fars_city_code string, fars_city_name string"


def test_ledger_equals_row_outcomes(spark):
    r = random.Random(1)
    rows = [(1 if i % 3 == 0 else r.randint(2, 400), r.choice([2000, 2001]), i, r.choice(["a", "b", None]), r.random() < .9) for i in range(3000)]
    batch = spark.createDataFrame(rows, "k int, year int, row int, text string, ok boolean").repartition(7)
    target = spark.createDataFrame([(k, 2000) for k in range(1, 200)], "k long, year int")
    for t in (None, target):
        one = ld.keyed_ledger(batch, t, ["k", "year"], ["row"], F.col("ok"))
        each = ld.load_outcomes(batch, t, ["k", "year"], ["row"], F.col("ok"))
        assert one.columns == [*batch.columns, "outcome", "n_rows"]
        count = lambda df, n: {tuple(x) for x in df.groupBy("year", "outcome").agg(n.alias("n")).collect()}
        assert count(one, F.sum("n_rows")) == count(each, F.count("*"))
        for outcome in ("inserted", "error"):
            assert sorted(map(tuple, one.where(F.col("outcome") == outcome).drop("n_rows").collect()), key=str) == \
                sorted(map(tuple, each.where(F.col("outcome") == outcome).select(*one.drop("n_rows").columns).collect()), key=str)
    empty = batch.where("false")
    assert ld.keyed_ledger(empty, target, ["k", "year"], ["row"], F.col("ok")).collect() == []


def test_person_ledger_outcomes(spark, tmp_path):
    _fixture(str(tmp_path))
    crashes = rl.crash_ledger(rl.normalize_crashes(spark, rf.scan_crash_files(spark, str(tmp_path)), spark.createDataFrame(CODES, CODE_SCHEMA)))
    persons = rl.person_ledger(rl.normalize_persons(rf.scan_person_files(spark, str(tmp_path))), rl.inserted(crashes, rl.CRASH_KEY))
    assert sorted((r["st_case"], r["person_number"], r["outcome"], r["n_rows"]) for r in persons.collect()) == [
        (10001, 1, "inserted", 1), (10001, 1, "skipped_duplicate", 1), (10001, 2, "error", 1), (99999, 1, "skipped_orphan", 1)]


def test_batch_is_parsed_and_shuffled_once(spark, tmp_path):
    _write(f"{tmp_path}/fars_2019/ACCIDENT.CSV", HEAD + "1,6,37,37,1,2019,1,1,,\n")
    typed = rl.normalize_crashes(spark, rf.scan_crash_files(spark, str(tmp_path)), spark.createDataFrame(CODES, CODE_SCHEMA))
    target = spark.range(5).select(F.col("id").cast("int").alias("st_case"), F.lit(2019).alias("year"))
    plan = rl.crash_ledger(typed, target)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    assert plan.count("Exchange hashpartitioning(st_case") == 1


def state(spark, table):
    rows = sorted(map(tuple, inc.read_table(spark, table).collect()), key=str)
    bad = sorted(map(tuple, inc.read_quarantine(spark, table).drop("source_file").collect()), key=str)
    return rows, bad, sorted(os.path.basename(r["path"]) for r in inc.read_files(spark, table).collect())


class Killed(Exception):
    pass


def test_killed_runs_repeat_to_the_same_table(spark, tmp_path, monkeypatch):
    """Every write, move and commit of a run fails once; the run is repeated until it ends."""
    root = f"{tmp_path}/raw"
    _fixture(root)
    codes = spark.createDataFrame(CODES, CODE_SCHEMA)
    assert inc.load_new_files(spark, root, f"{tmp_path}/whole", codes) == {"new_files": 2, "rows_added": 3}
    want = state(spark, f"{tmp_path}/whole")
    assert len(want[0]) == 3 and len(want[1]) == 3 and len(want[2]) == 2

    table, steps, left = f"{tmp_path}/broken", [], {"n": 0}

    def failing(name, real, before):
        def step(*args, **kw):
            steps.append(name)
            if len(steps) == left["n"] and before:
                raise Killed(name)
            out = real(*args, **kw)
            if len(steps) == left["n"]:
                raise Killed(name)
            return out
        return step

    writer = type(spark.range(1).write)
    real = {"parquet": writer.parquet, "move": commits.CommitLog.move, "commit": commits.CommitLog.commit}
    killed = 0
    for before in (True, False):
        for n in range(1, 12):
            table = f"{tmp_path}/broken{before}{n}"
            steps.clear()
            left["n"] = n
            for name, of in (("parquet", writer), ("move", commits.CommitLog), ("commit", commits.CommitLog)):
                monkeypatch.setattr(of, name, failing(name, real[name], before))
            try:
                inc.load_new_files(spark, root, table, codes)
                ended = True
            except Killed:
                ended = False
                killed += 1
                seen = state(spark, table)
                assert seen == want if steps[-1] == "commit" and not before else seen == ([], [], [])
            for name, of in (("parquet", writer), ("move", commits.CommitLog), ("commit", commits.CommitLog)):
                monkeypatch.setattr(of, name, real[name])
            inc.load_new_files(spark, root, table, codes)
            assert state(spark, table) == want
            assert inc.load_new_files(spark, root, table, codes) == {"new_files": 0, "rows_added": 0}
            if ended:
                break
    assert killed >= 10


def test_uncommitted_batches_are_swept(spark, tmp_path):
    log = commits.CommitLog(spark, f"{tmp_path}/t")
    for b in ("a", "b"):
        spark.range(3).write.parquet(log.folder(b, "rows"))
    assert log.commit("a", {"n": 3}) and not log.commit("a", {"n": 4})
    assert log.committed() == {"a": {"n": 3}} and log.read("rows", "id long").count() == 3
    assert log.sweep() == 1 and spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_bad_batch_is_refused(spark, tmp_path):
    out, root = f"{tmp_path}/out", f"{tmp_path}/raw"
    codes = spark.createDataFrame(CODES, CODE_SCHEMA)
    _write(f"{root}/fars_2019/ACCIDENT.CSV", HEAD + "1,6,37,37,1,2019,1,1,,\n1,6,37,37,2,2019,1,1,,\nx,6,37,37,2,2019,1,1,,\n")
    jobs.run_crash_load(spark, root, out, codes, refuse=True).collect()
    assert spark.read.parquet(f"{out}/crashes").count() == 1
    report = {r["check"]: r["violations"] for r in spark.read.parquet(f"{out}/load_report").collect()}
    assert (report["inserted"], report["skipped_duplicate"], report["error"], report["missing_point"], report["implausible_fatalities"]) == (1, 1, 1, 1, 0)
    _write(f"{root}/fars_2020/ACCIDENT.CSV", HEAD + "2,6,37,37,31,2020,1,1,,\n3,6,37,37,1,1950,1,1,,\n")
    with pytest.raises(qa.BlockingCheckFailed, match="date_out_of_range=1, implausible_fatalities=1"):
        jobs.run_crash_load(spark, root, out, codes, refuse=True)
    assert spark.read.parquet(f"{out}/crashes").count() == 1
    report = {r["check"]: r["passed"] for r in spark.read.parquet(f"{out}/load_report").collect()}
    assert not report["implausible_fatalities"] and report["negative_fatalities"]
    jobs.run_crash_load(spark, root, out, codes).collect()  # loads it all the same
    assert spark.read.parquet(f"{out}/crashes").count() == 3


def test_enrichment_rewrites_changed_years(spark, tmp_path):
    out = str(tmp_path)
    crash = "st_case int, year int, lon double, lat double, total_fatalities int"
    square = [("01", "00001", 0, 0, i, x, y) for i, (x, y) in enumerate([(0., 0.), (9., 0.), (9., 9.), (0., 9.)])]
    spark.createDataFrame(square, "state_fips string, place_fips string, part int, ring int, seq int, x double, y double") \
        .write.parquet(f"{out}/place_vertices")
    spark.createDataFrame([("01", "00001", "City")], "state_fips string, place_fips string, display_name string").write.parquet(f"{out}/places")
    spark.createDataFrame([], "target_state string, target_place string, state_fips string, place_fips string").write.parquet(f"{out}/consolidated")
    spark.createDataFrame([(1, 2000, 1, 4), (2, 2001, 5, 4)], "st_case int, year int, person_type int, injury_severity int") \
        .write.partitionBy("year").parquet(f"{out}/persons")
    spark.createDataFrame([(1, 2000, 1., 1., 1), (2, 2001, 50., 1., 1)], crash).write.partitionBy("year").parquet(f"{out}/crashes")

    def files():
        return {y: sorted(f for f in os.listdir(f"{out}/crashes_enriched/year={y}") if f.endswith(".parquet")) for y in (2000, 2001)}
    assert tuple(jobs.run_enrichment(spark, out).first())[:2] == (2, 1)
    first = files()
    assert tuple(jobs.run_enrichment(spark, out).first())[:2] == (2, 1) and files() == first
    spark.createDataFrame([(3, 2001, 2., 2., 1)], crash).write.mode("append").partitionBy("year").parquet(f"{out}/crashes")
    assert tuple(jobs.run_enrichment(spark, out).first())[:2] == (3, 2)
    assert files()[2000] == first[2000] and files()[2001] != first[2001]
    spark.createDataFrame([("01", "00001", "New name")], "state_fips string, place_fips string, display_name string") \
        .write.mode("overwrite").parquet(f"{out}/places")
    jobs.run_enrichment(spark, out)
    got = {(r["st_case"], r["place_fips"], r["fips_city_name"]) for r in spark.read.parquet(f"{out}/crashes_enriched").collect()}
    assert got == {(1, "00001", "New name"), (2, None, None), (3, "00001", "New name")}
