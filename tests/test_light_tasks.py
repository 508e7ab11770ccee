"""The loaded table and the person rows are built by tasks of bounded size, whatever the table's."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

from roadstats import session
from roadstats.session import light_tasks_session, session_with, shuffle_partitions
from roadstats.sources.raw_files import scan_crash_paths
from roadstats.sources.standins import PERSON_SPLIT, crash_inputs, crashes, persons
from roadstats.sources.tables import table
from tests.conftest import SF_SMALL


def _lineitem(tmp_path, rows=20000):
    t = pa.table({"l_orderkey": list(range(rows)), "l_linenumber": [1] * rows})
    pq.write_table(t, f"{tmp_path}/lineitem.parquet", row_group_size=500, compression="none", use_dictionary=False)
    return str(tmp_path)


def test_a_table_is_read_in_splits_of_the_size_asked(spark, tmp_path):
    at = _lineitem(tmp_path)
    whole = session_with(spark, {"spark.sql.files.openCostInBytes": "1g"})
    assert table(whole, at, "lineitem").rdd.getNumPartitions() == 1
    split = table(whole, at, "lineitem", "32k")
    assert split.rdd.getNumPartitions() >= 5
    assert split.count() == 20000 and split.join(spark.range(5).withColumnRenamed("id", "l_orderkey"), "l_orderkey").count() == 5


def test_light_tasks_change_one_setting_of_their_own_session(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    light = light_tasks_session(spark)
    assert light.conf.get(key) in ("16m", "16777216b", "16MB") and spark.conf.get(key) not in ("16m", "16777216b")
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        assert light.conf.get(k) == spark.conf.get(k)
    assert PERSON_SPLIT == "16m"


def test_shuffles_have_partitions_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    at = tmp_path / "input"
    at.mkdir()
    for name, size in (("a", 40 << 20), ("b", 1 << 20)):
        with open(at / name, "wb") as f:
            f.truncate(size)
    assert shuffle_partitions(spark, f"{at}/b") == shuffle_partitions(spark) == 8
    assert shuffle_partitions(spark, f"{at}/a") == 20 and shuffle_partitions(spark, str(at)) == 21
    monkeypatch.setattr(session, "PARTITION_INPUT", 4096)
    many = shuffle_partitions(spark, *crash_inputs(SF_SMALL))
    assert many > 8
    plain = session_with(spark, {"spark.sql.adaptive.enabled": "false"})
    assert crashes(plain, SF_SMALL).repartition("st_case").rdd.getNumPartitions() == many
    li = shuffle_partitions(spark, f"{SF_SMALL}/lineitem.parquet")
    assert persons(plain, SF_SMALL).rdd.getNumPartitions() == li > 8
    raw = scan_crash_paths(plain, [f"file:{_csv(tmp_path)}"])
    assert raw.repartition("ST_CASE").rdd.getNumPartitions() == 10


def _csv(tmp_path):
    at = tmp_path / "fars_1999"
    at.mkdir()
    row = b"1,2\n"
    (at / "ACCIDENT.CSV").write_bytes(b"ST_CASE,STATE\n" + row * ((10 * 4096 - 14) // len(row)))
    return at / "ACCIDENT.CSV"
