"""Sinks: the serving files (E1–E6) and the export size report.

The source issued one query per city per sink and wrote one file per
(city[, year]) from Python.  Here each sink is one Spark job writing a
partitioned table:

* E1 ``crashes_metadata`` — one JSON row {min_year, max_year}
* E2 ``cities`` — 53 columns per eligible city, JSON lines ordered by
  population (range-partitioned sort: part files are in order), nulls kept
* E3 ``boundaries`` — one simplified GeoJSON geometry per city,
  ``partitionBy(state_fips, place_fips)``
* E4 ``annual_fatalities`` — five sums per (city, year),
  ``partitionBy(state_fips, place_fips)``
* E5 ``crashes`` — crash points of eligible cities from 2001,
  ``partitionBy(state_fips, place_fips, year)``; the input is range-
  partitioned on the partition columns *plus st_case*, so one hot
  (city, year) is split over many tasks instead of one; slots without
  points are listed in ``crashes_empty_slots`` (Spark writes no empty
  partition; the server answers ``[]`` for them)
* E6 ``hotspots`` — one GeoJSON feature per line (core and buffer zones)

Directory names are Hive-style (``state_fips=01``); declared difference to
the plain ``01/`` folders of the source.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadstats.operators import city_stats as cs
from roadstats.operators import hotspots as hs
from roadstats.operators import serving as sv
from roadstats.operators import arcs as ar
from roadstats.operators import spatial as sa
from roadstats.operators.ranking import ALL_RANK_OUTPUTS
from roadstats.session import ship_package, small_files_session
from roadstats.sources import folder_files as ff
from roadstats.sources.raw_files import _fs, _reset

CITY_EXPORT_COLS = ("place_name", "display_name", "state_fips", "place_fips", "state_name",
                    "population", "is_pledged", "lon", "lat") + cs.STAT_COLS + ALL_RANK_OUTPUTS
SIMPLIFY_TOLERANCE = 0.0001
MIN_EXPORT_YEAR = 2001

#: Hadoop options of a write of one small file a folder: tasks move their files to the final folders themselves
#: (the driver would move all, one by one).
FOLDER_OPTIONS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
#: What Spark writes as %XX in the name of a folder, and the name for no value.
_UNSAFE, NO_VALUE = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]"), "__HIVE_DEFAULT_PARTITION__"


def _json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _json_folders(df: DataFrame, path: str, folders: Sequence[str], order: Sequence[str]) -> None:
    """JSON lines under ``path``, a folder for each value of ``folders``, by each task of ``df`` in their ``order``.

    In a local folder Hadoop starts a process for each file it creates, to set its permissions, which takes far longer
    than the few lines do: there tasks write the files themselves.  Elsewhere Spark's own writer does."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    df = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in folders if c in text})  # one folder for both, as Spark's
    rows = df.sortWithinPartitions(*folders, *order)
    fs, target = _fs(df.sparkSession, path)
    if fs.getUri().getScheme() != "file":
        rows.write.mode("overwrite").option("ignoreNullFields", False).options(**FOLDER_OPTIONS).partitionBy(*folders).json(path)
        return
    _reset(df.sparkSession, path)
    ship_package(df.sparkSession)
    body = F.to_json(F.struct(*[c for c in df.columns if c not in folders]), {"ignoreNullFields": "false"})
    lines = rows.select(*[F.col(c).cast("string") for c in folders], body.cast("binary").alias("line"))
    write = _folder_writer(fs.makeQualified(target).toUri().getPath(), tuple(folders))
    lines.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()
    fs.create(_fs(df.sparkSession, f"{path}/_SUCCESS")[1], True).close()


def _folder_writer(root: str, folders: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the lines (last column) of sorted rows to a file a folder, named by the task; a file shows when it is whole,
    and a task that runs again replaces its own."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}.json"
        at, folder, out, files = None, None, None, 0

        def end() -> None:
            if out is not None:
                out.close()
                os.replace(f"{folder}/.{name}", f"{folder}/{name}")
        for batch in batches:
            *keys, lines = (c.to_pylist() for c in batch.columns)
            for key, line in zip(zip(*keys), lines):
                if key != at:
                    end()
                    folder = "/".join((root, *(f"{f}={folder_name(v)}" for f, v in zip(folders, key))))
                    _make_folder(folder)
                    at, out, files = key, open(f"{folder}/.{name}", "wb"), files + 1
                out.write(line + b"\n")
        end()
        yield pa.record_batch([pa.array([files], pa.int64())], names=["files"])
    return write


def _make_folder(path: str) -> None:
    """``os.makedirs`` without a look at what is there first, as the folder above mostly is."""
    try:
        os.mkdir(path)
    except FileExistsError:
        pass
    except FileNotFoundError:
        os.makedirs(path, exist_ok=True)


def folder_name(value: str | None) -> str:
    """``value`` as Spark names a folder by it."""
    return NO_VALUE if not value else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)


def _folder_tasks(df: DataFrame) -> int:
    """Tasks of a write into very many folders.  Its time goes by the files, which are few bytes each; a count that is
    given keeps Spark from merging the tasks by their bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read_folders(spark: SparkSession, path: str, schema: T.StructType, folders: tuple[str, ...]) -> DataFrame:
    """The JSON rows under ``path`` as ``schema``; ``folders`` are its columns that the files' folders name (codes).

    They are taken from each row's file: as partitions Spark's driver would parse every folder's name.  In a local folder
    tasks list and read the files (``folder_files``): Spark's driver would hold them all."""
    body = T.StructType([f for f in schema.fields if f.name not in folders])
    root = ff.local_root(spark, path)
    if root is None:
        rows = small_files_session(spark).read.option("recursiveFileLookup", "true").schema(body).json(path)
        rows = rows.select("*", *[folder_value(F.col("_metadata.file_path"), f).alias(f) for f in folders])
    else:
        texts = ff.file_texts(spark, root).select("text", *[folder_value(F.col("file"), f).alias(f) for f in folders])
        lines = texts.select(*folders, F.explode(F.split("text", "\n")).alias("_line")).where(F.trim("_line") != "")
        rows = lines.select(*folders, F.from_json("_line", body).alias("_row")).select("_row.*", *folders)
    return rows.select(*schema.fieldNames())


def folder_value(file: F.Column, folder: str) -> F.Column:
    """What ``folder`` is in the path ``file``; null if it is null there."""
    value = F.regexp_extract(file, f"/{folder}=([^/]*)/", 1)
    return F.when(value != NO_VALUE, value)


def crashes_metadata(crashes: DataFrame) -> DataFrame:
    """E1 rows: the year extent (A10)."""
    return sv.year_extent(crashes)


def write_crashes_metadata(crashes: DataFrame, out: str) -> str:
    path = f"{out}/crashes_metadata"
    _json(crashes_metadata(crashes), path)
    return path


def city_export(places: DataFrame, ranked_stats: DataFrame,
                min_population: int = 100000) -> DataFrame:
    """E2 rows: places ⋈ stats (J6) for eligible cities, 53 columns.

    ``places`` carries names and the point (lon/lat from the point
    write-back); ``ranked_stats`` the 12 statistics and 32 rank columns.
    """
    p = places.select("state_fips", "place_fips", "place_name", "display_name", "state_name",
                      F.col("point_lon").alias("lon"), F.col("point_lat").alias("lat"))
    s = ranked_stats.select("state_fips", "place_fips", "population",
                            "is_pledged", *cs.STAT_COLS, *ALL_RANK_OUTPUTS)
    j = p.join(s, ["state_fips", "place_fips"], "inner")
    return cs.eligible(j, min_population).select(*CITY_EXPORT_COLS)


def write_cities(cities: DataFrame, out: str) -> str:
    path = f"{out}/cities"
    _json(cities.orderBy(F.col("population").desc(), "state_fips", "place_fips"), path)
    return path


def boundary_export(vertices: DataFrame, places: DataFrame,
                    tolerance: float = SIMPLIFY_TOLERANCE) -> DataFrame:
    """E3 rows: (state_fips, place_fips, value), value a GeoJSON Feature with
    the place's name and codes and its geometry after G10."""
    shapes = sa.geojson_geometries(ar.simplify_shared(vertices, tolerance))
    keys = ["state_fips", "place_fips"]
    named = shapes.join(places.select(*keys, "place_name").dropDuplicates(keys), keys, "left")
    properties = F.to_json(F.struct("place_name", *keys), {"ignoreNullFields": "false"})
    return named.select(*keys, F.concat(F.lit('{"type":"Feature","properties":'), properties,
                                        F.lit(',"geometry":'), F.col("geometry"), F.lit("}")).alias("value"))


def write_boundaries(vertices: DataFrame, places: DataFrame, out: str,
                     tolerance: float = SIMPLIFY_TOLERANCE) -> str:
    path = f"{out}/boundaries"
    (boundary_export(vertices, places, tolerance)
     .write.mode("overwrite").partitionBy("state_fips", "place_fips").text(path))
    return path


def write_annual(annual: DataFrame, out: str) -> str:
    """A9 rows, one folder per city, rows in year order."""
    path = f"{out}/annual_fatalities"
    keys = ["state_fips", "place_fips"]
    _json_folders(annual.repartition(_folder_tasks(annual), *keys), path, keys, ["year"])
    return path


def write_crash_points(points: DataFrame, out: str, partitions: int | None = None) -> str:
    """E5: one folder per (city, year); skew-safe range partitioning.  The
    folder's year is a copy, so that the rows keep theirs."""
    path = f"{out}/crashes"
    keys = ["state_fips", "place_fips", "folder_year"]
    points = points.withColumn("folder_year", F.col("year"))
    ranged = points.repartitionByRange(partitions or _folder_tasks(points), *keys, "st_case")
    _json_folders(ranged, path, keys, ["st_case"])
    return path


def empty_slots(points: DataFrame, cities: DataFrame, max_year: int,
                min_year: int = MIN_EXPORT_YEAR) -> DataFrame:
    """(city, year) slots from ``min_year`` to ``max_year`` with no points."""
    have = points.select("state_fips", "place_fips", "year").distinct()
    grid = cities.select("state_fips", "place_fips").withColumn(
        "year", F.explode(F.sequence(F.lit(min_year), F.lit(max_year))))
    return grid.join(have, ["state_fips", "place_fips", "year"], "left_anti")


def write_empty_slots(slots: DataFrame, out: str) -> str:
    path = f"{out}/crashes_empty_slots"
    _json(slots, path)
    return path


def hotspot_lines(hot: DataFrame) -> DataFrame:
    """E6 rows: one GeoJSON feature per (city, zone) as a JSON text line."""
    f = hs.zone_features(hot)
    return f.select("state_fips", "place_fips", "zone_type", F.col("feature").alias("value"))


def write_hotspots(hot: DataFrame, out: str) -> str:
    path = f"{out}/hotspots"
    hotspot_lines(hot).select("value").write.mode("overwrite").text(path)
    return path


def export_sizes(spark: SparkSession, out: str) -> DataFrame:
    """Files and bytes per sink folder (distributed listing, no content
    read).  Spark's bookkeeping files (``_SUCCESS``, ``.crc``) are skipped."""
    root = ff.local_root(spark, out)
    if root is None:
        files = (small_files_session(spark).read.format("binaryFile").option("recursiveFileLookup", "true")
                 .load(out).select("path", "length"))
    else:
        files = ff.file_sizes(spark, root).withColumnRenamed("file", "path")
    rel = F.regexp_replace("path", "^.*?" + out.rstrip("/").split("/")[-1] + "/", "")
    name = F.element_at(F.split("path", "/"), -1)
    return (files.filter(~name.startswith("_") & ~name.startswith("."))
            .select(F.split(rel, "/").getItem(0).alias("sink"), "length")
            .groupBy("sink").agg(F.count(F.lit(1)).alias("files"),
                                 F.sum("length").alias("bytes")))
