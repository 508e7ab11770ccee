"""Raw crash / person CSV files: stand-in generator and scans.

**Generator.**  The source pipeline reads one ``ACCIDENT.CSV`` and one
``PERSON.CSV`` per dataset year whose layout changed over the decades.  No
such files ship with the driver data, so ``ensure_fars_files`` derives them
from the typed stand-ins (``standins.crashes`` / ``standins.raw_persons``)
with Spark and writes them once to ``<checkpoint dir>/fars_raw/<sf>/``
(the shared folder named by ``spark.checkpoint.dir``), as
``fars_<year>/ACCIDENT.CSV`` etc.  Text rules by ``k = st_case``,
``r = k % 50`` (FIXED VALUES of the stand-in, mirrored by the oracles):

* eras: 1995–1996 have no ROUTE and no name columns; odd years from 1997
  have ROUTE; even years from 1997 also have STATENAME / COUNTYNAME /
  CITYNAME and lower-case ``latitude`` / ``longitud``; 1998's crash file is
  ``accident.csv``; 2001 has no person file
* ST_CASE ``x<k>`` when k % 211 = 0; STATE ``123`` (too long) when
  k % 101 = 0; ROUTE blank when k % 97 = 0 (eras with ROUTE)
* codes are written without zero padding; CITY ``9999`` when r = 30
* STATENAME blank when r = 40; CITYNAME ``Not Applicable`` when r = 35,
  blank when r = 45
* YEAR two-digit when r = 25; MONTH 99 when r = 0; DAY 0 when r = 10;
  February 30 when r = 20
* coordinates (located crashes) by k % 4: 0 decimal (``abc.d`` latitude
  when k % 9 = 0, padded with spaces when k % 7 = 0), 1 packed DMS with a
  signed longitude (latitude ``99999999`` when k % 13 = 0), 2 sentinel
  ``9999`` latitude, 3 blank latitude; unlocated crashes are blank
* crashes with k % 29 = 0 appear twice, the copy later in the file with
  FATALS + 1 (first row wins)
* person rows: every lineitem row (duplicates included) in the file of its
  crash's year, sorted by the person key then load order; AGE blank when
  (st_case + VEH_NO) % 199 = 0

**Scans.**  ``dataset_files`` lists the CSV files (distributed listing, no
content read), ``resolve_years`` validates a year request (S4) and
``scan_crash_files`` / ``scan_person_files`` read every header era
separately and union them by name, all columns as strings (S1, S2), with
per-era ``has_*`` flags, ``dataset_year`` and a file-order ``load_order``.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadstats.session import light_tasks_session, scale_tag, shared_dir
from roadstats.sources import standins as sp
from roadstats.sources.file_heads import first_records, group_by_head

YEAR_DIR_RE = r"fars_((19|20)[0-9]{2})"
DEFAULT_FIRST_YEAR, DEFAULT_LAST_YEAR = 1987, 2024

CRASH_FIELDS = ("ST_CASE", "STATE", "STATENAME", "COUNTY", "COUNTYNAME", "CITY", "CITYNAME",
                "ROUTE", "FATALS", "YEAR", "MONTH", "DAY", "LATITUDE", "LONGITUD")
# absent -> KeyError in the source (the file fails); here every row is an error
CRASH_REQUIRED = ("ST_CASE", "STATE", "COUNTY", "CITY", "YEAR", "MONTH", "DAY")
PERSON_FIELDS = ("ST_CASE", "VEH_NO", "PER_NO", "AGE", "SEX", "PER_TYP", "INJ_SEV", "LOCATION")

# FIXED VALUES of the generator (see module docstring).
ROUTE_FROM_YEAR = 1997
NAMED_ERA_PARITY = 0
NO_PERSON_FILE_YEARS = (2001,)
LOWER_CASE_CRASH_FILE_YEARS = (1998,)
GENERATOR_VERSION = 1        # part of the output path: bump when a rule changes


# ---------------------------------------------------------------------------
# S4 — year selection
# ---------------------------------------------------------------------------

def resolve_years(requested: Iterable[int] | None = None, start: int = DEFAULT_FIRST_YEAR,
                  end: int = DEFAULT_LAST_YEAR) -> list[int]:
    """Sorted distinct target years; all years start..end when none are given.

    Raises ``ValueError`` when end < start or a requested year is outside
    the range.  The result becomes a partition filter (``year IN (…)``).
    """
    if end < start:
        raise ValueError(f"end year {end} is before start year {start}")
    if requested is None:
        return list(range(start, end + 1))
    years = sorted({int(y) for y in requested})
    bad = [y for y in years if y < start or y > end]
    if bad:
        raise ValueError(f"years out of range {start}-{end}: {bad}")
    return years


# ---------------------------------------------------------------------------
# Generator (stand-in input files)
# ---------------------------------------------------------------------------

def _milli_text(milli: F.Column) -> F.Column:
    """Thousandths of a degree -> exact decimal text, e.g. -117100 -> -117.100."""
    a = F.abs(milli)
    sign = F.when(milli < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, (a / 1000).cast("long").cast("string"), F.lit("."),
                    F.lpad((a % 1000).cast("string"), 3, "0"))


def _packed_dms(milli: F.Column) -> F.Column:
    """Thousandths of a degree -> packed DDMMSSSS integer (exact)."""
    a = F.abs(milli)
    deg = (a / 1000).cast("long")
    centi = (a % 1000) * 360          # hundredths of a second within the degree
    return deg * 1_000_000 + (centi / 6000).cast("long") * 10_000 + centi % 6000


def raw_crash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash rows as text, every column of every era, plus ``_k`` / ``_copy``."""
    c = sp.crashes(spark, sf_dir)
    o = sp.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("st_case"), "o_custkey",
        F.month("o_orderdate").alias("_m"), F.dayofmonth("o_orderdate").alias("_d"))
    cu = sp.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    c = c.join(o, "st_case").join(cu, "o_custkey")
    k = F.col("st_case")
    r = k % 50
    lat_milli = F.lit(24500) + (k * 104729) % 24500
    lon_milli = F.lit(-125000) + (k * 7919) % 58000
    mode = k % 4
    located = F.col("lat").isNotNull()
    dec_lat = F.when(k % 9 == 0, F.lit("abc.d")) \
        .when(k % 7 == 0, F.concat(F.lit("  "), _milli_text(lat_milli), F.lit(" "))) \
        .otherwise(_milli_text(lat_milli))
    lat_t = (F.when(~located, F.lit(None))
             .when(mode == 0, dec_lat)
             .when(mode == 1, F.when(k % 13 == 0, F.lit("99999999"))
                   .otherwise(_packed_dms(lat_milli).cast("string")))
             .when(mode == 2, F.lit("9999")))
    lon_t = (F.when(~located, F.lit(None))
             .when(mode == 1, F.concat(F.lit("-"), _packed_dms(lon_milli).cast("string")))
             .otherwise(_milli_text(lon_milli)))
    yr = F.col("year")
    base = c.select(
        k.alias("_k"), yr.alias("_year"),
        F.when(k % 211 == 0, F.concat(F.lit("x"), k.cast("string")))
         .otherwise(k.cast("string")).alias("ST_CASE"),
        F.when(k % 101 == 0, F.lit("123")).otherwise(F.col("c_nationkey").cast("string"))
         .alias("STATE"),
        F.when(r == 40, F.lit(None)).otherwise(F.col("state_name")).alias("STATENAME"),
        (F.col("o_custkey") % 1000).cast("string").alias("COUNTY"),
        F.concat(F.lit("County "), F.col("county")).alias("COUNTYNAME"),
        F.when(r == 30, F.lit("9999")).otherwise((F.col("c_nationkey") * 37).cast("string"))
         .alias("CITY"),
        F.when(r == 35, F.lit("Not Applicable")).when(r == 45, F.lit(None))
         .otherwise(F.col("fars_city_name")).alias("CITYNAME"),
        F.when(k % 97 == 0, F.lit(None)).otherwise(F.col("route_code").cast("string"))
         .alias("ROUTE"),
        F.col("total_fatalities").alias("_fatals"),
        F.when(r == 25, (yr % 100).cast("string")).otherwise(yr.cast("string")).alias("YEAR"),
        F.when(r == 0, F.lit("99")).when(r == 20, F.lit("2"))
         .otherwise(F.col("_m").cast("string")).alias("MONTH"),
        F.when(r == 10, F.lit("0")).when(r == 20, F.lit("30"))
         .otherwise(F.col("_d").cast("string")).alias("DAY"),
        lat_t.alias("LATITUDE"), lon_t.alias("LONGITUD"),
    )
    copies = F.when(F.col("_k") % 29 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = base.withColumn("_copy", F.explode(copies))
    return out.withColumn("FATALS", (F.col("_fatals") + F.col("_copy")).cast("string")) \
        .drop("_fatals")


def raw_person_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person rows as text with the dataset year of their crash."""
    p = sp.raw_persons(spark, sf_dir)
    o = sp.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("st_case"), F.year("o_orderdate").alias("_year"))
    p = p.join(o, "st_case")
    lo = F.col("load_order")
    return p.select(
        "_year", F.col("st_case").alias("_k"),
        F.col("vehicle_number").alias("_veh"), F.col("person_number").alias("_per"),
        lo.alias("_lo"), F.col("person_type").alias("_pt"),
        F.col("injury_severity").alias("_sev"),
        F.col("st_case").cast("string").alias("ST_CASE"),
        F.col("vehicle_number").cast("string").alias("VEH_NO"),
        F.col("person_number").cast("string").alias("PER_NO"),
        F.when((F.col("st_case") + F.col("vehicle_number")) % 199 == 0, F.lit(None))
         .otherwise(lo["l_quantity"].cast("int").cast("string")).alias("AGE"),
        (F.lit(1) + lo["l_partkey"] % 2).cast("string").alias("SEX"),
        F.col("person_type").cast("string").alias("PER_TYP"),
        F.col("injury_severity").cast("string").alias("INJ_SEV"),
        (F.col("vehicle_number") % 3).cast("string").alias("LOCATION"),
    )


def _crash_era(year: F.Column) -> F.Column:
    return (F.when(year < ROUTE_FROM_YEAR, F.lit("early"))
            .when(year % 2 == NAMED_ERA_PARITY, F.lit("named"))
            .otherwise(F.lit("route")))


_ERA_COLUMNS = {
    "early": ["ST_CASE", "STATE", "COUNTY", "CITY", "FATALS", "YEAR", "MONTH", "DAY",
              "LATITUDE", "LONGITUD"],
    "route": ["ST_CASE", "STATE", "COUNTY", "CITY", "ROUTE", "FATALS", "YEAR", "MONTH",
              "DAY", "LATITUDE", "LONGITUD"],
    "named": ["ST_CASE", "STATE", "STATENAME", "COUNTY", "COUNTYNAME", "CITY", "CITYNAME",
              "ROUTE", "FATALS", "YEAR", "MONTH", "DAY", "latitude", "longitud"],
}


def _era_of(year: int) -> str:
    if year < ROUTE_FROM_YEAR:
        return "early"
    return "named" if year % 2 == NAMED_ERA_PARITY else "route"


def _csv_line(columns: Sequence[str]) -> F.Column:
    """A row as the CSV writer writes it."""
    return F.to_csv(F.struct(*columns), {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _write_per_year(spark: SparkSession, df: DataFrame, stage: str, root: str, sort_cols: Sequence[str],
                    columns_of_year: Callable[[int], Sequence[str]], name_of_year: Callable[[int], str]) -> None:
    """One CSV per dataset year of the lines ``value``, in the order of ``sort_cols``.

    Ranges of (year, order) are sorted and written by tasks of their own, so no task sorts a year; then one task a
    year copies its ranges' lines, one after the other, to the year's file, which holds no more than a line."""
    (df.repartitionByRange("_year", *sort_cols).sortWithinPartitions("_year", *sort_cols).select("value", "_year")
       .write.mode("overwrite").partitionBy("_year").option("lineSep", "\n").text(stage))
    fs, stage_p = _fs(spark, stage)
    folders = [(int(m.group(1)), st.getPath()) for st in fs.listStatus(stage_p)
               if (m := re.match(r"_year=(\d+)$", st.getPath().getName()))]
    own = spark.newSession()
    own.conf.set("spark.sql.sources.ignoreDataLocality", True)  # coalesce keeps the order of tasks that are bound to no host

    def join(folder: tuple[int, object]) -> None:
        year, path = folder
        parts = sorted(f.getPath().toString() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-"))
        lines = own.createDataFrame([(",".join(columns_of_year(year)),)], "value string").coalesce(1)
        for part in parts:
            lines = lines.unionByName(own.read.schema("value string").option("lineSep", "\n").text(part))
        one = f"{stage}_joined/{year}"
        lines.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(one)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/fars_{year}")
        fs.mkdirs(target)
        file, = (f.getPath() for f in fs.listStatus(_fs(spark, one)[1]) if f.getPath().getName().startswith("part-"))
        if not fs.rename(file, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, name_of_year(year))):
            raise OSError(f"could not move {file} to {target}/{name_of_year(year)}")

    with ThreadPoolExecutor(8) as pool:  # a job of one task each
        list(pool.map(join, folders))
    _reset(spark, f"{stage}_joined")
    fs.delete(stage_p, True)


def _reset(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def fars_root(spark: SparkSession, sf_dir: str) -> str:
    tag = scale_tag(sf_dir)
    return f"{shared_dir(spark)}/roadstats_fars_raw/v{GENERATOR_VERSION}/{tag}"


def ensure_fars_files(spark: SparkSession, sf_dir: str) -> str:
    """Write the stand-in FARS files for ``sf_dir`` once; return their root."""
    root = fars_root(spark, sf_dir)
    done = f"{root}/_COMPLETE"
    if _exists(spark, done):
        return root
    _reset(spark, root)   # an interrupted earlier run leaves no partial files behind
    era = _crash_era(F.col("_year"))
    line = F.coalesce(*[F.when(era == e, _csv_line(cols)) for e, cols in _ERA_COLUMNS.items()])
    light = light_tasks_session(spark, *sp.crash_inputs(sf_dir))
    crashes = raw_crash_text(light, sf_dir).select("_year", "_k", "_copy", line.alias("value"))
    _write_per_year(spark, crashes, f"{root}/_stage_crash", root, ["_k", "_copy"], lambda y: _ERA_COLUMNS[_era_of(y)],
                    lambda y: "accident.csv" if y in LOWER_CASE_CRASH_FILE_YEARS else "ACCIDENT.CSV")
    persons = raw_person_text(light, sf_dir).filter(~F.col("_year").isin(*NO_PERSON_FILE_YEARS))
    order = ["_k", "_veh", "_per", "_lo", "_pt", "_sev"]
    _write_per_year(spark, persons.select("_year", *order, _csv_line(PERSON_FIELDS).alias("value")), f"{root}/_stage_person",
                    root, order, lambda y: PERSON_FIELDS, lambda y: "PERSON.CSV")
    fs, p = _fs(spark, done)
    fs.create(p, True).close()
    return root


# ---------------------------------------------------------------------------
# S3 — dataset dispatch
# ---------------------------------------------------------------------------

def dataset_files(spark: SparkSession, root: str) -> DataFrame:
    """Every CSV under ``root`` with its dataset year and kind.

    A distributed listing (``binaryFile`` with the content column pruned):
    kind = crash for ``ACCIDENT.CSV`` and person for ``PERSON.CSV`` in any
    letter case, null otherwise; year from the ``fars_<year>`` directory.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.[cC][sS][vV]").load(root)
             .select("path", "length"))
    return with_dataset(files)


def with_dataset(files: DataFrame) -> DataFrame:
    """(path, length) with the dataset year and kind that the path tells."""
    fname = F.upper(F.element_at(F.split("path", "/"), -1))
    year = F.regexp_extract("path", YEAR_DIR_RE, 1)
    return files.select(
        "path", "length",
        F.when(year != "", year.cast("int")).alias("year"),
        F.when(fname == "ACCIDENT.CSV", F.lit("crash"))
         .when(fname == "PERSON.CSV", F.lit("person")).alias("dataset"))


def dataset_presence(files: DataFrame) -> DataFrame:
    """Per year: crash / person file present, and whether the year loads.

    A year without a crash file is skipped whole (its persons too); a year
    without a person file keeps its crashes (reported as a person error).
    """
    return (files.filter(F.col("year").isNotNull())
            .groupBy("year").agg(
                F.count_if(F.col("dataset") == "crash").alias("crash_files"),
                F.count_if(F.col("dataset") == "person").alias("person_files"))
            .withColumn("loads_crashes", F.col("crash_files") > 0)
            .withColumn("loads_persons", (F.col("crash_files") > 0)
                        & (F.col("person_files") > 0)))


def _file_list(files: DataFrame, dataset: str, years: Sequence[int] | None,
               require_crash: bool) -> list[str]:
    """Paths of one dataset (file metadata only: one row per file)."""
    pres = dataset_presence(files).filter("loads_crashes").select("year")
    f = files.filter(F.col("dataset") == dataset)
    if require_crash:
        f = f.join(pres, "year", "left_semi")
    if years is not None:
        f = f.filter(F.col("year").isin(list(years)))
    return sorted(r["path"] for r in f.select("path").collect())


def _scan(spark: SparkSession, paths: Sequence[str], fields: Sequence[str],
          aliases: dict[str, Sequence[str]]) -> DataFrame | None:
    """Read files era by era (same header = same era) and union by name.

    Headers are read in tasks; a file without a line has no rows.  What is made of the rows (loads, which sort them) runs
    in light tasks, with shuffle partitions by the files' size."""
    out, light = None, light_tasks_session(spark, *paths)
    for head, era_paths in group_by_head(paths, first_records(spark, paths)).items():
        header = tuple(next(csv.reader(io.StringIO(head)), []))
        # all-text schema from the header already read: no schema-inference
        # job; enforceSchema=false still checks each file's header against it
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        df = (light.read.option("header", True).option("enforceSchema", False)
              .schema(schema).csv(era_paths))
        sel = []
        for name in fields:
            present = [a for a in aliases.get(name, (name,)) if a in header]
            value = (F.coalesce(*[F.col(f"`{a}`") for a in present]) if present
                     else F.lit(None).cast("string"))
            sel.append(value.alias(name))
            sel.append(F.lit(bool(present)).alias(f"has_{name.lower()}"))
        df = df.select(
            *sel,
            F.col("_metadata.file_path").alias("source_file"),
            F.struct(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row")).alias("load_order"))
        # named dataset_year: "year" would resolve to the raw YEAR column
        # (column names are case-insensitive)
        df = df.withColumn("dataset_year",
                           F.regexp_extract("source_file", YEAR_DIR_RE, 1).cast("int"))
        out = df if out is None else out.unionByName(df)
    return out


def scan_crash_files(spark: SparkSession, root: str,
                     years: Sequence[int] | None = None) -> DataFrame:
    """All crash files (or the given years) as text columns + flags."""
    files = dataset_files(spark, root)
    paths = _file_list(files, "crash", years, require_crash=False)
    return _scan(spark, paths, CRASH_FIELDS,
                 {"LATITUDE": ("LATITUDE", "latitude"), "LONGITUD": ("LONGITUD", "longitud")})


def scan_crash_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """S1 over an explicit file list (incremental loads)."""
    return _scan(spark, list(paths), CRASH_FIELDS,
                 {"LATITUDE": ("LATITUDE", "latitude"), "LONGITUD": ("LONGITUD", "longitud")})


def scan_person_files(spark: SparkSession, root: str,
                      years: Sequence[int] | None = None) -> DataFrame:
    """Person files of years that also have a crash file."""
    files = dataset_files(spark, root)
    paths = _file_list(files, "person", years, require_crash=True)
    return _scan(spark, paths, PERSON_FIELDS, {})
