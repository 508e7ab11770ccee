"""Person semantics and per-crash victim subtypes.

The source derived subtypes with two statements per crash; here it is one
aggregate over the person table keyed by crash, joined back to crashes once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.functions.dims import (FATAL_SEVERITY, PERSON_ROLES, ROLE_MODES,
                                      VICTIM_BUCKETS)

SUBTYPE_COLS = ("motorist_fatalities", "pedestrian_fatalities",
                "cyclist_fatalities", "other_fatalities")


def victim_bucket(person_type: Column | str = "person_type") -> Column:
    """person_type -> motorist / pedestrian / cyclist / other, else null."""
    pt = F.col(person_type) if isinstance(person_type, str) else person_type
    expr = None
    for bucket, codes in VICTIM_BUCKETS:
        cond = pt.isin(*codes)
        expr = F.when(cond, F.lit(bucket)) if expr is None else expr.when(cond, F.lit(bucket))
    return expr


def person_semantics(persons: DataFrame) -> DataFrame:
    """Add is_fatal_person, person_role, person_mode (view semantics)."""
    pt = F.col("person_type")
    role = None
    for name, codes in PERSON_ROLES:
        cond = pt.isin(*codes)
        role = F.when(cond, F.lit(name)) if role is None else role.when(cond, F.lit(name))
    role = role.otherwise(F.lit("Unknown"))
    mode = None
    for r, m in ROLE_MODES:
        cond = F.col("person_role") == r
        mode = F.when(cond, F.lit(m)) if mode is None else mode.when(cond, F.lit(m))
    mode = mode.otherwise(F.lit("Unknown"))
    return (persons
            .withColumn("is_fatal_person",
                        F.coalesce(F.col("injury_severity") == FATAL_SEVERITY, F.lit(False)))
            .withColumn("person_role", role)
            .withColumn("person_mode", mode))


def crash_subtype_counts(persons: DataFrame,
                         crash_key: Sequence[str] = ("st_case", "year")) -> DataFrame:
    """A1 aggregate: fatal persons per crash by victim bucket.

    ``fatal_persons`` counts every severity-4 person, ``unknown_fatal`` the
    ones whose code is in no bucket (excluded from the four subtypes).
    """
    fatal = F.col("injury_severity") == FATAL_SEVERITY
    b = victim_bucket()
    aggs = [F.count_if(fatal & (b == name)).cast("int").alias(f"{name}_fatalities")
            for name, _ in VICTIM_BUCKETS]
    aggs += [F.count_if(fatal).cast("int").alias("fatal_persons"),
             F.count_if(fatal & b.isNull()).cast("int").alias("unknown_fatal")]
    return persons.groupBy(*crash_key).agg(*aggs)


def apply_subtypes(crashes: DataFrame, persons: DataFrame,
                   crash_key: Sequence[str] = ("st_case", "year"),
                   years: Sequence[int] | None = None) -> DataFrame:
    """A1 + L7: write subtype counts onto crashes.

    Crashes without fatal persons get zeros.  With ``years``, only crashes of
    those years are (re)derived; the others keep their current values.
    """
    key = list(crash_key)
    counts = crash_subtype_counts(persons, key).drop("fatal_persons", "unknown_fatal")
    base = crashes.drop(*[c for c in SUBTYPE_COLS if c in crashes.columns]) \
        if years is None else crashes
    j = base.join(counts.select(*key, *[F.col(c).alias(f"_n_{c}") for c in SUBTYPE_COLS]),
                  key, "left")
    in_scope = F.lit(True) if years is None else F.col("year").isin(list(years))
    for c in SUBTYPE_COLS:
        new = F.coalesce(F.col(f"_n_{c}"), F.lit(0))
        j = j.withColumn(c, new if years is None else
                         F.when(in_scope, new).otherwise(F.col(c)))
    cols = crashes.columns + [c for c in SUBTYPE_COLS if c not in crashes.columns]
    return j.select(*cols)


def unknown_person_types(persons: DataFrame,
                         crash_key: Sequence[str] = ("st_case", "year")) -> DataFrame:
    """Fatal persons with an unrecognised person_type, per code."""
    fatal = F.col("injury_severity") == FATAL_SEVERITY
    return (persons.filter(fatal & victim_bucket().isNull())
            .groupBy("person_type")
            .agg(F.count(F.lit(1)).alias("n_persons"),
                 F.count_distinct(*[F.col(c) for c in crash_key]).alias("n_crashes")))


def person_with_crash(persons: DataFrame, crashes: DataFrame,
                      crash_key: Sequence[str] = ("st_case", "year")) -> DataFrame:
    """Person rows with their crash's year and date (inner join)."""
    c = crashes.select(*crash_key, *[x for x in ("year", "crash_date")
                                     if x not in crash_key])
    return persons.join(c, list(crash_key), "inner")


def fatal_crash_flags(persons: DataFrame, crashes: DataFrame,
                      crash_key: Sequence[str] = ("st_case", "year")) -> DataFrame:
    """A2: ``bool_or(is_fatal_person)`` per crash over the person×crash view."""
    pw = person_semantics(person_with_crash(persons, crashes, crash_key))
    keys = list(dict.fromkeys(list(crash_key) + ["year"]))
    return pw.groupBy(*keys).agg(F.bool_or("is_fatal_person").alias("is_fatal_crash"))
