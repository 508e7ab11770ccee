"""Per-city averages, per-100k rates and trends.

Rates are ratios of integers: the average over n years of f/pop*100000 is
100000*sum(f) / (pop*n).  All sums and counts are aggregated as integers and
divided once with exact half-up rounding (``ratio_half_up``), so results do
not depend on summation order or partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadstats.functions.exprs import ratio_half_up

CITY_KEY = ("state_fips", "place_fips")
# (output suffix, annual column)
METRICS = (("", "fatalities"), ("pedestrian", "ped_fatalities"),
           ("cyclist", "cyc_fatalities"), ("motorist", "mot_fatalities"))
AVG_COLS = ("avg_fatalities_5yr", "avg_5yr_pedestrian", "avg_5yr_cyclist",
            "avg_5yr_motorist")
RATE_COLS = ("avg_per_100k_5yr", "avg_per_100k_pedestrian", "avg_per_100k_cyclist",
             "avg_per_100k_motorist")
TREND_COLS = ("trend_pct_change", "trend_pct_change_pedestrian",
              "trend_pct_change_cyclist", "trend_pct_change_motorist")
STAT_COLS = AVG_COLS + RATE_COLS + TREND_COLS


def year_windows(crashes: DataFrame, n_years: int = 10, window: int = 5) -> DataFrame:
    """O1: the ``n_years`` latest distinct years, flagged recent / previous.

    Recent = latest ``window`` of them, previous = earliest ``window`` (they
    overlap when fewer than 2*window years exist).  The result has at most
    ``n_years`` rows, so the un-partitioned windows below and a later
    broadcast of it are bounded regardless of data size.
    """
    ten = crashes.select("year").distinct().orderBy(F.desc("year")).limit(n_years)
    return (ten
            .withColumn("is_recent", F.row_number().over(Window.orderBy(F.desc("year"))) <= window)
            .withColumn("is_previous", F.row_number().over(Window.orderBy("year")) <= window))


def city_annual(crashes: DataFrame, years: DataFrame) -> DataFrame:
    """A3: per (state, place, year) sums over the window years, place known.

    The year restriction (J8) is resolved first: the window holds at most
    ``n_years`` values, read on the driver and applied as ``year IN (…)``
    before aggregating, which Spark turns into a partition filter on a
    year-partitioned crash table (only the window's year folders are read).
    """
    window_years = sorted(int(r["year"]) for r in years.select("year").collect())
    c = crashes.filter(F.col("place_fips").isNotNull() & F.col("year").isin(window_years))
    return (c.groupBy(F.col("state").alias("state_fips"), "place_fips", "year")
            .agg(F.sum("total_fatalities").alias("fatalities"),
                 F.sum("pedestrian_fatalities").alias("ped_fatalities"),
                 F.sum("cyclist_fatalities").alias("cyc_fatalities"),
                 F.sum(F.col("motorist_fatalities") + F.coalesce("other_fatalities", F.lit(0)))
                  .alias("mot_fatalities")))


def window_sums(annual: DataFrame, years: DataFrame, fill_years: bool = False) -> DataFrame:
    """Per city: sum and count of non-null yearly values, recent and previous.

    ``fill_years=True`` (SURVEY §8 Q4 option): a window year without crashes
    counts as a zero year, so the divisor is the number of window years, not
    the number of years with a crash row.
    """
    a = annual.join(F.broadcast(years), "year", "inner")
    aggs = []
    for suffix, col in METRICS:
        tag = suffix or "all"
        for flag, name in (("is_recent", "rec"), ("is_previous", "prev")):
            v = F.when(F.col(flag), F.col(col))
            aggs += [F.sum(v).cast("long").alias(f"s_{name}_{tag}"),
                     F.count(v).cast("long").alias(f"n_{name}_{tag}")]
    sums = a.groupBy(*CITY_KEY).agg(*aggs)
    if not fill_years:
        return sums
    # window sizes: two numbers from the <= 10-row year dimension
    sizes = years.agg(F.count_if("is_recent").alias("nr"),
                      F.count_if("is_previous").alias("np")).first()
    for suffix, _ in METRICS:
        tag = suffix or "all"
        sums = (sums.withColumn(f"n_rec_{tag}", F.lit(int(sizes["nr"])).cast("long"))
                .withColumn(f"n_prev_{tag}", F.lit(int(sizes["np"])).cast("long"))
                .withColumn(f"s_rec_{tag}", F.coalesce(f"s_rec_{tag}", F.lit(0).cast("long")))
                .withColumn(f"s_prev_{tag}", F.coalesce(f"s_prev_{tag}", F.lit(0).cast("long"))))
    return sums


def city_rates(sums: DataFrame, population: DataFrame) -> DataFrame:
    """A4–A7 + J5: averages, per-100k rates and trends for cities with
    population > 0 (inner join, like the source's UPDATE … FROM)."""
    pop = population.select(*CITY_KEY, "population").filter(F.col("population") > 0)
    j = sums.join(pop, list(CITY_KEY), "inner")
    out = [F.col(c) for c in CITY_KEY]
    for (suffix, _), avg_c, rate_c, trend_c in zip(METRICS, AVG_COLS, RATE_COLS, TREND_COLS):
        tag = suffix or "all"
        s_rec, n_rec = f"s_rec_{tag}", f"n_rec_{tag}"
        s_prev, n_prev = f"s_prev_{tag}", f"n_prev_{tag}"
        has_rec = F.col(n_rec) > 0
        out.append(F.when(has_rec, ratio_half_up(s_rec, n_rec, 2)).alias(avg_c))
        out.append(F.when(has_rec, ratio_half_up(
            f"CAST({s_rec} AS BIGINT) * 100000", f"CAST(population AS BIGINT) * {n_rec}", 2))
            .alias(rate_c))
        # trend = 100 * (cur - prev) / prev from unrounded rates; population
        # cancels: with a = s_rec*n_prev and b = s_prev*n_rec, 100*(a-b)/b.
        a = f"({s_rec} * {n_prev})"
        b = f"({s_prev} * {n_rec})"
        prev_pos = has_rec & (F.col(n_prev) > 0) & (F.col(s_prev) > 0)
        out.append(F.when(prev_pos, ratio_half_up(f"(100 * ({a} - {b}))", b, 1)).alias(trend_c))
    return j.select(*out)


def eligible(places: DataFrame, min_population: int = 100000) -> DataFrame:
    """Places with population >= min or pledged."""
    return places.filter((F.col("population") >= min_population)
                         | F.coalesce(F.col("is_pledged"), F.lit(False)))


def city_stats(crashes: DataFrame, places: DataFrame, min_population: int = 100000,
               n_years: int = 10, window: int = 5, fill_years: bool = False) -> DataFrame:
    """The city_stats table: every place with its 12 metrics.

    Cities without computed stats that are eligible get zeros for the four
    averages and four rates (A8); trends stay null.
    """
    years = year_windows(crashes, n_years, window)
    rates = city_rates(window_sums(city_annual(crashes, years), years, fill_years), places)
    j = places.join(rates, list(CITY_KEY), "left")
    elig = (F.col("population") >= min_population) | F.coalesce(F.col("is_pledged"), F.lit(False))
    j = j.withColumn("_fill", elig & F.col("avg_per_100k_5yr").isNull())
    for c in AVG_COLS + RATE_COLS:
        j = j.withColumn(c, F.when(F.col("_fill"), F.lit(0.0)).otherwise(F.col(c)))
    return j.drop("_fill")
