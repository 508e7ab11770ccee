"""Normalisation column expressions.

The source parsed every CSV row in Python; here each rule is a native column
expression, so a whole file is normalised inside one whole-stage-codegen
projection.  Inputs are the raw *strings* of the scan (Spark's CSV reader
gives null for a blank cell; callers that must tell "blank" from "column
absent" pass the per-era ``has_*`` flags, SURVEY §8 Q22).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadstats.functions import dims
from roadstats.functions.exprs import zfill

# Text accepted by an integer parse (optional sign, digits, surrounding
# whitespace) and by a float parse (decimal / exponent / inf / nan).
INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_TEXT = (r"(?i)^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?"
              r"|inf|infinity|nan)$")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading/trailing whitespace of any kind (not only spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def int_text(c: Column | str, type_: str = "int") -> Column:
    """Integer value of a text cell, null unless the whole cell is an integer."""
    s = _c(c)
    return F.when(s.rlike(INT_TEXT), F.trim(s).try_cast(type_))


def dms_to_degrees(v: Column) -> Column:
    """Packed DDMMSSSS (seconds in hundredths) -> decimal degrees, sign dropped."""
    a = F.abs(v)
    deg = F.floor(a / F.lit(1_000_000))
    minutes = F.floor(a / F.lit(10_000)) % F.lit(100)
    seconds = (a % F.lit(10_000)).cast("double") / F.lit(100.0)
    return deg.cast("double") + minutes.cast("double") / F.lit(60.0) + seconds / F.lit(3600.0)


def coordinates(lat_raw: Column | str, lon_raw: Column | str,
                west_positive: bool = False) -> tuple[Column, Column, Column]:
    """(lon, lat, coord_status) from the raw latitude/longitude text.

    * blank on either axis -> null pair (``blank``)
    * "0" / "9999" on either axis -> null pair (``sentinel``)
    * neither value has "." -> both are packed DDMMSSSS; ``abs`` drops the
      sign, as in the source (``west_positive=True`` restores the western
      hemisphere, SURVEY §8 Q1)
    * otherwise both are decimal degrees
    * unparsable -> null pair; outside ±90 / ±180 (NaN included) -> null pair
    """
    la0, lo0 = _c(lat_raw), _c(lon_raw)
    blank = la0.isNull() | lo0.isNull() | (la0 == "") | (lo0 == "")
    la, lo = strip(la0), strip(lo0)
    sentinel = la.isin(*dims.SENTINEL_COORDS) | lo.isin(*dims.SENTINEL_COORDS)
    is_dms = ~la.contains(".") & ~lo.contains(".")
    dms_ok = la.rlike(r"^[+-]?[0-9]+$") & lo.rlike(r"^[+-]?[0-9]+$")
    dec_ok = la.rlike(FLOAT_TEXT) & lo.rlike(FLOAT_TEXT)
    lat_dms = dms_to_degrees(la.try_cast("bigint"))
    lon_dms = dms_to_degrees(lo.try_cast("bigint"))
    if west_positive:
        lon_dms = -lon_dms
    lat = F.when(is_dms, lat_dms).otherwise(la.try_cast("double"))
    lon = F.when(is_dms, lon_dms).otherwise(lo.try_cast("double"))
    parsed = F.when(is_dms, dms_ok & lat_dms.isNotNull() & lon_dms.isNotNull()) \
        .otherwise(dec_ok & lat.isNotNull() & lon.isNotNull())
    # NaN sorts above every number in Spark, so `between` rejects it.
    in_range = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    status = (F.when(blank, F.lit("blank"))
              .when(sentinel, F.lit("sentinel"))
              .when(~F.coalesce(parsed, F.lit(False)), F.lit("unparsable"))
              .when(~F.coalesce(in_range, F.lit(False)), F.lit("out_of_range"))
              .when(is_dms, F.lit("ok_dms"))
              .otherwise(F.lit("ok_decimal")))
    ok = status.startswith("ok_")
    return F.when(ok, lon), F.when(ok, lat), status


def crash_date(year_raw: Column | str, month_raw: Column | str,
               day_raw: Column | str) -> Column:
    """Date from YEAR/MONTH/DAY text.

    Any part missing, non-integer or <= 0 -> null; years 24..99 get +1900
    (1..23 stay as they are, SURVEY §8 Q2); impossible dates -> null.
    """
    y, m, d = int_text(year_raw), int_text(month_raw), int_text(day_raw)
    y = F.when((y > 23) & (y < 100), y + 1900).otherwise(y)
    valid = (y > 0) & (m > 0) & (d > 0)
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(valid, F.try_to_date(text, "yyyy-MM-dd"))


def route_code(route_raw: Column | str, has_route: Column) -> Column:
    """N3 input: the ROUTE code; 9 when the column is absent, null if unparsable."""
    return F.when(has_route, int_text(route_raw)).otherwise(F.lit(9))


def padded_code(c: Column | str, width: int) -> Column:
    """Zero-fill a code to ``width`` (a blank cell becomes all zeros)."""
    return zfill(F.coalesce(_c(c), F.lit("")), width)


def city_name(code: Column, name_raw: Column | str, has_name: Column,
              lookup: Column) -> Column:
    """FARS city name.

    code "0000" or >= "9000" (string order), or the name "Not Applicable"
    -> "Unincorporated"; a present name column is used as is (a blank cell
    stays blank); an absent column falls back to ``lookup`` (the city-code
    table) and then "ERROR".
    """
    own = F.when(has_name, F.coalesce(_c(name_raw), F.lit("")))
    unincorporated = (code == "0000") | (code >= "9000") | \
        F.coalesce(own == "Not Applicable", F.lit(False))
    return (F.when(unincorporated, F.lit("Unincorporated"))
            .when(has_name, own)
            .otherwise(F.coalesce(lookup, F.lit("ERROR"))))


def population_place(name_raw: Column | str) -> tuple[Column, Column]:
    """("Juneau city and borough, Alaska") -> ("Juneau", "Alaska").

    City = text before the first comma with one legal suffix removed when
    it ends that text (case-insensitive), then stripped; state = text after
    the last comma, stripped.
    """
    s = _c(name_raw)
    head = F.split(s, ",", 2).getItem(0)
    alts = "|".join(dims.PLACE_SUFFIXES)
    city = strip(F.regexp_replace(head, rf"(?i)\s+({alts})$", ""))
    state = strip(F.element_at(F.split(s, ","), -1))
    return city, state
