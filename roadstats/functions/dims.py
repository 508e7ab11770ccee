"""Constant dimensions shipped as small DataFrames.

Each is a fixed list of at most a few dozen rows, so joining it with
``broadcast`` is safe at any data scale: its size does not grow with the
crash, person or place tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the source dataset conventions exactly.
# ---------------------------------------------------------------------------

# Route code -> road label (code 13 keeps the published spelling "Bureaue").
ROUTE_LABELS = [
    (1, "Interstate"),
    (2, "US Highway"),
    (3, "State Highway"),
    (4, "County Road"),
    (5, "Local Township"),
    (6, "Municipal Street"),
    (7, "Frontage Road"),
    (8, "Other"),
    (9, "Unknown"),
    (10, "Parkway"),
    (11, "Off-Interstate Business"),
    (12, "Secondary Route"),
    (13, "Bureaue of Indian Affairs"),
    (95, "Other"),
]

# Official place name -> short display name.
DISPLAY_NAMES = [
    ("Athens-Clarke County unified government (balance)", "Athens"),
    ("Augusta-Richmond County consolidated government (balance)", "Augusta"),
    ("Louisville/Jefferson County metro government (balance)", "Louisville"),
    ("Lexington-Fayette urban county", "Lexington"),
    ("Nashville-Davidson metropolitan government (balance)", "Nashville"),
    ("Macon-Bibb County", "Macon"),
    ("Urban Honolulu", "Honolulu"),
    ("Indianapolis city (balance)", "Indianapolis"),
    ("Boise City", "Boise"),
    ("Milford City (balance)", "Milford City"),
]

# State FIPS code -> state name (50 states + DC, no territories).
STATE_NAMES = [
    ("01", "Alabama"), ("02", "Alaska"), ("04", "Arizona"), ("05", "Arkansas"),
    ("06", "California"), ("08", "Colorado"), ("09", "Connecticut"),
    ("10", "Delaware"), ("11", "District of Columbia"), ("12", "Florida"),
    ("13", "Georgia"), ("15", "Hawaii"), ("16", "Idaho"), ("17", "Illinois"),
    ("18", "Indiana"), ("19", "Iowa"), ("20", "Kansas"), ("21", "Kentucky"),
    ("22", "Louisiana"), ("23", "Maine"), ("24", "Maryland"),
    ("25", "Massachusetts"), ("26", "Michigan"), ("27", "Minnesota"),
    ("28", "Mississippi"), ("29", "Missouri"), ("30", "Montana"),
    ("31", "Nebraska"), ("32", "Nevada"), ("33", "New Hampshire"),
    ("34", "New Jersey"), ("35", "New Mexico"), ("36", "New York"),
    ("37", "North Carolina"), ("38", "North Dakota"), ("39", "Ohio"),
    ("40", "Oklahoma"), ("41", "Oregon"), ("42", "Pennsylvania"),
    ("44", "Rhode Island"), ("45", "South Carolina"), ("46", "South Dakota"),
    ("47", "Tennessee"), ("48", "Texas"), ("49", "Utah"), ("50", "Vermont"),
    ("51", "Virginia"), ("53", "Washington"), ("54", "West Virginia"),
    ("55", "Wisconsin"), ("56", "Wyoming"),
]

# Place name -> override (lon, lat) used when geocoding failed.
POINT_OVERRIDES = [
    ("Athens-Clarke County unified government (balance)", -83.375809, 33.935479),
    ("Augusta-Richmond County consolidated government (balance)", -81.968841, 33.4711351),
    ("Louisville/Jefferson County metro government (balance)", -85.754692, 38.250913),
    ("Nashville-Davidson metropolitan government (balance)", -86.78211, 36.16129),
    ("Indianapolis city (balance)", -86.15802, 39.76847),
    ("Florence-Graham", -118.24336, 33.96733),
    ("Macon-Bibb County", -83.62853, 32.83435),
    ("Urban Honolulu", -157.8592, 21.30899),
    ("Methuen Town", -71.19088, 42.72607),
    ("Weymouth Town", -70.9369, 42.21747),
    ("Tonawanda Town", -78.87973, 43.01837),
]

# Pledged-city list spelling fixes: raw city -> (city, state override or None).
PLEDGE_NAME_FIXES = [
    ("Washington DC", "Washington", "District of Columbia"),
    ("Ft. Lauderdale", "Fort Lauderdale", None),
    ("Macon", "Macon-Bibb County", None),
    ("New York City", "New York", None),
]

# Population place-name legal suffixes stripped at the end (case-insensitive).
PLACE_SUFFIXES = [
    "city and borough", "consolidated government", "metropolitan government",
    "unified government", "urban county", "municipality", "borough", "village",
    "town", "city", "CDP",
]

# Fixed value: places of which only the largest part counts (state, place).
LARGEST_PART_PLACES = (("06", "67000"),)

# Consolidated city-county government: target place and its member places.
CONSOLIDATED_TARGET = ("21", "48006")
CONSOLIDATED_POINT_SOURCE = ("21", "48000")
CONSOLIDATED_MEMBERS = [
    "48006", "48000", "40222", "70284", "48558", "01504", "51978", "84486",
    "02656", "28342", "31348", "56550", "66486", "81372", "05392", "22204",
    "37576", "37630", "42598", "48648", "80913", "81624", "05068", "05464",
    "10198", "22474", "38814", "50412", "52842", "56928", "69384", "74082",
    "32523", "38170", "38818", "07858", "31402", "39304", "56730", "57658",
    "65208", "65766", "84576",
]

# Person type -> victim bucket used by the subtype derivation (A1).
VICTIM_BUCKETS = [
    ("motorist", [1, 2, 3, 9]),
    ("pedestrian", [5, 10]),
    ("cyclist", [6, 7]),
    ("other", [4, 8, 11, 12, 13, 19, 99]),
]

# Person type -> role used by the person-semantics view (N13); any other
# code is 'Unknown'.  Role -> mode follows below.
PERSON_ROLES = [
    ("Driver", [1]),
    ("Passenger", [2, 3, 9]),
    ("Pedestrian", [5, 8, 10, 11, 12, 13]),
    ("Bicyclist", [6]),
    ("Other Cyclist", [7]),
    ("Non-motorist Other", [4]),
]
ROLE_MODES = [
    ("Driver", "Motorist"),
    ("Passenger", "Motorist"),
    ("Pedestrian", "Pedestrian"),
    ("Bicyclist", "Cyclist"),
    ("Other Cyclist", "Cyclist"),
    ("Non-motorist Other", "Other"),
]

FATAL_SEVERITY = 4
SENTINEL_COORDS = ["0", "9999"]

# ---------------------------------------------------------------------------
# DataFrame builders (all tiny, broadcast-safe).
# ---------------------------------------------------------------------------


def route_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTE_LABELS, "route_code int, road_label string")


def state_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATE_NAMES, "state_fips string, state_name string")


def display_name_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DISPLAY_NAMES, "place_name string, display_name string")


def point_override_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        POINT_OVERRIDES, "place_name string, override_lon double, override_lat double")


def pledge_fix_dim(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("raw_city", T.StringType()),
        T.StructField("fixed_city", T.StringType()),
        T.StructField("fixed_state", T.StringType()),
    ])
    return spark.createDataFrame(PLEDGE_NAME_FIXES, schema)


def victim_bucket_dim(spark: SparkSession) -> DataFrame:
    rows = [(code, bucket) for bucket, codes in VICTIM_BUCKETS for code in codes]
    return spark.createDataFrame(rows, "person_type int, victim_bucket string")


def consolidated_member_dim(spark: SparkSession) -> DataFrame:
    st, target = CONSOLIDATED_TARGET
    rows = [(st, target, st, m) for m in CONSOLIDATED_MEMBERS]
    return spark.createDataFrame(
        rows, "target_state string, target_place string, state_fips string, place_fips string")


def consolidated_point_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(*CONSOLIDATED_TARGET, *CONSOLIDATED_POINT_SOURCE)],
        "target_state string, target_place string, state_fips string, place_fips string")
