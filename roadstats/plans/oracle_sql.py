"""Independent DuckDB SQL for each registered query.

The stand-in entities are re-derived here in plain SQL from the same driver
tables (``region nation customer … orders lineitem``), so a query's Spark
plan and its oracle share nothing but the rules.  Window functions in the
oracles are ordinary SQL windows (DuckDB is single node) — the Spark side
uses the distributed operators.
"""

from __future__ import annotations

import math


def zf(expr: str, n: int) -> str:
    """Zero-fill without truncation (SQL text)."""
    s = f"CAST({expr} AS VARCHAR)"
    return f"(CASE WHEN length({s}) < {n} THEN lpad({s}, {n}, '0') ELSE {s} END)"


def hu(num: str, den: str, k: int) -> str:
    """Exact half-away-from-zero rounding of num/den to k decimals (double)."""
    sc = 10 ** k
    return (f"(CAST(CAST(sign({num}) AS BIGINT) * ((2 * abs({num}) * {sc} + ({den})) "
            f"// (2 * ({den}))) AS DOUBLE) / CAST({sc} AS DOUBLE))")


PERSON_TYPE_LIST = "[1, 2, 3, 9, 5, 10, 6, 7, 4, 8, 11, 12, 13, 19, 99, 88]"
STATES = ("('01','Alabama'),('02','Alaska'),('04','Arizona'),('05','Arkansas'),"
          "('06','California'),('08','Colorado'),('09','Connecticut'),('10','Delaware'),"
          "('11','District of Columbia'),('12','Florida'),('13','Georgia'),('15','Hawaii'),"
          "('16','Idaho'),('17','Illinois'),('18','Indiana'),('19','Iowa'),('20','Kansas'),"
          "('21','Kentucky'),('22','Louisiana'),('23','Maine'),('24','Maryland'),"
          "('25','Massachusetts'),('26','Michigan'),('27','Minnesota'),('28','Mississippi'),"
          "('29','Missouri'),('30','Montana'),('31','Nebraska'),('32','Nevada'),"
          "('33','New Hampshire'),('34','New Jersey'),('35','New Mexico'),('36','New York'),"
          "('37','North Carolina'),('38','North Dakota'),('39','Ohio'),('40','Oklahoma'),"
          "('41','Oregon'),('42','Pennsylvania'),('44','Rhode Island'),"
          "('45','South Carolina'),('46','South Dakota'),('47','Tennessee'),('48','Texas'),"
          "('49','Utah'),('50','Vermont'),('51','Virginia'),('53','Washington'),"
          "('54','West Virginia'),('55','Wisconsin'),('56','Wyoming')")
ROUTES = ("(1,'Interstate'),(2,'US Highway'),(3,'State Highway'),(4,'County Road'),"
          "(5,'Local Township'),(6,'Municipal Street'),(7,'Frontage Road'),(8,'Other'),"
          "(9,'Unknown'),(10,'Parkway'),(11,'Off-Interstate Business'),"
          "(12,'Secondary Route'),(13,'Bureaue of Indian Affairs'),(95,'Other')")

_LON = ("CASE WHEN o_orderkey % 17 <> 0 THEN CAST(-125 AS DOUBLE) + "
        "CAST((o_orderkey * 7919) % 58000 AS DOUBLE) / CAST(1000 AS DOUBLE) END")
_LAT = ("CASE WHEN o_orderkey % 17 <> 0 THEN CAST(24.5 AS DOUBLE) + "
        "CAST((o_orderkey * 104729) % 24500 AS DOUBLE) / CAST(1000 AS DOUBLE) END")

CTES: dict[str, str] = {}
CTES["sp_states"] = f"SELECT * FROM (VALUES {STATES}) t(state_fips, state_name)"
CTES["sp_routes"] = f"SELECT * FROM (VALUES {ROUTES}) t(route_code, road_label)"
CTES["sp_places"] = f"""
    SELECT {zf('c_nationkey', 2)} AS state_fips, {zf('c_custkey', 5)} AS place_fips,
           c_name AS place_name,
           CAST(floor(c_acctbal * CAST(20 AS DOUBLE)) AS INTEGER) AS population,
           c_mktsegment = 'BUILDING' AS is_pledged
    FROM customer"""
CTES["sp_persons_raw"] = f"""
    SELECT l_orderkey AS st_case, CAST(l_linenumber AS INTEGER) AS vehicle_number,
           CAST(l_suppkey AS INTEGER) AS person_number,
           ({PERSON_TYPE_LIST})[CAST(l_partkey % 16 AS INTEGER) + 1] AS person_type,
           CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 3 ELSE 0 END AS injury_severity,
           l_partkey, l_extendedprice, l_quantity, l_shipdate
    FROM lineitem"""
CTES["sp_persons"] = """
    SELECT st_case, vehicle_number, person_number, person_type, injury_severity
    FROM (SELECT *, row_number() OVER (
                 PARTITION BY st_case, vehicle_number, person_number
                 ORDER BY l_partkey, l_extendedprice, l_quantity, l_shipdate,
                          person_type, injury_severity) AS rn
          FROM sp_persons_raw) t
    WHERE rn = 1"""
CTES["sp_subtypes"] = """
    SELECT st_case,
      count(*) FILTER (WHERE injury_severity = 4 AND person_type IN (1, 2, 3, 9)) AS motorist_fatalities,
      count(*) FILTER (WHERE injury_severity = 4 AND person_type IN (5, 10)) AS pedestrian_fatalities,
      count(*) FILTER (WHERE injury_severity = 4 AND person_type IN (6, 7)) AS cyclist_fatalities,
      count(*) FILTER (WHERE injury_severity = 4 AND person_type IN (4, 8, 11, 12, 13, 19, 99)) AS other_fatalities,
      count(*) FILTER (WHERE injury_severity = 4) AS fatal_persons
    FROM sp_persons GROUP BY st_case"""
CTES["sp_crashes"] = f"""
    SELECT o_orderkey AS st_case, CAST(year(o_orderdate) AS INTEGER) AS year,
           CAST(o_orderdate AS DATE) AS crash_date,
           {zf('c_nationkey', 2)} AS state,
           coalesce(s.state_name, 'ERROR') AS state_name,
           {zf('o_custkey % 1000', 3)} AS county,
           {zf('c_nationkey * 37', 4)} AS city,
           CASE WHEN {zf('c_nationkey * 37', 4)} = '0000'
                  OR {zf('c_nationkey * 37', 4)} >= '9000' THEN 'Unincorporated'
                ELSE coalesce(n.n_name, 'ERROR') END AS fars_city_name,
           CAST(NULL AS VARCHAR) AS fips_city_name,
           CASE WHEN o_orderkey % 10 = 0 OR o_custkey % 37 = 0 THEN NULL
                ELSE {zf('o_custkey', 5)} END AS place_fips,
           CAST(o_orderkey % 15 + 1 AS INTEGER) AS route_code,
           coalesce(r.road_label, 'Unknown') AS road_label,
           {_LON} AS lon, {_LAT} AS lat,
           CAST(coalesce(st.fatal_persons, 0) AS INTEGER) AS total_fatalities,
           CAST(coalesce(st.motorist_fatalities, 0) AS INTEGER) AS motorist_fatalities,
           CAST(coalesce(st.pedestrian_fatalities, 0) AS INTEGER) AS pedestrian_fatalities,
           CAST(coalesce(st.cyclist_fatalities, 0) AS INTEGER) AS cyclist_fatalities,
           CAST(coalesce(st.other_fatalities, 0) AS INTEGER) AS other_fatalities
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN sp_states s ON s.state_fips = {zf('c_nationkey', 2)}
    LEFT JOIN sp_routes r ON r.route_code = o_orderkey % 15 + 1
    LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN sp_subtypes st ON st.st_case = o.o_orderkey"""
CTES["sp_years"] = """
    SELECT year,
           row_number() OVER (ORDER BY year DESC) <= 5 AS is_recent,
           row_number() OVER (ORDER BY year) <= 5 AS is_previous
    FROM (SELECT DISTINCT year FROM sp_crashes ORDER BY year DESC LIMIT 10) t"""
CTES["sp_annual"] = """
    SELECT state AS state_fips, place_fips, year,
           sum(total_fatalities) AS fatalities,
           sum(pedestrian_fatalities) AS ped_fatalities,
           sum(cyclist_fatalities) AS cyc_fatalities,
           sum(motorist_fatalities + coalesce(other_fatalities, 0)) AS mot_fatalities
    FROM sp_crashes
    WHERE place_fips IS NOT NULL AND year IN (SELECT year FROM sp_years)
    GROUP BY state, place_fips, year"""


def _sums() -> str:
    parts = []
    for tag, col in (("all", "fatalities"), ("pedestrian", "ped_fatalities"),
                     ("cyclist", "cyc_fatalities"), ("motorist", "mot_fatalities")):
        for flag, name in (("is_recent", "rec"), ("is_previous", "prev")):
            parts.append(f"CAST(sum({col}) FILTER (WHERE {flag}) AS BIGINT) AS s_{name}_{tag}")
            parts.append(f"count({col}) FILTER (WHERE {flag}) AS n_{name}_{tag}")
    return ("SELECT state_fips, place_fips, " + ", ".join(parts) +
            " FROM sp_annual JOIN sp_years USING (year) GROUP BY state_fips, place_fips")


CTES["sp_sums"] = _sums()


def _rates() -> str:
    cols = []
    names = (("all", "avg_fatalities_5yr", "avg_per_100k_5yr", "trend_pct_change"),
             ("pedestrian", "avg_5yr_pedestrian", "avg_per_100k_pedestrian",
              "trend_pct_change_pedestrian"),
             ("cyclist", "avg_5yr_cyclist", "avg_per_100k_cyclist", "trend_pct_change_cyclist"),
             ("motorist", "avg_5yr_motorist", "avg_per_100k_motorist",
              "trend_pct_change_motorist"))
    for tag, avg_c, rate_c, trend_c in names:
        sr, nr, sp, np_ = f"s_rec_{tag}", f"n_rec_{tag}", f"s_prev_{tag}", f"n_prev_{tag}"
        cols.append(f"CASE WHEN {nr} > 0 THEN {hu(sr, nr, 2)} END AS {avg_c}")
        cols.append(f"CASE WHEN {nr} > 0 THEN "
                    f"{hu(f'({sr} * 100000)', f'(CAST(p.population AS BIGINT) * {nr})', 2)} "
                    f"END AS {rate_c}")
        a, b = f"({sr} * {np_})", f"({sp} * {nr})"
        cols.append(f"CASE WHEN {nr} > 0 AND {np_} > 0 AND {sp} > 0 THEN "
                    f"{hu(f'(100 * ({a} - {b}))', b, 1)} END AS {trend_c}")
    return ("SELECT s.state_fips, s.place_fips, " + ", ".join(cols) +
            " FROM sp_sums s JOIN sp_places p ON p.state_fips = s.state_fips "
            "AND p.place_fips = s.place_fips AND p.population > 0")


CTES["sp_rates"] = _rates()

_FILL = ("avg_fatalities_5yr", "avg_5yr_pedestrian", "avg_5yr_cyclist", "avg_5yr_motorist",
         "avg_per_100k_5yr", "avg_per_100k_pedestrian", "avg_per_100k_cyclist",
         "avg_per_100k_motorist")
_TRENDS = ("trend_pct_change", "trend_pct_change_pedestrian", "trend_pct_change_cyclist",
           "trend_pct_change_motorist")
CTES["sp_city_stats"] = (
    "SELECT p.state_fips, p.place_fips, p.place_name, p.population, p.is_pledged, "
    + ", ".join(f"CASE WHEN (p.population >= 100000 OR p.is_pledged) "
                f"AND r.avg_per_100k_5yr IS NULL THEN CAST(0 AS DOUBLE) ELSE r.{c} END AS {c}"
                for c in _FILL)
    + ", " + ", ".join(f"r.{c}" for c in _TRENDS)
    + " FROM sp_places p LEFT JOIN sp_rates r ON p.state_fips = r.state_fips "
      "AND p.place_fips = r.place_fips")


def with_ctes(body: str) -> str:
    """Prefix ``body`` with every stand-in CTE it (transitively) references."""
    names = list(CTES)
    needed: set[str] = set()
    frontier = [n for n in names if n in body]
    while frontier:
        n = frontier.pop()
        if n in needed:
            continue
        needed.add(n)
        frontier += [m for m in names if m != n and m in CTES[n] and m not in needed]
    ordered = [n for n in names if n in needed]
    if not ordered:
        return body
    head = "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return head + ",\n" + stripped[5:]
    return head + "\n" + body


def _rank_sql() -> str:
    bases = {"avg_per_100k_5yr": "per_100k", "avg_per_100k_pedestrian": "per_100k_pedestrian",
             "avg_per_100k_cyclist": "per_100k_cyclist",
             "avg_per_100k_motorist": "per_100k_motorist", "trend_pct_change": "trend",
             "trend_pct_change_pedestrian": "trend_pedestrian",
             "trend_pct_change_cyclist": "trend_cyclist",
             "trend_pct_change_motorist": "trend_motorist"}
    inner, outer = [], []
    for m, b in bases.items():
        inner.append(f"rank() OVER (ORDER BY {m} ASC NULLS LAST, population DESC) AS r1_{b}")
        inner.append(f"rank() OVER (ORDER BY {m} ASC NULLS LAST) AS r2_{b}")
        inner.append(f"rank() OVER (PARTITION BY is_pledged ORDER BY {m} ASC NULLS LAST) AS r3_{b}")
    for m, b in bases.items():
        outer.append(f"CASE WHEN {m} IS NOT NULL THEN r1_{b} END AS rank_{b}_all")
    for m, b in bases.items():
        outer.append(f"CASE WHEN {m} IS NOT NULL THEN (CASE WHEN n_all <= 1 THEN 0.0 ELSE "
                     f"{hu(f'(100 * (r2_{b} - 1))', '(n_all - 1)', 2)} END) END AS pct_{b}_all")
    for m, b in bases.items():
        outer.append(f"CASE WHEN is_pledged THEN r3_{b} END AS rank_{b}_vz")
    for m, b in bases.items():
        outer.append(f"CASE WHEN is_pledged AND {m} IS NOT NULL THEN (CASE WHEN n_vz <= 1 "
                     f"THEN 0.0 ELSE {hu(f'(100 * (r3_{b} - 1))', '(n_vz - 1)', 2)} END) "
                     f"END AS pct_{b}_vz")
    return ("SELECT e.*, " + ", ".join(inner) + ", count(*) OVER () AS n_all, "
            "count(*) OVER (PARTITION BY is_pledged) AS n_vz FROM sp_eligible e", outer)


CTES["sp_eligible"] = ("SELECT * FROM sp_city_stats WHERE population >= 100000 OR is_pledged")
_rk_inner, _rk_outer = _rank_sql()
CTES["sp_ranked"] = "SELECT *, " + ", ".join(_rk_outer) + f" FROM ({_rk_inner}) t"

CTES["sp_crash_keys"] = "SELECT o_orderkey AS st_case FROM orders WHERE o_orderkey % 23 <> 0"
CTES["sp_person_sem"] = """
    SELECT p.*, c.year, c.crash_date,
           coalesce(p.injury_severity = 4, false) AS is_fatal_person,
           CASE WHEN person_type = 1 THEN 'Driver'
                WHEN person_type IN (2, 3, 9) THEN 'Passenger'
                WHEN person_type IN (5, 8, 10, 11, 12, 13) THEN 'Pedestrian'
                WHEN person_type = 6 THEN 'Bicyclist'
                WHEN person_type = 7 THEN 'Other Cyclist'
                WHEN person_type = 4 THEN 'Non-motorist Other'
                ELSE 'Unknown' END AS person_role
    FROM sp_persons p JOIN sp_crashes c ON p.st_case = c.st_case"""
CTES["sp_person_modes"] = """
    SELECT *, CASE WHEN person_role IN ('Driver', 'Passenger') THEN 'Motorist'
                   WHEN person_role = 'Pedestrian' THEN 'Pedestrian'
                   WHEN person_role IN ('Bicyclist', 'Other Cyclist') THEN 'Cyclist'
                   WHEN person_role = 'Non-motorist Other' THEN 'Other'
                   ELSE 'Unknown' END AS person_mode
    FROM sp_person_sem"""
CTES["sp_elig_cities"] = """
    SELECT state_fips, place_fips FROM sp_places WHERE population >= 100000 OR is_pledged"""
CTES["sp_export_points"] = """
    SELECT e.state_fips, e.place_fips, c.lon, c.lat, c.st_case, c.year, c.crash_date,
           c.state_name, c.fars_city_name, c.fips_city_name, c.road_label,
           c.total_fatalities, c.motorist_fatalities, c.pedestrian_fatalities,
           c.cyclist_fatalities, c.other_fatalities
    FROM sp_crashes c JOIN sp_elig_cities e ON c.state = e.state_fips AND c.place_fips = e.place_fips
    WHERE c.year >= 2001 AND c.lon IS NOT NULL AND c.lat IS NOT NULL"""
CTES["sp_annual_city"] = """
    SELECT e.state_fips, e.place_fips, c.year,
           CAST(sum(total_fatalities) AS BIGINT) AS total_fatalities,
           CAST(sum(motorist_fatalities) AS BIGINT) AS motorist_fatalities,
           CAST(sum(pedestrian_fatalities) AS BIGINT) AS pedestrian_fatalities,
           CAST(sum(cyclist_fatalities) AS BIGINT) AS cyclist_fatalities,
           CAST(sum(other_fatalities) AS BIGINT) AS other_fatalities
    FROM sp_crashes c JOIN sp_elig_cities e ON c.state = e.state_fips AND c.place_fips = e.place_fips
    GROUP BY e.state_fips, e.place_fips, c.year"""

_TEMPLATE = "(0, 0.05, 0.05), (1, 0.95, 0.05), (2, 0.95, 0.45), (3, 0.45, 0.45), (4, 0.45, 0.95), (5, 0.05, 0.95)"
CTES["sp_vertices"] = f"""
    SELECT {zf('n_nationkey', 2)} AS state_fips, {zf('n_nationkey', 5)} AS place_fips,
           n_regionkey, 0 AS part, 0 AS ring, v.seq,
           CAST(-125 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST(11.6 AS DOUBLE)
             + CAST(v.rx AS DOUBLE) * CAST(11.6 AS DOUBLE) + CAST(0.00037 AS DOUBLE) AS x,
           CAST(24.5 AS DOUBLE) + CAST(n_nationkey // 5 AS DOUBLE) * CAST(4.9 AS DOUBLE)
             + CAST(v.ry AS DOUBLE) * CAST(4.9 AS DOUBLE) + CAST(0.00037 AS DOUBLE) AS y
    FROM nation, (VALUES {_TEMPLATE}) v(seq, rx, ry)"""
CTES["sp_edges"] = """
    SELECT state_fips, place_fips, n_regionkey, part, ring, seq, x AS x1, y AS y1,
           coalesce(lead(x) OVER w, first_value(x) OVER w2) AS x2,
           coalesce(lead(y) OVER w, first_value(y) OVER w2) AS y2
    FROM sp_vertices
    WINDOW w AS (PARTITION BY state_fips, place_fips, part, ring ORDER BY seq),
           w2 AS (PARTITION BY state_fips, place_fips, part, ring ORDER BY seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
CTES["sp_pip"] = """
    SELECT c.st_case, c.year, e.state_fips, e.place_fips,
           count(*) FILTER (WHERE (e.y1 > c.lat) <> (e.y2 > c.lat)
               AND e.x1 + (c.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) > c.lon) AS n,
           bool_or((e.x2 - e.x1) * (c.lat - e.y1) - (e.y2 - e.y1) * (c.lon - e.x1) = 0
               AND c.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
               AND c.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)) AS on_edge
    FROM sp_crashes c, sp_edges e
    WHERE c.lon IS NOT NULL AND c.lat IS NOT NULL
    GROUP BY c.st_case, c.year, e.state_fips, e.place_fips"""
CTES["sp_hot_points"] = f"""
    SELECT {zf('c_nationkey', 2)} AS state_fips, {zf('c_nationkey', 5)} AS place_fips,
           o_orderkey AS st_case, ((o_orderkey % 29) * (o_orderkey % 29)) % 29 AS cx,
           ((o_orderkey % 5) * 7) % 5 AS cy
    FROM orders JOIN customer ON o_custkey = c_custkey"""
CTES["sp_cell_counts"] = """
    SELECT state_fips, place_fips, cx, cy, count(*) AS crash_count,
           percent_rank() OVER (PARTITION BY state_fips, place_fips ORDER BY count(*)) AS pct_rank
    FROM sp_hot_points GROUP BY state_fips, place_fips, cx, cy"""
CTES["sp_hot"] = "SELECT * FROM sp_cell_counts WHERE pct_rank >= 0.85"


def _sq_edges(src: str, x0: str, y0: str, side: int) -> str:
    pts = [(x0, y0), (f"{x0} + {side}", y0), (f"{x0} + {side}", f"{y0} + {side}"),
           (x0, f"{y0} + {side}")]
    parts = []
    for a, b in zip(pts, pts[1:] + pts[:1]):
        parts.append(f"SELECT state_fips, place_fips, {a[0]} AS x1, {a[1]} AS y1, "
                     f"{b[0]} AS x2, {b[1]} AS y2 FROM {src}")
    return " UNION ALL ".join(parts)


def _dissolved(edges_sql: str) -> str:
    return f"""
    SELECT state_fips, place_fips, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2
    FROM ({edges_sql}) e
    GROUP BY state_fips, place_fips, least(x1, x2), least(y1, y2), greatest(x1, x2), greatest(y1, y2)
    HAVING count(*) = 1"""


CTES["sp_core_edges"] = _dissolved(_sq_edges("sp_hot", "(2 * cx - 1)", "(2 * cy - 1)", 2))
CTES["sp_sub"] = """
    SELECT DISTINCT state_fips, place_fips, sx, sy FROM sp_hot,
        LATERAL (SELECT unnest(range(2 * cx - 2, 2 * cx + 2)) AS sx) a,
        LATERAL (SELECT unnest(range(2 * cy - 2, 2 * cy + 2)) AS sy) b"""
CTES["sp_buffer_edges"] = _dissolved(_sq_edges("sp_sub", "sx", "sy", 1))

# ---------------------------------------------------------------------------
# Raw crash / person files (generator rules of sources/raw_files.py)
# ---------------------------------------------------------------------------

def _dms_sql(milli: str) -> str:
    """Packed DMS of |milli| thousandths of a degree, parsed back to degrees."""
    a = f"abs({milli})"
    cs = f"(({a} % 1000) * 360)"
    return (f"(CAST({a} // 1000 AS DOUBLE) + CAST({cs} // 6000 AS DOUBLE) / CAST(60 AS DOUBLE)"
            f" + (CAST({cs} % 6000 AS DOUBLE) / CAST(100 AS DOUBLE)) / CAST(3600 AS DOUBLE))")


CTES["sp_raw_crash"] = """
    SELECT c.*, c.st_case AS k, c.st_case % 50 AS r,
           (c.year >= 1997 AND c.year % 2 = 0) AS named,
           month(o.o_orderdate) AS mo, day(o.o_orderdate) AS dy,
           24500 + (c.st_case * 104729) % 24500 AS lat_milli,
           -125000 + (c.st_case * 7919) % 58000 AS lon_milli,
           CASE WHEN c.st_case % 211 = 0 THEN 'bad_st_case'
                WHEN c.year >= 1997 AND c.st_case % 97 = 0 THEN 'bad_route'
                WHEN c.st_case % 101 = 0 THEN 'state_too_long' END AS reason
    FROM sp_crashes c JOIN orders o ON o.o_orderkey = c.st_case"""
CTES["sp_raw_loaded"] = f"""
    SELECT st_case, year,
           CASE WHEN r IN (0, 10, 20) THEN NULL
                WHEN r = 25 AND year % 100 = 0 THEN NULL
                WHEN r = 25 AND year % 100 < 24 THEN make_date(CAST(year % 100 AS INTEGER), mo, dy)
                ELSE crash_date END AS crash_date,
           state,
           CASE WHEN named AND r = 40 THEN '' ELSE state_name END AS state_name,
           county,
           CASE WHEN named THEN 'County ' || county END AS county_name,
           CASE WHEN r = 30 THEN '9999' ELSE city END AS city,
           CASE WHEN r = 30 OR city = '0000' OR city >= '9000' THEN 'Unincorporated'
                WHEN named AND r = 35 THEN 'Unincorporated'
                WHEN named AND r = 45 THEN ''
                ELSE fars_city_name END AS fars_city_name,
           CASE WHEN year < 1997 THEN 9 ELSE route_code END AS route_code,
           CASE WHEN year < 1997 THEN 'Unknown' ELSE road_label END AS road_label,
           total_fatalities,
           CASE WHEN lat IS NULL THEN 'blank'
                WHEN k % 4 = 0 AND k % 9 = 0 THEN 'unparsable'
                WHEN k % 4 = 0 THEN 'ok_decimal'
                WHEN k % 4 = 1 AND k % 13 = 0 THEN 'out_of_range'
                WHEN k % 4 = 1 THEN 'ok_dms'
                WHEN k % 4 = 2 THEN 'sentinel'
                ELSE 'blank' END AS coord_status,
           lat_milli, lon_milli
    FROM sp_raw_crash WHERE reason IS NULL"""
CTES["sp_raw_points"] = f"""
    SELECT *,
           CASE coord_status WHEN 'ok_decimal' THEN CAST(lon_milli AS DOUBLE) / CAST(1000 AS DOUBLE)
                             WHEN 'ok_dms' THEN {_dms_sql('lon_milli')} END AS lon,
           CASE coord_status WHEN 'ok_decimal' THEN CAST(lat_milli AS DOUBLE) / CAST(1000 AS DOUBLE)
                             WHEN 'ok_dms' THEN {_dms_sql('lat_milli')} END AS lat
    FROM sp_raw_loaded"""
CTES["sp_raw_person"] = """
    SELECT p.*, CAST(year(o.o_orderdate) AS INTEGER) AS year,
           NOT (p.st_case % 211 = 0 OR p.st_case % 101 = 0
                OR (year(o.o_orderdate) >= 1997 AND p.st_case % 97 = 0)) AS has_crash,
           (p.st_case + p.vehicle_number) % 199 = 0 AS bad_age
    FROM sp_persons_raw p JOIN orders o ON o.o_orderkey = p.st_case
    WHERE year(o.o_orderdate) <> 2001"""
CTES["sp_raw_person_rank"] = """
    SELECT *, row_number() OVER (PARTITION BY st_case, year, vehicle_number, person_number
              ORDER BY l_partkey, l_extendedprice, l_quantity, l_shipdate, person_type,
                       injury_severity) AS rn
    FROM sp_raw_person WHERE has_crash AND NOT bad_age"""

# ---------------------------------------------------------------------------
# City-side files (generator rules of sources/place_files.py)
# ---------------------------------------------------------------------------

CTES["sp_pcust"] = f"""
    SELECT c_custkey AS c, c_name, c_nationkey, c_mktsegment,
           {zf('c_nationkey', 2)} AS state_fips, {zf('c_custkey', 5)} AS place_fips,
           CAST(floor(c_acctbal * CAST(20 AS DOUBLE)) AS INTEGER) AS population,
           s.state_name AS real_state,
           coalesce(s.state_name, 'State ' || {zf('c_nationkey', 2)}) AS state_label
    FROM customer LEFT JOIN sp_states s ON s.state_fips = {zf('c_nationkey', 2)}"""


def _override_values() -> str:
    from roadstats.functions.dims import POINT_OVERRIDES
    return ", ".join(f"({i}, CAST({lon!r} AS DOUBLE), CAST({lat!r} AS DOUBLE))"
                     for i, (_, lon, lat) in enumerate(POINT_OVERRIDES))


CTES["sp_point_overrides"] = f"SELECT * FROM (VALUES {_override_values()}) t(idx, lon, lat)"
CTES["sp_city_points"] = """
    SELECT state_fips, place_fips,
           CASE WHEN c % 7 = 0 THEN o.lon
                ELSE CAST(-125000 + (c * 7919) % 58000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS point_lon,
           CASE WHEN c % 7 = 0 THEN o.lat
                ELSE CAST(24500 + (c * 104729) % 24500 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS point_lat,
           CASE WHEN c % 7 = 0 THEN 'override' ELSE 'geocoded' END AS point_source
    FROM sp_pcust LEFT JOIN sp_point_overrides o ON o.idx = c % 11
    WHERE population > 100000 AND ((c % 7 = 0 AND c % 3 = 0) OR (c % 7 <> 0 AND c % 13 <> 0))"""


# ---------------------------------------------------------------------------
# Tables with defects (rules of standins.flawed_crashes, spread_points)
# ---------------------------------------------------------------------------

CTES["sp_flawed"] = """
    SELECT CASE WHEN st_case % 103 <> 0 THEN st_case END AS st_case,
           CASE WHEN st_case % 101 <> 0 THEN year END AS year,
           CASE WHEN st_case % 41 = 0 THEN DATE '1986-12-31' WHEN st_case % 67 <> 0 THEN crash_date END AS crash_date,
           CASE WHEN st_case % 37 <> 0 THEN state END AS state,
           CASE WHEN st_case % 61 = 0 AND lon IS NOT NULL THEN 200 ELSE lon END AS lon, lat,
           CAST(CASE WHEN st_case % 43 = 0 THEN -1 WHEN st_case % 47 = 0 THEN 31 + st_case % 5
                     WHEN st_case % 53 = 0 THEN total_fatalities + 1 ELSE total_fatalities END AS BIGINT) AS total_fatalities,
           CAST(CASE WHEN st_case % 59 <> 0 THEN motorist_fatalities END AS BIGINT) AS motorist_fatalities,
           CAST(cyclist_fatalities AS BIGINT) AS cyclist_fatalities,
           CAST(pedestrian_fatalities AS BIGINT) AS pedestrian_fatalities,
           CAST(other_fatalities AS BIGINT) AS other_fatalities
    FROM sp_crashes, (SELECT unnest([0, 1]) AS flaw_copy) WHERE flaw_copy = 0 OR st_case % 31 = 0"""
CTES["sp_spread"] = """
    SELECT o_orderkey AS st_case, CAST(year(o_orderdate) + (o_orderkey % 4) * 3 AS BIGINT) AS year FROM orders"""


class _Conus:
    """EPSG:5070 from its published parameters: GRS 80, standard parallels 29.5 and 45.5, origin 23 N 96 W."""

    A_AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
    LON_0 = -96.0
    E2 = FLATTENING * (2 - FLATTENING)
    E = math.sqrt(E2)

    @classmethod
    def m2(cls, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) ** 2 / (1 - cls.E2 * s * s)

    @classmethod
    def q(cls, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return (1 - cls.E2) * (s / (1 - cls.E2 * s * s) + math.atanh(cls.E * s) / cls.E)


_Conus.N_CONE = (_Conus.m2(29.5) - _Conus.m2(45.5)) / (_Conus.q(45.5) - _Conus.q(29.5))
_Conus.C_CONE = _Conus.m2(29.5) + _Conus.N_CONE * _Conus.q(29.5)
_Conus.RHO_0 = _Conus.A_AXIS * math.sqrt(_Conus.C_CONE - _Conus.N_CONE * _Conus.q(23.0)) / _Conus.N_CONE


def albers_xy_sql(lon: str, lat: str) -> tuple[str, str]:
    """EPSG:5070 forward projection (same closed form as the Spark side, constants of its own)."""
    hs = _Conus
    s = f"sin(radians({lat}))"
    q = (f"((1 - {hs.E2!r}) * ({s} / (1 - {hs.E2!r} * {s} * {s}) - (1 / (2 * {hs.E!r})) * "
         f"ln((1 - {hs.E!r} * {s}) / (1 + {hs.E!r} * {s}))))")
    rho = f"({hs.A_AXIS!r} * sqrt({hs.C_CONE!r} - {hs.N_CONE!r} * {q}) / {hs.N_CONE!r})"
    theta = f"({hs.N_CONE!r} * radians({lon} - ({hs.LON_0!r})))"
    return f"({rho} * sin({theta}))", f"({hs.RHO_0!r} - {rho} * cos({theta}))"


def albers_inverse_ctes(src: str, iterations: int = 8) -> tuple[str, str]:
    """(CTE text, final CTE name): lon/lat from EPSG:5070 x/y columns of
    ``src``, the same closed form and operation order as the Spark side."""
    hs = _Conus
    k = repr(hs.N_CONE * hs.N_CONE / (hs.A_AXIS * hs.A_AXIS))
    parts = [
        f"inv_q AS (SELECT *, ({hs.C_CONE!r} - (x * x + ({hs.RHO_0!r} - y) * ({hs.RHO_0!r} - y))"
        f" * {k}) / {hs.N_CONE!r} AS q FROM {src})",
        "inv_0 AS (SELECT *, asin(q / 2.0) AS phi FROM inv_q)",
    ]
    for i in range(iterations):
        s = "sin(phi)"
        es = f"({hs.E!r} * {s})"
        one = f"(1.0 - {hs.E2!r} * {s} * {s})"
        step = (f"phi + {one} * {one} / (2.0 * cos(phi)) * (q / {1 - hs.E2!r} - {s} / {one}"
                f" + {1 / (2 * hs.E)!r} * ln((1.0 - {es}) / (1.0 + {es})))")
        parts.append(f"inv_{i + 1} AS (SELECT * REPLACE ({step} AS phi) FROM inv_{i})")
    last = f"inv_{iterations}"
    parts.append(f"inv_out AS (SELECT *, degrees(atan2(x, {hs.RHO_0!r} - y) / {hs.N_CONE!r})"
                 f" + ({hs.LON_0!r}) AS lon, degrees(phi) AS lat FROM {last})")
    return ",\n".join(parts), "inv_out"
