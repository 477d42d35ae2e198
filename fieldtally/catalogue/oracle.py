"""The same rows as the registered queries, in SQL for DuckDB. Inputs and shared
steps are common table expressions in front of each final select."""

from __future__ import annotations

from fieldtally.catalogue.inputs import (
    INPUTS,
    PRIORITY_PARAMETER,
    SEGMENT_SOURCE,
    derive_sql,
)
from fieldtally.catalogue.queries import (
    PLOT_CORNERS,
    SOME_PARAMETERS,
    SOME_SURVEYS,
    SOME_YEAR,
    STATION_NAMES,
)
from fieldtally.plans.explore import MEAN_EFFORT, SURVEY_NAMES, TOTAL_YEARS
from fieldtally.plans.surveys import FISH_SOURCES, PARAMETERS, WATER_QUALITY_SOURCES


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# The map projection's numbers, worked out to the sixth order for the GRS 1980
# ellipsoid (radius of the meridian circle times 0.9996, first eccentricity, and the terms
# of easting and northing), not taken from the library.
RADIUS = "6364902.166112739"
ECCENTRICITY = "0.081819191042815790"
TERMS = (
    "8.3773182472855133e-4", "7.6085278481494745e-7", "1.1976455209422673e-9", "2.4291706548410129e-12",
)


def utm_sql(source: str) -> str:
    """All columns of a relation and its planar x, y."""
    east, north = (
        a + "".join(f" + {t}::DOUBLE * {f}({2 * k} * xi) * {g}({2 * k} * eta)" for k, t in enumerate(TERMS, 1))
        for a, f, g in (("eta", "cos", "sinh"), ("xi", "sin", "cosh"))
    )
    e = f"{ECCENTRICITY}::DOUBLE"
    return f"""
    SELECT * EXCLUDE (sp, lam, t, xi, eta),
      500000::DOUBLE + {RADIUS}::DOUBLE * ({east}) AS x, {RADIUS}::DOUBLE * ({north}) AS y
    FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta
      FROM (SELECT *, sinh(atanh(sp) - {e} * atanh({e} * sp)) AS t
        FROM (SELECT *, sin(radians(Latitude)) AS sp, radians(Longitude + 123) AS lam
          FROM {source})))"""


def shown_sql(moment: str) -> str:
    """Null from two to three o'clock on the first Sunday of April, until 2006, and on the
    second of March since: the hour that Pacific clocks skip."""
    return f"""(SELECT CASE WHEN hour(t) = 2 AND isodow(t) = 7 AND (
        year(t) BETWEEN 1987 AND 2006 AND month(t) = 4 AND day(t) <= 7
        OR year(t) >= 2007 AND month(t) = 3 AND day(t) BETWEEN 8 AND 14) THEN NULL ELSE t END
      FROM (SELECT {moment} AS t))"""


def visits_sql(name: str, source: str, date: str, time: str, moment: str = "{}") -> str:
    parsed = moment.format(shown_sql(f"try_strptime(Date || ' ' || Time, '{date} {time}')"))
    return f"""
    SELECT Station, year(D)::INT AS Year, '{source}' AS Source, count(*) AS N
    FROM (SELECT DISTINCT Station, try_strptime(Date, '{date}') AS D, {parsed} AS T FROM {name})
    GROUP BY ALL"""


def located_sql(counts: str, sites: str) -> str:
    return f"""
    SELECT c.Station, c.Year, c.Source, c.N, s.Latitude, s.Longitude, c.Station AS Station2
    FROM ({counts}) c JOIN ({sites}) s ON c.Station = s.Station
    WHERE s.Latitude IS NOT NULL AND s.Longitude IS NOT NULL"""


def each_place_sql(source: str, amount: str = "count(*)") -> str:
    keys = "Year, Station, Station2, Source"
    return f"""
    SELECT DISTINCT {keys}, Latitude, Longitude,
      ({amount} OVER (PARTITION BY {keys}))::BIGINT AS N FROM ({source})"""


LABELLED_PLACES = "Latitude IS NOT NULL AND Longitude IS NOT NULL"
DATED = (
    "CASE WHEN contains(Station, 'EZ') THEN Station || ' ' || Date::DATE::VARCHAR "
    "ELSE Station END"
)
LARVAL_SITES = """
    SELECT Station,
      split_part(Lat, ' ', 1)::DOUBLE + split_part(Lat, ' ', 2)::DOUBLE / 60.0::DOUBLE
        + split_part(Lat, ' ', 3)::DOUBLE / 3600.0::DOUBLE AS Latitude,
      -(split_part(Long, ' ', 1)::DOUBLE + split_part(Long, ' ', 2)::DOUBLE / 60.0::DOUBLE
        + split_part(Long, ' ', 3)::DOUBLE / 3600.0::DOUBLE) AS Longitude
    FROM sls_sites UNION ALL SELECT '912', 37.966::DOUBLE, (-121.367)::DOUBLE"""

QUALITY_LABELLED = f"""
    SELECT Year, Station, {DATED} AS Station2, Source, Latitude, Longitude, Datetime
    FROM water_quality
    WHERE Year <= 2021 AND Source IN ({quoted(WATER_QUALITY_SOURCES)}) AND {LABELLED_PLACES}"""
MOVED = """
    SELECT Year, Station, Source, Latitude, Longitude,
      CASE WHEN min(Latitude) OVER w <> max(Latitude) OVER w
          OR min(Longitude) OVER w <> max(Longitude) OVER w
        THEN Station2 || ' ' || coalesce(strftime(Datetime, '%Y-%m-%d %H:%M:%S'), 'NA')
        ELSE Station2 END AS Station2
    FROM (""" + QUALITY_LABELLED + """) WINDOW w AS (PARTITION BY Year, Station, Station2, Source)"""

TALLY = "Year, Station, Station2, Source, Latitude, Longitude, N"


def matches_sql(quality: str) -> str:
    return f"""
    SELECT 'EMP' AS Source, m.Station, m.Distance, m.WQ_station,
      p.Latitude AS WQ_lat, p.Longitude AS WQ_lon
    FROM (SELECT * FROM (
        SELECT z.Station, t.Station AS WQ_station,
          sqrt((z.x - t.x) ** 2 + (z.y - t.y) ** 2) AS Distance,
          row_number() OVER (PARTITION BY z.Station
            ORDER BY sqrt((z.x - t.x) ** 2 + (z.y - t.y) ** 2), t.Station) AS place
        FROM ({utm_sql("(SELECT * FROM zoop_sites WHERE Source = 'EMP')")}) z,
          ({utm_sql(quality)}) t)
      WHERE place = 1 AND Distance <= 1000) m
    JOIN {quality} p ON p.Station = m.WQ_station"""


def targets_sql(quality: str) -> str:
    return f"""
    SELECT DISTINCT Station, Latitude, Longitude FROM {quality}
    WHERE Source = 'EMP' AND NOT contains(Station, 'EZ')"""


def harmonised_sql(tally: str, matches: str) -> str:
    return f"""
    SELECT z.Year, coalesce(m.WQ_station, z.Station) AS Station,
      coalesce(m.WQ_station, z.Station2) AS Station2, z.Source,
      CASE WHEN m.WQ_station IS NULL THEN z.Latitude ELSE m.WQ_lat END AS Latitude,
      CASE WHEN m.WQ_station IS NULL THEN z.Longitude ELSE m.WQ_lon END AS Longitude,
      z.N, 'Zooplankton' AS Parameter
    FROM {tally} z LEFT JOIN {matches} m ON z.Source = m.Source AND z.Station = m.Station"""


def directory_sql(matches: str) -> str:
    return f"""
    SELECT coalesce(z.WQ_station, b.Station) AS Station, z.Station AS Zoop_station,
      b.Benthic_station
    FROM (SELECT DISTINCT Station, WQ_station FROM {matches}) z
    FULL JOIN (SELECT Station, list_sort(list(DISTINCT Benthic_station)) AS Benthic_station
      FROM (SELECT split_part(Station, '-', 1) AS Station, split_part(Station, '-', 1) || '-' ||
          CASE WHEN contains(Station, '-') THEN split_part(Station, '-', 2) ELSE 'NA' END
          AS Benthic_station FROM bivalves)
      GROUP BY 1) b ON z.WQ_station = b.Station"""


def recoded_sql(tallies: str) -> str:
    return f"""
    SELECT * EXCLUDE (Station, Source), Source || ' ' || Station2 AS StationID, Source,
      CASE Station WHEN 'NZEZ2' THEN 'EZ2' WHEN 'NZEZ6' THEN 'EZ6' WHEN 'NZEZ2SJR' THEN 'EZ2-SJR'
        WHEN 'NZEZ6SJR' THEN 'EZ6-SJR' ELSE Station END AS Station
    FROM (SELECT * EXCLUDE (Source), CASE Source WHEN 'twentymm' THEN '20mm'
        WHEN 'USGS' THEN 'SFBS' WHEN 'USBR' THEN 'SDSCS' ELSE Source END AS Source
      FROM ({tallies}))"""


def matrix_sql(merged: str, directory: str) -> str:
    sums = ", ".join(
        f"coalesce(sum(N) FILTER (Parameter = '{p}'), 0)::BIGINT AS {p}" for p in PARAMETERS
    )
    return f"""
    SELECT m.*, d.Zoop_station, d.Benthic_station, greatest({", ".join(PARAMETERS)}) AS Max,
      CASE WHEN d.Benthic_station IS NULL AND d.Zoop_station IS NULL THEN NULL
        WHEN d.Zoop_station IS NULL THEN 'Benthic: ' || array_to_string(d.Benthic_station, ', ')
        WHEN d.Benthic_station IS NULL THEN 'Zooplankton: ' || d.Zoop_station
        ELSE 'Benthic: ' || array_to_string(d.Benthic_station, ', ') || ' | Zooplankton: '
          || d.Zoop_station END AS Extra_stations
    FROM (SELECT Year, Station, Station2, Source, StationID, Latitude, Longitude, N_years, {sums}
      FROM (SELECT m.* EXCLUDE (Latitude, Longitude), s.Latitude, s.Longitude, s.N_years
        FROM {merged} m JOIN (SELECT StationID,
            CASE WHEN count(Latitude) = count(*) THEN avg(Latitude) END AS Latitude,
            CASE WHEN count(Longitude) = count(*) THEN avg(Longitude) END AS Longitude,
            count(DISTINCT coalesce(Year, -1)) AS N_years
          FROM {merged} GROUP BY 1) s ON m.StationID = s.StationID)
      GROUP BY ALL) m
    LEFT JOIN {directory} d ON m.Station = d.Station"""


def rounded_sql(value: str) -> str:
    """Two decimals of a double's exact value, ties to even."""
    return f"""(SELECT CASE WHEN rest > 0.5 OR rest = 0.5 AND whole % 2 = 1 THEN whole + 1 ELSE whole END / 100.0::DOUBLE
      FROM (SELECT floor(exact)::BIGINT AS whole, exact - floor(exact) AS rest
        FROM (SELECT printf('%.25f', ({value})::DOUBLE)::DECIMAL(38, 25) * 100 AS exact)))"""


def averaged_sql(rows: str) -> str:
    columns = [*PARAMETERS, "Max"]
    sums = ", ".join(f"sum({c}) AS {c}" for c in columns)
    rates = ", ".join(f"{rounded_sql(f'{c} / N_years')} AS {c}" for c in columns)
    return f"""
    SELECT * REPLACE ({rates}) FROM (SELECT Station, Station2, Extra_stations, Source, Latitude,
        Longitude, Zoop_station, Benthic_station, {sums}, max(N_years) AS N_years
      FROM {rows} GROUP BY ALL)"""


STATION = (
    "CASE WHEN c_mktsegment = 'AUTOMOBILE' AND c_custkey % 40 = 0 THEN 'NZEZ2' "
    "WHEN c_mktsegment = 'AUTOMOBILE' AND c_custkey % 40 = 1 THEN 'NZEZ6' "
    "WHEN c_mktsegment = 'AUTOMOBILE' AND c_custkey % 40 = 2 THEN 'NZEZ2SJR' "
    "WHEN c_mktsegment = 'AUTOMOBILE' AND c_custkey % 40 = 3 THEN 'NZEZ6SJR' "
    "ELSE 'C' || c_custkey::VARCHAR END"
)


def plot_edges_sql(key: str, table: str, size: str) -> str:
    """Edges of the dented polygons around the rows of a table."""
    following = PLOT_CORNERS[1:] + PLOT_CORNERS[:1]
    values = ", ".join(str((*a, *b)) for a, b in zip(PLOT_CORNERS, following))
    return f"""
    SELECT {key} AS poly_id, cx + size * a1 AS x1, cy + size * b1 AS y1, cx + size * a2 AS x2,
      cy + size * b2 AS y2
    FROM (SELECT {key}, {size} AS size, 500000::DOUBLE + {key} * 7919 % 150000 AS cx,
        4150000::DOUBLE + {key} * 104729 % 115000 AS cy FROM {table}),
      (VALUES {values}) AS corner(a1, b1, a2, b2)"""


STEPS = {
    **{name: derive_sql(name) for name in INPUTS},
    "t_ybfmp_zoop": located_sql(
        visits_sql("ybfmp_zoop", "YBFMP", "%Y-%m-%d", "%H:%M:%S"), "SELECT * FROM ybfmp_zoop_sites"
    ),
    "t_edsm": """
    SELECT year(D)::INT AS Year, Station, 'EDSM' AS Source, Station AS Station2,
      avg(Latitude) AS Latitude, avg(Longitude) AS Longitude, count(*) AS N
    FROM (SELECT DISTINCT Station, Latitude, Longitude, try_strptime(Date, '%Y-%m-%d') AS D,
        """ + shown_sql("try_strptime(Date || ' ' || Time, '%Y-%m-%d %H:%M:%S')") + """ AS T
      FROM (SELECT * FROM edsm_20mm UNION ALL BY NAME SELECT * FROM edsm_kdtr)
      WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL)
    GROUP BY ALL""",
    "t_djfmp": located_sql(
        visits_sql("djfmp_seine", "DJFMP", "%Y-%m-%d", "%H:%M:%S", "date_trunc('minute', {})"),
        "SELECT * FROM djfmp_sites",
    ),
    "t_ybfmp_fish": located_sql(
        visits_sql("ybfmp_fish", "YBFMP", "%m/%d/%Y", "%H:%M"),
        "SELECT DISTINCT * FROM ybfmp_fish_sites",
    ),
    "t_sls": located_sql(visits_sql("sls_fish", "SLS", "%Y-%m-%d", "%H:%M:%S"), LARVAL_SITES),
    "t_ybfmp": each_place_sql(
        "SELECT * FROM t_ybfmp_fish UNION ALL BY NAME SELECT * FROM t_ybfmp_zoop", "sum(N)"
    ),
    "t_zoop_samples": each_place_sql(
        f"SELECT year(Date)::INT AS Year, Station, {DATED} AS Station2, Source, Latitude, "
        f"Longitude FROM zoop_env WHERE {LABELLED_PLACES}"
    ),
    "t_quality_samples": each_place_sql(MOVED),
    "t_quality": "SELECT * FROM t_quality_samples" + "".join(
        f" UNION ALL BY NAME SELECT {TALLY} FROM {name}"
        for name in ("t_edsm", "t_djfmp", "t_ybfmp", "t_sls")
    ),
    "quality_targets": targets_sql("t_quality_samples"),
    "matches": matches_sql("quality_targets"),
    "directory_of_names": directory_sql("matches"),
    "t_benthic": """
    SELECT b.Year, b.Station, b.Station AS Station2, b.Source, b.N, 'Benthic' AS Parameter,
      p.Latitude, p.Longitude
    FROM (SELECT year(Date)::INT AS Year, split_part(Station, '-', 1) AS Station, Source,
        count(*) AS N FROM bivalves WHERE year(Date) BETWEEN 1950 AND 2021 GROUP BY ALL) b
    LEFT JOIN (SELECT DISTINCT Station, Latitude, Longitude FROM t_quality_samples
      WHERE Source = 'EMP') p ON b.Station = p.Station""",
    "t_phytoplankton": """
    SELECT b.Year, b.Station, b.Station2, b.Source, b.N, 'Phytoplankton' AS Parameter,
      p.Latitude, p.Longitude
    FROM (SELECT year(Date)::INT AS Year, S AS Station, Source, count(*) AS N,
        CASE WHEN contains(S, 'EZ') THEN S || ' ' || Date::DATE::VARCHAR ELSE S END AS Station2
      FROM (SELECT *, CASE WHEN contains(Station, 'EZ6 SJR') THEN 'EZ6 SJR'
          WHEN contains(Station, 'EZ2 SJR') THEN 'EZ2 SJR' WHEN contains(Station, 'EZ2') THEN 'EZ2'
          WHEN contains(Station, 'EZ6') THEN 'EZ6' ELSE Station END AS S
        FROM phytoplankton WHERE year(Date) BETWEEN 1950 AND 2021)
      GROUP BY ALL) b
    JOIN (SELECT DISTINCT Station, Station2, Latitude, Longitude FROM t_quality_samples
      WHERE Source = 'EMP') p ON b.Station = p.Station AND b.Station2 = p.Station2""",
    "t_zooplankton": f"SELECT {TALLY}, 'Zooplankton' AS Parameter FROM t_zoop_samples "
    f"UNION ALL BY NAME SELECT {TALLY}, 'Zooplankton' AS Parameter FROM t_ybfmp_zoop",
    "t_harmonised": harmonised_sql("t_zooplankton", "matches"),
    "t_all": recoded_sql(
        "SELECT * FROM t_benthic UNION ALL BY NAME SELECT * FROM t_phytoplankton "
        "UNION ALL BY NAME SELECT * FROM t_harmonised "
        "UNION ALL BY NAME SELECT *, 'Water_quality' AS Parameter FROM t_quality "
        "UNION ALL BY NAME SELECT *, 'Fish' AS Parameter FROM t_quality "
        f"WHERE Source IN ({quoted(FISH_SOURCES)}) "
        "UNION ALL BY NAME SELECT *, 'Fish' AS Parameter FROM t_ybfmp_fish"
    ),
    "built": matrix_sql("t_all", "directory_of_names"),
    "order_visits": f"""
    SELECT Source, Station, Station AS Station2, Year, Parameter, N, Latitude, Longitude
    FROM (SELECT {SEGMENT_SOURCE} AS Source, {STATION} AS Station, year(o_orderdate)::INT AS Year,
        {PRIORITY_PARAMETER} AS Parameter, count(DISTINCT (o_custkey, o_orderdate)) AS N,
        37.5::DOUBLE + length({STATION}) * 0.125::DOUBLE AS Latitude,
        -122::DOUBLE + length({SEGMENT_SOURCE}) * 0.25::DOUBLE AS Longitude
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)""",
    "order_directory": """
    SELECT coalesce(z.Station, b.Station) AS Station, z.Zoop_station, b.Benthic_station
    FROM (SELECT 'C' || (s_suppkey * 3)::VARCHAR AS Station,
        'Zoo ' || (s_suppkey * 3)::VARCHAR AS Zoop_station FROM supplier) z
    FULL JOIN (SELECT 'C' || p_partkey::VARCHAR AS Station,
        CASE WHEN p_partkey % 5 = 0 THEN ['C' || p_partkey::VARCHAR || '-' || p_type,
          'C' || p_partkey::VARCHAR || '-' || p_type || '-x']
        WHEN p_partkey % 5 < 3 THEN ['C' || p_partkey::VARCHAR || '-' || p_type] END AS Benthic_station
      FROM part) b ON z.Station = b.Station""",
    "order_merged": recoded_sql("SELECT * FROM order_visits"),
    "sampling": matrix_sql("order_merged", "order_directory"),
    "averaged": averaged_sql("sampling"),
    "region_edges": """
    SELECT n_nationkey AS poly_id, cx + dx1 AS x1, cy + dy1 AS y1, cx + dx2 AS x2, cy + dy2 AS y2
    FROM (SELECT n_nationkey, 550000::DOUBLE + n_nationkey * 4500::DOUBLE AS cx,
        4160000::DOUBLE + n_nationkey * 7 % 25 * 4000::DOUBLE AS cy FROM nation),
      (VALUES (9000, 0, 0, 9000), (0, 9000, -9000, 0), (-9000, 0, 0, -9000), (0, -9000, 9000, 0))
        AS corner(dx1, dy1, dx2, dy2)""",
    "plot_edges": plot_edges_sql("o_orderkey", "orders", "(100::DOUBLE + o_orderkey % 11 * 40::DOUBLE) "
    "* CASE WHEN o_orderkey % 50 = 1 THEN 10 ELSE 1 END"),
    "area_edges": plot_edges_sql("s_suppkey", "supplier", "2000::DOUBLE"),
    "sensor_names": "SELECT s_suppkey::VARCHAR AS num, s_name AS description FROM supplier",
    "alias": """
    WITH named AS (SELECT DISTINCT Source, StationID, Source || ' ' || Zoop_station AS Zoop_station,
        Source || ' ' || unnest(coalesce(Benthic_station, [NULL])) AS Benthic_station
      FROM sampling WHERE Source <> 'EDSM' AND Station NOT IN ('EZ2', 'EZ6', 'EZ2-SJR', 'EZ6-SJR'))
    SELECT Source, StationID, Zoop_station AS Station FROM named WHERE Zoop_station IS NOT NULL
    UNION ALL SELECT Source, StationID, Benthic_station FROM named WHERE Benthic_station IS NOT NULL
    UNION ALL SELECT Source, StationID, StationID FROM named
    UNION ALL VALUES ('EDSM', 'Unfixed EDSM stations', 'Unfixed EDSM stations'),
      ('EMP', 'EMP EZ2', 'EMP EZ2'), ('EMP', 'EMP EZ6', 'EMP EZ6'),
      ('EMP', 'EMP EZ2-SJR', 'EMP EZ2-SJR'), ('EMP', 'EMP EZ6-SJR', 'EMP EZ6-SJR')""",
    "with_places": recoded_sql(
        f"SELECT {TALLY}, 'Zooplankton' AS Parameter FROM t_zoop_samples "
        "UNION ALL BY NAME " + each_place_sql(
            "SELECT Year, Station, Station AS Station2, Source, Latitude, Longitude "
            f"FROM water_quality WHERE {LABELLED_PLACES}"
        )
    ),
    "conflicts": """
    SELECT StationID, count(*) AS N_places
    FROM (SELECT DISTINCT StationID, Latitude, Longitude FROM with_places)
    GROUP BY 1 HAVING count(*) > 1""",
    "station_parts": "SELECT 'P' || p_partkey::VARCHAR AS Station, * FROM part "
    "WHERE p_partkey % 10 NOT IN (3, 4)",
}

PREFIX = "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in STEPS.items()) + "\n"

PLACED = "* REPLACE (round(Latitude, 6) AS Latitude, round(Longitude, 6) AS Longitude)"
FLAT = (
    "* REPLACE (round(Latitude, 6) AS Latitude, round(Longitude, 6) AS Longitude, "
    "array_to_string(Benthic_station, ', ') AS Benthic_station)"
)
ANY_OF_SOME = " OR ".join(f"{p} > 0" for p in SOME_PARAMETERS)


def inside_sql(source: str, layer: str = "region_edges") -> str:
    crossing = f"""
      SELECT p.key FROM points p JOIN {layer} e
        ON (e.y1 > p.y) <> (e.y2 > p.y)
        AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / nullif(e.y2 - e.y1, 0)
      GROUP BY p.key, e.poly_id HAVING count(*) % 2 = 1"""
    return f"""(WITH points AS ({utm_sql(f"(SELECT *, row_number() OVER () AS key FROM {source})")})
      SELECT * EXCLUDE (key, x, y) FROM points WHERE key IN ({crossing}))"""


NEAREST_REGION = f"""
    WITH points AS ({utm_sql("customer_points")}),
    sides AS (SELECT p.id, e.poly_id,
        (e.y1 > p.y) <> (e.y2 > p.y)
          AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / nullif(e.y2 - e.y1, 0) AS crossed,
        greatest(least(((p.x - e.x1) * (e.x2 - e.x1) + (p.y - e.y1) * (e.y2 - e.y1))
          / ((e.x2 - e.x1) ** 2 + (e.y2 - e.y1) ** 2), 1), 0) AS t, p.x, p.y, e.x1, e.y1, e.x2, e.y2
      FROM points p, area_edges e),
    areas AS (SELECT id, poly_id, count(*) FILTER (crossed) % 2 = 1 AS within,
        min(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2)) AS d
      FROM sides GROUP BY ALL)
    SELECT id, nearest_id, round(d, 3) AS distance FROM (
      SELECT id, poly_id AS nearest_id, CASE WHEN within THEN 0 ELSE d END AS d,
        row_number() OVER (PARTITION BY id ORDER BY CASE WHEN within THEN 0 ELSE d END, poly_id) AS place
      FROM areas)
    WHERE place = 1"""


def nearest_sql(radius: str = "") -> str:
    return f"""
    SELECT c.id, n.nearest_id, n.distance FROM customer_points c LEFT JOIN (
      SELECT id, nearest_id, round(d, 3) AS distance FROM (
        SELECT a.id, b.id AS nearest_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d,
          row_number() OVER (PARTITION BY a.id
            ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS place
        FROM ({utm_sql("customer_points")}) a, ({utm_sql("supplier_points")}) b)
      WHERE place = 1 {radius}) n ON c.id = n.id"""


def number_sql(column: str) -> str:
    return (
        f"regexp_replace(({column})::DECIMAL(38, 6)::VARCHAR, '\\.?0+$', '')"
    )


def tooltip_sql(with_year: bool) -> str:
    lines = [("Survey", "Source"), ("Station", "Station"),
             ("Alternate station names", "coalesce(Extra_stations, 'None')"),
             *[(f"N_{p}", number_sql(p)) for p in
               ("Benthic", "Fish", "Phytoplankton", "Water_quality", "Zooplankton", "Max")],
             ("N_Years", number_sql("N_years"))]
    if with_year:
        lines.insert(0, ("Year", "Year::VARCHAR"))
    cells = " || ".join(
        f"'<tr><td>{label} &nbsp</td><td>' || {value} || '</td></tr>'" for label, value in lines
    )
    return f"'<table  border=''1''>' || {cells} || '</table>'"


def survey_values() -> str:
    return ", ".join("(" + quoted(pair) + ")" for pair in SURVEY_NAMES)


ORACLE = {
    "survey_site_lookup": f"SELECT {PLACED} FROM t_ybfmp_zoop",
    "survey_own_places": f"SELECT {PLACED} FROM t_edsm",
    "survey_whole_minutes": f"SELECT {PLACED} FROM t_djfmp",
    "survey_month_first": f"SELECT {PLACED} FROM t_ybfmp_fish",
    "survey_larval": f"SELECT {PLACED} FROM t_sls",
    "merge_two": f"SELECT {PLACED} FROM t_ybfmp",
    "zooplankton": f"SELECT {PLACED} FROM t_zooplankton",
    "moving_sites": f"SELECT {PLACED}, 'Water_quality' AS Parameter FROM t_quality_samples",
    "fish": f"SELECT {PLACED}, 'Fish' AS Parameter FROM (SELECT * FROM t_quality_samples WHERE "
    f"Source IN ({quoted(FISH_SOURCES)}) UNION ALL BY NAME SELECT * FROM t_ybfmp_fish)",
    "replicate_fold": f"SELECT {PLACED} FROM t_benthic",
    "name_folding": f"SELECT {PLACED} FROM t_phytoplankton",
    "parsed_moments": f"""
    SELECT year(D)::INT AS Year, month(D)::INT AS Month, hour(T)::INT AS hour,
      minute(T)::INT AS minute, count(*) AS N
    FROM (SELECT try_strptime(Date, '%Y-%m-%d') AS D,
      {shown_sql("try_strptime(Date || ' ' || Time, '%Y-%m-%d %H:%M:%S')")} AS T FROM djfmp_seine)
    GROUP BY ALL""",
    "dms_to_decimal": f"SELECT {PLACED} FROM ({LARVAL_SITES})",
    "variables_in_years": """
    SELECT year(Date)::INT AS Year, Source, count(*) AS N, 'bivalves' AS variable FROM bivalves
    WHERE year(Date) BETWEEN 1996 AND 1999 GROUP BY ALL
    UNION ALL SELECT year(Date)::INT, Source, count(*), 'phytoplankton' FROM phytoplankton
    WHERE year(Date) BETWEEN 1998 AND 1999 GROUP BY ALL""",
    "utm_project": "SELECT * REPLACE (round(x, 3) AS x, round(y, 3) AS y) FROM "
    f"({utm_sql('customer_points')})",
    "nearest_match": "SELECT Source, Station, round(Distance, 3) AS Distance, WQ_station, "
    "round(WQ_lat, 6) AS WQ_lat, round(WQ_lon, 6) AS WQ_lon FROM matches",
    "nearest_any_distance": nearest_sql(),
    "nearest_in_radius": nearest_sql("AND d <= 4000"),
    "paired_distance": f"""
    SELECT a.id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 3) AS distance
    FROM ({utm_sql("customer_points")}) a JOIN ({utm_sql("supplier_points")}) b ON a.id = b.id""",
    "harmonised_names": f"SELECT {PLACED} FROM ("
    + harmonised_sql("(SELECT * FROM t_zoop_samples)", "matches")
    + ")",
    "alias_directory": "SELECT * REPLACE (array_to_string(Benthic_station, ', ') AS "
    "Benthic_station) FROM directory_of_names",
    "inside_region": f"SELECT id FROM {inside_sql('customer_points')}",
    "inside_many_regions": f"SELECT id FROM {inside_sql('customer_points', 'plot_edges')}",
    "nearest_region": NEAREST_REGION,
    "effort_matrix": f"SELECT {FLAT} FROM sampling",
    "sampling_build": f"SELECT {FLAT} FROM built",
    "union_recode": f"SELECT {PLACED} FROM ("
    + recoded_sql(
        f"SELECT {TALLY}, 'Zooplankton' AS Parameter FROM t_zoop_samples UNION ALL BY NAME "
        f"SELECT {TALLY}, 'Water_quality' AS Parameter FROM t_quality_samples"
    )
    + ")",
    "mean_site": """
    SELECT c_nationkey, c_mktsegment, round(CASE WHEN NOT bool_or(v IS NULL) THEN avg(v) END, 4)
      AS mean
    FROM (SELECT *, CASE WHEN c_custkey % 97 <> 0 THEN c_acctbal END AS v FROM customer)
    GROUP BY ALL""",
    "extra_label": """
    SELECT Station, CASE WHEN Zoop_station IS NULL
        THEN 'Benthic: ' || array_to_string(Benthic_station, ', ')
      WHEN Benthic_station IS NULL THEN 'Zooplankton: ' || Zoop_station
      ELSE 'Benthic: ' || array_to_string(Benthic_station, ', ') || ' | Zooplankton: '
        || Zoop_station END AS Extra_stations FROM order_directory""",
    "conflict_report": "SELECT StationID, round(Latitude, 6) AS Latitude, "
    "round(Longitude, 6) AS Longitude, N_places FROM (SELECT DISTINCT StationID, Latitude, "
    "Longitude FROM with_places) JOIN conflicts USING (StationID)",
    "conflicting_places": f"SELECT {PLACED} FROM (SELECT DISTINCT StationID, Latitude, Longitude "
    "FROM with_places WHERE StationID IN (SELECT StationID FROM conflicts))",
    "filled_years": """
    WITH spans AS (SELECT o_custkey, year(o_orderdate) AS y1,
        year(o_orderdate) + o_orderkey % 5 - 2 AS y2 FROM orders WHERE o_orderkey % 7 > 0)
    SELECT c.o_custkey, c.Year FROM (SELECT o_custkey,
        unnest(range(min(least(y1, y2)), max(greatest(y1, y2)) + 1))::INT AS Year
      FROM spans GROUP BY 1) c
    LEFT JOIN spans s ON s.o_custkey = c.o_custkey AND s.y1 = c.Year""",
    "sensor_years": f"""
    WITH named AS (SELECT station_name || ' (' || station_id || ')' AS Station,
        latitude AS Latitude, longitude AS Longitude, sensname AS Sensor,
        year(start_date) AS y1, coalesce(year(end_date), 2003) AS y2
      FROM {inside_sql("sensor_sheet")})
    SELECT c.Station, round(c.Latitude, 6) AS Latitude, round(c.Longitude, 6) AS Longitude,
      c.Year, c.Sensor
    FROM (SELECT Station, Latitude, Longitude, Sensor,
        unnest(range(min(least(y1, y2)), max(greatest(y1, y2)) + 1))::INT AS Year
      FROM named GROUP BY Station, Latitude, Longitude, Sensor) c
    LEFT JOIN named n ON n.Station = c.Station AND n.Sensor = c.Sensor AND n.y1 = c.Year""",
    "sensor_list": 'SELECT num AS "sensor num", description FROM sensor_names',
    "station_sensors": f"""
    SELECT s.Station, round(s.Latitude, 6) AS Latitude, round(s.Longitude, 6) AS Longitude,
      s.Sensors, d.description
    FROM (SELECT "Station Name" || ' (' || STA || ')' AS Station, Latitude, Longitude,
        unnest(coalesce(string_split(Sensors, ','), [NULL])) AS Sensors
      FROM {inside_sql("cdec_sites")}) s
    LEFT JOIN sensor_names d ON s.Sensors = d.num""",
    "station_pages": """
    SELECT Station, p_name AS "Sensor Description", p_partkey::VARCHAR AS "Sensor Number",
      p_brand AS "Duration", p_type AS "Plot", p_size::VARCHAR AS "Data Collection",
      'a & b' AS "Data Available" FROM station_parts
    UNION ALL SELECT Station, 'x', 'x', 'x', 'x', 'x', 'x' FROM station_parts""",
    "station_tables": """
    WITH tables AS (SELECT 'P' || p_partkey::VARCHAR AS Station, * FROM part
      WHERE p_partkey % 10 <> 4)
    SELECT Station, 1 AS row_no, 'Sensor Description|Sensor Number|Duration|Plot|Data Collection|'
      || 'Data Available' AS cells FROM tables WHERE p_partkey % 2 = 0
    UNION ALL SELECT Station, 2 - (p_partkey % 2), concat_ws('|', p_name, p_partkey::VARCHAR,
      p_brand, p_type, p_size::VARCHAR, 'a & b') FROM tables
    UNION ALL SELECT Station, 3 - (p_partkey % 2), 'x|x|x|x|x|x' FROM tables""",
    "landed_lists": """
    SELECT page_id, table_no::INT AS table_no, items FROM (
      SELECT page_id, unnest(range(1, len(lists) + 1)) AS table_no,
        (length(unnest(lists)) - length(replace(unnest(lists), '<li>', ''))) // 4 AS items
      FROM (SELECT page_id, regexp_extract_all(html, '(?s)<ul>.*?</ul>') AS lists FROM pages))
    WHERE items > 0""",
    "station_alias": "SELECT * FROM alias",
    "survey_info": "SELECT CASE WHEN length(Abbreviation) > 3 THEN "
    "'<a href=''https://example.org/' || Abbreviation || '''>' || Survey || '</a>' "
    "ELSE Survey END AS Survey, Abbreviation, "
    + ", ".join(f'{p} AS "{p.replace("_", " ")}"' for p in PARAMETERS)
    + f', years AS "{TOTAL_YEARS}", round(mean, 6) AS "{MEAN_EFFORT}", '
    "'<a href=''https://example.org/data/' || Abbreviation || '''>data</a>' AS \"Data source 1\", "
    f"'' AS \"Data source 2\" FROM (VALUES {survey_values()}) AS s(Survey, Abbreviation) "
    "LEFT JOIN (SELECT Source, max(N_years) AS years, avg(Max) AS mean, "
    + ", ".join(f"CASE WHEN sum({p}) > 0 THEN 'Yes' ELSE '' END AS {p}" for p in PARAMETERS)
    + " FROM sampling GROUP BY 1) f ON s.Abbreviation = f.Source",
    "explore_by_year": f"SELECT {FLAT} FROM sampling WHERE Source IN ({quoted(SOME_SURVEYS)}) "
    f"AND ({ANY_OF_SOME})",
    "explore_average": f"SELECT {FLAT} FROM averaged",
    "explore_fixed": f"SELECT {FLAT} FROM ("
    + averaged_sql(
        f"sampling WHERE Source IN ({quoted(SOME_SURVEYS)}) AND Benthic > 0 "
        "AND Station NOT IN ('EZ2', 'EZ6', 'EZ2-SJR', 'EZ6-SJR')"
    )
    + ")",
    "explore_sites": f"SELECT {FLAT} FROM sampling WHERE Source <> 'EDSM' AND "
    f"(StationID IN (SELECT StationID FROM alias WHERE Station IN ({quoted(STATION_NAMES)})) "
    "OR Station IN ('EZ2', 'EZ6', 'EZ2-SJR', 'EZ6-SJR')) AND Station NOT IN ('EZ6', 'EZ2-SJR')",
    "plot_rows": f"SELECT Source, Station, {tooltip_sql(False)} AS tooltip FROM averaged "
    "WHERE Max BETWEEN 0.5 AND 2",
    "plot_rows_year": f"SELECT Source, Station, {tooltip_sql(True)} AS tooltip FROM sampling "
    f"WHERE Year = {SOME_YEAR}",
    "facet_surveys": f"SELECT * FROM (VALUES {survey_values()}) AS s(Survey, Abbreviation) "
    "WHERE Abbreviation IN (SELECT Source FROM sampling WHERE Benthic > 0)",
    "facet_sites": f"SELECT Station FROM alias WHERE Source IN ({quoted(SOME_SURVEYS)}) "
    "AND Station NOT IN ('EMP EZ2', 'EMP EZ6', 'EMP EZ2-SJR', 'EMP EZ6-SJR')",
    "facet_metrics": "SELECT (row_number() OVER (ORDER BY place, metric))::INT AS position, "
    "metric, label FROM ("
    + " UNION ALL ".join(
        f"SELECT 0 AS place, '{p}' AS metric, '{p.replace('_', ' ')}' AS label WHERE EXISTS "
        f"(SELECT 1 FROM sampling WHERE {p} > 0 AND Source IN ({quoted(SOME_SURVEYS)}))"
        for p in PARAMETERS
    )
    + " UNION ALL SELECT 1, 'Max', 'Max N over all parameters'"
    " UNION ALL SELECT 2, 'N_years', 'Number of years')",
    "facets": f"""
    SELECT 'survey' AS facet, Abbreviation AS name, Survey AS label, NULL::INT AS rank,
      NULL::DOUBLE AS low, NULL::DOUBLE AS high
    FROM (VALUES {survey_values()}) AS s(Survey, Abbreviation)
    WHERE Abbreviation IN (SELECT Source FROM sampling WHERE Benthic > 0)
    UNION ALL SELECT DISTINCT 'site', Station, NULL, NULL::INT, NULL, NULL FROM alias
    WHERE Source IN ({quoted(SOME_SURVEYS)})
      AND Station NOT IN ('EMP EZ2', 'EMP EZ6', 'EMP EZ2-SJR', 'EMP EZ6-SJR')
    UNION ALL """ + " UNION ALL ".join(
        f"SELECT 'metric', '{p}', '{p.replace('_', ' ')}', {at}, NULL, NULL WHERE EXISTS "
        f"(SELECT 1 FROM sampling WHERE {p} > 0 AND Source IN ({quoted(SOME_SURVEYS)}))"
        for at, p in enumerate(sorted(PARAMETERS), start=1)
    ) + """
    UNION ALL VALUES ('metric', 'Max', 'Max N over all parameters', 6, NULL, NULL),
      ('metric', 'N_years', 'Number of years', 7, NULL, NULL)
    UNION ALL SELECT 'effort', 'Max', NULL, NULL, min(Max), max(Max) FROM averaged
    UNION ALL SELECT 'year', 'Year', NULL, NULL, min(Year), max(Year) FROM sampling
    UNION ALL SELECT 'longitude', 'Longitude', NULL, NULL, round(min(Longitude), 6),
      round(max(Longitude), 6) FROM sampling
    UNION ALL SELECT 'latitude', 'Latitude', NULL, NULL, round(min(Latitude), 6),
      round(max(Latitude), 6) FROM sampling""",
    "metric_range": "SELECT min(Max) AS min_effort, max(Max) AS max_effort FROM averaged",
    "year_range": "SELECT min(Year) AS min_year, max(Year) AS max_year FROM sampling",
    "bounding_box": "SELECT round(min(Longitude), 6) AS min_lon, round(max(Longitude), 6) AS "
    "max_lon, round(min(Latitude), 6) AS min_lat, round(max(Latitude), 6) AS max_lat "
    "FROM water_quality",
    "survey_colours": "SELECT DISTINCT Source FROM sampling "
    f"WHERE Source IN ({quoted(SOME_SURVEYS)})",
    "legend_scale": "SELECT Source, Station, round(ln(Fish + 1), 6) AS scaled FROM averaged "
    "WHERE Max BETWEEN 0.1 AND 5",
    "legend_domain": "SELECT round(min(ln(Water_quality + 1)), 6) AS min_scaled, "
    "round(max(ln(Water_quality + 1)), 6) AS max_scaled, "
    "'Water quality effort</br>(samples per year)' AS title FROM averaged",
    "legend_breaks": """
    WITH ends AS (SELECT min(ln(Max + 1)) AS lo, max(ln(Max + 1)) AS hi FROM sampling),
      steps AS (SELECT *, (hi - lo) / 7 AS cell, 10 ** floor(log10((hi - lo) / 7)) AS p FROM ends),
      chosen AS (SELECT *, CASE WHEN 10 * p - cell < 1.5 * (cell - 5 * p) THEN 10 * p
        WHEN 5 * p - cell < 2.75 * (cell - 2 * p) THEN 5 * p
        WHEN 2 * p - cell < 1.5 * (cell - p) THEN 2 * p ELSE p END AS step FROM steps)
    SELECT round_even(exp(n * step) - 1, 0) AS label FROM (SELECT step, unnest(range(
      ceil(lo / step - 1e-7)::BIGINT, floor(hi / step + 1e-7)::BIGINT + 1)) AS n FROM chosen)
    ORDER BY label DESC""",
    "parameter_rows": " UNION ALL ".join(
        f"SELECT StationID, Year, '{p.replace('_', ' ')}' AS Parameter, {p} AS N FROM sampling "
        f"WHERE {p} > 0"
        for p in PARAMETERS
    ),
    "names_in_rows": """
    SELECT p_partkey, split_part(p_name, ' ', 1) AS name FROM part
    UNION ALL SELECT p_partkey, nullif(split_part(p_name, ' ', 3), '') FROM part
    UNION ALL SELECT p_partkey, lower(p_type) FROM part""",
    "names_not_chosen": """
    SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_orderpriority END AS priority
    FROM orders WHERE (o_custkey % 10 = 0 OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
      AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    "null_key_lookup": """
    SELECT status, count(*) AS N, 'status ' || coalesce(status, 'NA') AS label
    FROM (SELECT CASE WHEN o_custkey % 3 <> 0 THEN o_orderstatus END AS status FROM orders)
    GROUP BY 1""",
    "typed_csv": """SELECT 'say "' || Station || '", then' AS Station, Time, count(*) AS N
    FROM ybfmp_zoop GROUP BY ALL""",
    "sheet_scan": """SELECT station_name, station_id, sensname, year(start_date)::INT AS start_year,
      count(*) AS N, count(end_date) AS ended, round(max(latitude), 6) AS latitude,
      round(min(longitude), 6) AS longitude FROM sensor_sheet GROUP BY ALL""",
    "wide_spans": """
    SELECT s_suppkey, width, n_lines, least_cell, last_row FROM supplier,
      (VALUES (2, 1500, NULL, 1500), (1, 1, '1501', 1501)) t(width, n_lines, cell, last_row),
      LATERAL (SELECT coalesce(cell, s_name) AS least_cell)""",
    "stored_sampling": f"SELECT {FLAT} FROM sampling WHERE Source IN ('EMP', 'FMWT')",
    "packaged_table": "SELECT s_suppkey, s_nationkey FROM supplier",
}


def oracle_sql() -> dict[str, str]:
    return {name: PREFIX + sql if not sql.lstrip().startswith("WITH") else _nested(sql)
            for name, sql in ORACLE.items()}


def _nested(sql: str) -> str:
    return PREFIX + "SELECT * FROM (" + sql + ")"
