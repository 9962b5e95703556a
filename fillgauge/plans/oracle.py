"""The same results in DuckDB SQL, written independently of the Spark jobs.

Each query gets the bindings it needs as leading CTEs.
"""

from __future__ import annotations

import re

BINDINGS = {
    "telemetry": """
SELECT event_id, ts, user_id AS station_id, concat('station_', CAST(user_id AS VARCHAR)) AS station_name,
  capacity, bikes, CAST(capacity - bikes AS INT) AS docks,
  CAST(43.33 AS DOUBLE) + CAST(user_id % 10 AS DOUBLE) * CAST(0.005 AS DOUBLE) AS lat,
  CAST(-8.45 AS DOUBLE) + CAST(user_id % 13 AS DOUBLE) * CAST(0.005 AS DOUBLE) AS lon,
  CASE WHEN k % 5 = 0 THEN CAST(k AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS rain,
  CAST(k % 40 AS DOUBLE) AS wind, CAST(5 + k % 20 AS DOUBLE) AS temp, k AS code, event_type
FROM (SELECT *, CAST(13 + user_id % 17 AS INT) AS capacity,
        CAST(CAST(floor(value) AS BIGINT) % (14 + user_id % 17) AS INT) AS bikes,
        CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e""",
    "stations": """
SELECT DISTINCT station_id, station_name, capacity, lat, lon FROM telemetry WHERE station_id % 10 <> 9""",
    "aligned": """
SELECT station_id, frame AS ts, station_name, capacity, bikes, docks, rain, wind, temp FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id, frame ORDER BY ts DESC, event_id DESC) AS rn
  FROM (SELECT *, make_timestamp(epoch_us(ts) - epoch_us(ts) % 300000000) AS frame FROM telemetry) a) b WHERE rn = 1""",
    "spans": """
SELECT *, least(coalesce(lead(ts) OVER (PARTITION BY station_id ORDER BY ts), ts + INTERVAL 1 DAY), ts + INTERVAL 1 DAY) AS until FROM aligned""",
    # each frame that begins or ends a span, with the spans that hold in it
    "ends": """
SELECT ts FROM spans UNION SELECT until AS ts FROM spans WHERE until <= (SELECT max(ts) FROM spans)""",
    "held": """
SELECT e.ts, s.station_id, s.bikes, s.capacity, s.docks FROM ends e LEFT JOIN spans s ON s.ts <= e.ts AND e.ts < s.until""",
    "states": """
SELECT *, CAST((epoch_us(coalesce(lead(ts) OVER (ORDER BY ts), ts + INTERVAL 5 MINUTE)) - epoch_us(ts)) // 300000000 AS BIGINT) AS frames FROM (
  SELECT ts, count(station_id) AS present, CAST(coalesce(sum(bikes), 0) AS BIGINT) AS bikes, CAST(coalesce(sum(capacity), 0) AS BIGINT) AS capacity,
    CAST(coalesce(sum(greatest(0, 2 - bikes)), 0) AS BIGINT) AS short, CAST(count(*) FILTER (bikes < 5) AS BIGINT) AS empty_stations,
    CAST(count(*) FILTER (docks < 2) AS BIGINT) AS full_stations FROM held GROUP BY ts) x""",
    "whole_states": """
SELECT * FROM states WHERE present >= CAST(0.9 AS DOUBLE) * (SELECT count(DISTINCT station_id) FROM spans)""",
    "weather": """
SELECT event_id, ts, temp, rain, wind, code FROM telemetry WHERE event_type = 'view'""",
    "city_b": """
SELECT o_orderkey AS event_id, CAST(o_custkey % 200 AS BIGINT) AS station_id, o_orderdate AS ts,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 25 AS INT) AS bikes,
  CAST(24 - CAST(floor(o_totalprice) AS BIGINT) % 25 AS INT) AS docks FROM orders""",
    "districts": """
SELECT n_name AS district, CAST(coalesce(c.pop, 0) AS BIGINT) AS population, coalesce(c.inc, CAST(0 AS DOUBLE)) AS income,
  CAST(coalesce(c.pop, 0) * (1 + n_nationkey % 7) AS BIGINT) AS density, CAST(coalesce(s.n, 0) AS BIGINT) AS n_stations
FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS pop,
    floor(CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*)) / CAST(100 AS DOUBLE) AS inc
  FROM customer GROUP BY c_nationkey) c ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) s ON s_nationkey = n_nationkey""",
    "history": """
SELECT series, month, new_users, users, uses FROM (
  SELECT n_name AS series, month, new_users, CAST(sum(new_users) OVER w AS BIGINT) AS users, CAST(sum(n) OVER w AS BIGINT) AS uses FROM (
    SELECT c_nationkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n,
      nullif(count(*) FILTER (first_one), 0) AS new_users
    FROM (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) = 1 AS first_one FROM orders) o
    JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) m JOIN nation ON n_nationkey = c_nationkey
  WINDOW w AS (PARTITION BY n_name ORDER BY month ROWS UNBOUNDED PRECEDING)) h
WHERE new_users IS NOT NULL""",
    "scored": """
SELECT event_id, station_id, ts, bikes, CAST(future_bikes < 5 AS INT) AS label,
  round(1 - CAST(bikes AS DOUBLE) / capacity, 2) AS score FROM (
  SELECT *, lead(bikes, 6) OVER (PARTITION BY station_id ORDER BY ts, event_id) AS future_bikes FROM telemetry) x
WHERE future_bikes IS NOT NULL""",
    "assignment": """
SELECT DISTINCT station_id, CAST(station_id % 4 AS INT) AS cluster FROM telemetry""",
    # Derived helpers used by several queries.
    "occ": """
SELECT *, coalesce(CAST(bikes AS DOUBLE) / nullif(capacity, 0), 0) AS occupancy, CAST(hour(ts) AS INT) AS hour,
  CAST(isodow(ts) - 1 AS INT) AS day_of_week FROM telemetry""",
    "deltas": """
SELECT *, CAST(bikes - lag(bikes) OVER (PARTITION BY station_id ORDER BY ts, event_id) AS BIGINT) AS delta FROM telemetry""",
    "future": """
SELECT * FROM (SELECT *, lead(bikes, 6) OVER (PARTITION BY station_id ORDER BY ts, event_id) AS future_bikes,
  lead(docks, 6) OVER (PARTITION BY station_id ORDER BY ts, event_id) AS future_docks FROM telemetry) x
WHERE future_bikes IS NOT NULL""",
    "hourly": """
SELECT * FROM (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_ts, CAST(coalesce(sum(abs(delta)), 0) AS BIGINT) AS activity,
    avg(rain) AS rain, avg(wind) AS wind, avg(temp) AS temp FROM deltas GROUP BY 1) x
WHERE rain IS NOT NULL AND wind IS NOT NULL AND temp IS NOT NULL""",
    "profile": """
SELECT station_id, hour, avg(occupancy) AS occ FROM occ GROUP BY station_id, hour""",
    "dense_profile": """
SELECT s.station_id, h.hour, coalesce(p.occ, 0) AS occ
FROM (SELECT DISTINCT station_id FROM telemetry) s
CROSS JOIN (SELECT CAST(range AS INT) AS hour FROM range(24)) h
LEFT JOIN profile p ON p.station_id = s.station_id AND p.hour = h.hour""",
    "first_city": """
SELECT 'a' AS city, station_id, event_id, ts, bikes, docks, capacity, round(occupancy, 6) AS occupancy, hour, day_of_week,
  CAST(day_of_week >= 5 AS INT) AS is_weekend,
  CAST(hour BETWEEN 7 AND 9 OR hour BETWEEN 14 AND 16 OR hour BETWEEN 18 AND 20 AS INT) AS is_rush_hour,
  CAST(rain > 0 AS INT) AS is_raining, temp AS temperature FROM occ""",
    "second_city": """
SELECT 'b' AS city, station_id, event_id, ts, bikes, docks, nullif(bikes + docks, 0) AS capacity,
  round(coalesce(CAST(bikes AS DOUBLE) / nullif(bikes + docks, 0), 0), 6) AS occupancy,
  CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week,
  CAST(isodow(ts) >= 6 AS INT) AS is_weekend,
  CAST(hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 14 AND 16 OR hour(ts) BETWEEN 18 AND 20 AS INT) AS is_rush_hour
FROM city_b""",
    "hourly_city": """
SELECT 'dc' AS city, ts, hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(isodow(ts) >= 6 AS INT) AS is_weekend,
  CAST(hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19 AS INT) AS is_rush_hour, CAST(weathersit >= 3 AS INT) AS is_raining,
  round(cnt / CAST(max(cnt) OVER () AS DOUBLE), 6) AS occupancy, round(temp / 50 * 47 - 8, 6) AS temperature
FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, CAST(hour(ts) AS INT) AS hour, count(*) AS cnt,
  max(code) % 5 AS weathersit, max(temp) AS temp FROM telemetry GROUP BY 1, 2) x""",
    "cities": """
SELECT * FROM first_city UNION ALL BY NAME SELECT * FROM second_city UNION ALL BY NAME SELECT * FROM hourly_city""",
    "six_hours": """
SELECT station_id, frame AS ts, bikes FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id, frame ORDER BY ts DESC, event_id DESC) AS rn
  FROM (SELECT *, make_timestamp(epoch_us(ts) - epoch_us(ts) % 21600000000) AS frame FROM telemetry) a) b WHERE rn = 1""",
    "moves": """
SELECT * FROM (SELECT *, CAST(bikes - lag(bikes) OVER (PARTITION BY station_id ORDER BY ts) AS BIGINT) AS delta FROM six_hours) x
WHERE delta IS NOT NULL""",
    "flows": """
SELECT from_id, to_id, abs(r) AS strength FROM (
  SELECT a.station_id AS from_id, b.station_id AS to_id, round(
    (n * coalesce(sxy, 0) - a.sx * b.sx) / (sqrt(nullif(CAST(n * a.sxx - a.sx * a.sx AS DOUBLE), 0)) * sqrt(nullif(CAST(n * b.sxx - b.sx * b.sx AS DOUBLE), 0))), 6) AS r
  FROM (SELECT station_id, sum(delta) AS sx, sum(delta * delta) AS sxx FROM moves GROUP BY station_id) a
  JOIN (SELECT station_id, sum(delta) AS sx, sum(delta * delta) AS sxx FROM moves GROUP BY station_id) b ON a.station_id < b.station_id
  CROSS JOIN (SELECT count(DISTINCT ts) AS n FROM moves) t
  LEFT JOIN (SELECT x.station_id AS xa, y.station_id AS yb, sum(x.delta * y.delta) AS sxy FROM moves x JOIN moves y
    ON x.ts = y.ts AND x.station_id < y.station_id GROUP BY 1, 2) p ON p.xa = a.station_id AND p.yb = b.station_id) q
WHERE r < -0.15 ORDER BY strength DESC, from_id, to_id LIMIT 60""",
    "scores": """
SELECT *, round(30.0 * sp / 100, 12) AS wp FROM (
  SELECT *, coalesce(100 * (population - min(population) OVER ()) / nullif(CAST(max(population) OVER () - min(population) OVER () AS DOUBLE), 0), 50) AS sp,
    100 - coalesce(100 * (n_stations - min(n_stations) OVER ()) / nullif(CAST(max(n_stations) OVER () - min(n_stations) OVER () AS DOUBLE), 0), 50) AS sc,
    coalesce(100 * (income - min(income) OVER ()) / nullif(max(income) OVER () - min(income) OVER (), 0), 50) AS si,
    coalesce(100 * (density - min(density) OVER ()) / nullif(CAST(max(density) OVER () - min(density) OVER () AS DOUBLE), 0), 50) AS sd,
    CAST(CASE WHEN n_stations BETWEEN 1 AND 2 THEN 100 WHEN n_stations = 0 THEN 50 ELSE 30 END AS DOUBLE) AS sl
  FROM districts) x""",
    "ranked_districts": """
SELECT *, CASE WHEN score_total <= 0 OR score_total > 100 THEN NULL WHEN score_total <= 40 THEN 'Baja' WHEN score_total <= 60 THEN 'Media' ELSE 'Alta' END AS priority
FROM (SELECT *, round_even(round(0.3 * sp + 0.25 * sc + 0.2 * si + 0.15 * sd + 0.1 * sl, 9), 1) AS score_total FROM scores) y""",
    "points_xy": """
SELECT series, month, CAST(users AS DOUBLE) AS y,
  CAST(round_even(date_diff('day', CAST(min(month) OVER (PARTITION BY series) AS DATE), CAST(month AS DATE)) / CAST(30.44 AS DOUBLE), 0) AS DOUBLE) AS x
FROM history""",
    "regime_xy": """
SELECT series, regime, month, CAST(users AS DOUBLE) AS y, CAST(round_even(date_diff('day',
    CAST(min(month) OVER (PARTITION BY series, regime) AS DATE), CAST(month AS DATE)) / CAST(30.44 AS DOUBLE), 0) AS DOUBLE) AS x,
  count(*) OVER (PARTITION BY series, regime) AS points
FROM (SELECT *, CASE WHEN month < TIMESTAMP '1996-01-01' THEN 'pre' ELSE 'post' END AS regime FROM history) h""",
}


LINE = """
SELECT *, (sz - slope * sx) / n AS intercept FROM (SELECT *, (n * sxz - sx * sz) / nullif(n * sxx - sx * sx, 0) AS slope FROM (
  SELECT series, regime, cand, v, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(z) AS sz, sum(x * x) AS sxx, sum(x * z) AS sxz
  FROM ({points}) a GROUP BY ALL) b) c WHERE slope IS NOT NULL"""


def started(line: str, value: str, kept: str, where: str) -> str:
    """The candidate of the least squared error, of those that lines through transformed points give."""
    return f"""
SELECT series, regime, {kept} FROM (
  SELECT p.series, p.regime, cand, v, slope, intercept, row_number() OVER (PARTITION BY p.series, p.regime
    ORDER BY round(sum((y - {value}) * (y - {value})), 6), cand) AS rn
  FROM regime_xy p JOIN ({line}) f ON f.series = p.series AND f.regime = p.regime WHERE points >= 3 AND {where}
  GROUP BY p.series, p.regime, cand, v, slope, intercept) g WHERE rn = 1"""


def narrowed(best: str, axes: str, grid: str, linear: str, value: str, kept: str, off: str, inside: str = "true") -> str:
    """One grid around the best point of the one before."""
    return f"""
SELECT series, regime, {kept} FROM (
  SELECT *, row_number() OVER (PARTITION BY series, regime ORDER BY sse, off, i, j) AS rn FROM (
    SELECT series, regime, {kept}, {off} AS off, i, j, round(sum((y - {value}) * (y - {value})), 6) AS sse FROM ({linear.format(rows=f"""
      SELECT p.series, p.regime, p.x, p.y, i, j, {grid} FROM ({best}) s CROSS JOIN ({axes}) h JOIN regime_xy p ON p.series = s.series AND p.regime = s.regime""")}) l
    WHERE {inside} GROUP BY ALL) m WHERE sse IS NOT NULL AND isfinite(sse)) n WHERE rn = 1"""


def exponential_sql() -> str:
    points = """SELECT q.series, q.regime, x, cand, low * cand / 20.0::DOUBLE AS v, ln(y - low * cand / 20.0::DOUBLE) AS z FROM regime_xy q
    JOIN (SELECT series, regime, min(y) AS low FROM regime_xy GROUP BY ALL) m ON m.series = q.series AND m.regime = q.regime
    CROSS JOIN (SELECT range AS cand FROM range(20)) g"""
    best = started(LINE.format(points=points), "(exp(intercept) * exp(slope * x) + v)", "0.0 AS a, slope AS b, 0.0 AS c, 0.5 * abs(slope) + 0.005 AS w", "true")
    linear = """SELECT *, avg(y) OVER t - a * avg(e) OVER t AS c FROM (
      SELECT *, sum((e - em) * (y - ym)) OVER t / nullif(sum((e - em) * (e - em)) OVER t, 0) AS a FROM (
        SELECT *, avg(e) OVER t AS em, avg(y) OVER t AS ym FROM (SELECT *, exp(b * x) AS e FROM ({rows}) r1) r2
        WINDOW t AS (PARTITION BY series, regime, i)) r3 WINDOW t AS (PARTITION BY series, regime, i)) r4 WINDOW t AS (PARTITION BY series, regime, i)"""
    axes = "SELECT range AS i, 0 AS j FROM range(-8, 9)"
    for _ in range(6):
        grid = narrowed(best, axes, "b + w * i / 8 AS b, w AS w0", linear, "(a * exp(b * x) + c)", "a, b, c, w0", "abs(i)")
        best = f"SELECT *, w0 / 4 AS w FROM ({grid}) z"
    return f"SELECT series, regime, a, b, c FROM ({best}) f"


def logistic_sql() -> str:
    points = """SELECT q.series, q.regime, x, cand, last_y * (100 + cand) / 100.0::DOUBLE AS v, ln(y / (last_y * (100 + cand) / 100.0::DOUBLE - y)) AS z FROM regime_xy q
    JOIN (SELECT series, regime, max_by(y, month) AS last_y FROM regime_xy GROUP BY ALL) m ON m.series = q.series AND m.regime = q.regime
    CROSS JOIN (SELECT range AS cand FROM range(1, 301)) g WHERE y > 0 AND y < last_y * (100 + cand) / 100.0::DOUBLE"""
    within = "slope BETWEEN 0.001 AND 2.0 AND -intercept / nullif(slope, 0) BETWEEN -50 AND 200"
    best = started(
        LINE.format(points=points), "(v / (1 + exp(-slope * (x + intercept / slope))))",
        "0.0 AS l, slope AS k, -intercept / slope AS x0, 0.5 * slope AS kw, 2.0 / slope AS xw", within,
    )
    linear = """SELECT *, sum(y * g) OVER t / sum(g * g) OVER t AS l FROM (SELECT *, 1 / (1 + exp(-k * (x - x0))) AS g FROM ({rows}) r1) r2
      WINDOW t AS (PARTITION BY series, regime, i, j)"""
    axes = "SELECT i, j FROM (SELECT range AS i FROM range(-4, 5)) a, (SELECT range AS j FROM range(-4, 5)) b"
    for _ in range(10):
        grid = narrowed(
            best, axes, "k + kw * i / 4 AS k, x0 + xw * j / 4 AS x0, kw AS kw0, xw AS xw0", linear, "l * g", "l, k, x0, kw0, xw0",
            "abs(i) + abs(j)", "k BETWEEN 0.001 AND 2.0 AND x0 BETWEEN -50 AND 200",
        )
        best = f"SELECT *, kw0 / 2 AS kw, xw0 / 2 AS xw FROM ({grid}) z"
    return f"SELECT series, regime, l, k, x0 FROM ({best}) f"


def judged(fits: str, value: str, names: str) -> str:
    """The fits of all series and regimes, nulls where there is none, with R2 and mean relative error."""
    return f"""
SELECT p.series, p.regime, {names}, 1 - sum((y - {value}) * (y - {value})) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0) AS r2,
  avg(CASE WHEN y <> 0 THEN abs(y - {value}) / abs(y) END) AS mape, max(month) AS last_month, max(x) AS last_x
FROM regime_xy p LEFT JOIN ({fits}) f ON f.series = p.series AND f.regime = p.regime GROUP BY p.series, p.regime, {names}"""


BINDINGS |= {
    "exponential": judged(exponential_sql(), "(a * exp(b * x) + c)", "a, b, c"),
    "logistic": judged(logistic_sql(), "l / (1 + exp(-k * (x - x0)))", "l, k, x0"),
}


def with_bindings(sql: str) -> str:
    """Prefix ``sql`` with the bindings it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in BINDINGS:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in needed:
                visit(BINDINGS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({BINDINGS[name]})" for name in needed)
    return f"WITH {ctes}\n{sql.strip()}"


def band_sql(value: str, edges, labels, open_ended: bool) -> str:
    if open_ended:
        parts = [f"WHEN {value} <= {e} THEN '{label}'" for e, label in zip(edges, labels)]
        return f"CASE WHEN {value} IS NULL THEN NULL {' '.join(parts)} ELSE '{labels[-1]}' END"
    parts = [f"WHEN {value} <= {e} THEN '{label}'" for e, label in zip(edges[1:], labels)]
    return f"CASE WHEN {value} <= {edges[0]} THEN NULL {' '.join(parts)} END"


def quality_sql(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, str]:
    return {
        "accuracy": f"round(coalesce(CAST({tp} + {tn} AS DOUBLE) / nullif({tp} + {fp} + {fn} + {tn}, 0), 0), 6)",
        "precision": f"round(coalesce(CAST({tp} AS DOUBLE) / nullif({tp} + {fp}, 0), 0), 6)",
        "recall": f"round(coalesce(CAST({tp} AS DOUBLE) / nullif({tp} + {fn}, 0), 0), 6)",
        "f1": f"round(coalesce(CAST(2 * {tp} AS DOUBLE) / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 6)",
    }


def quality_list(*names: str) -> str:
    q = quality_sql()
    return ", ".join(f'{q[n]} AS "{n}"' for n in names)


def confusion_sql(label: str, guess: str) -> str:
    return (
        f"CAST(count(*) FILTER (({label}) AND ({guess})) AS BIGINT) AS tp, "
        f"CAST(count(*) FILTER (NOT ({label}) AND ({guess})) AS BIGINT) AS fp, "
        f"CAST(count(*) FILTER (({label}) AND NOT ({guess})) AS BIGINT) AS fn, "
        f"CAST(count(*) FILTER (NOT ({label}) AND NOT ({guess})) AS BIGINT) AS tn"
    )


ALL4 = ("accuracy", "precision", "recall", "f1")
DAYS = "CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0::DOUBLE) AS BIGINT) + 1"
WEEKDAY = "CAST(isodow(ts) - 1 AS INT)"
RUSH = "CAST(hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 14 AND 16 OR hour(ts) BETWEEN 18 AND 20 AS INT)"
FRAME = "make_timestamp(epoch_us(ts) - epoch_us(ts) % 300000000)"

SQL: dict[str, str] = {}

# --- sources ---------------------------------------------------------------------

SQL["scan_tracking"] = """
SELECT ts, station_id, station_name, round(lat, 6) AS lat, round(lon, 6) AS lon, capacity, bikes, docks,
  round(temp, 6) AS temp, round(rain, 6) AS rain, round(wind, 6) AS wind FROM telemetry"""
SQL["flatten_station_info"] = """
SELECT station_id, station_name, round(lat, 6) AS lat, round(lon, 6) AS lon,
  CASE WHEN capacity < 16 THEN 0 ELSE capacity END AS capacity FROM stations"""
SQL["flatten_station_status"] = """
SELECT station_id, bikes, docks FROM telemetry"""
SQL["parse_weather"] = "SELECT event_id, temp, rain, wind, code FROM weather WHERE code <= 90"
SQL["polygon_centroids"] = """
SELECT CAST(n_nationkey AS BIGINT) AS district_id, CASE WHEN n_nationkey % 7 = 0 THEN 'Desconocido' ELSE n_name END AS name,
  CASE WHEN n_nationkey % 10 <> 9 THEN round(CAST(n_nationkey AS DOUBLE) + 0.4, 6) END AS lon,
  CASE WHEN n_nationkey % 10 <> 9 THEN CAST(0.4 AS DOUBLE) END AS lat FROM nation"""
SQL["load_hourly_city"] = "SELECT * FROM hourly_city"
SQL["load_station_city"] = "SELECT * FROM second_city"
SQL["unify_cities"] = "SELECT * FROM cities"
SQL["sample_and_cap"] = "SELECT * FROM city_b WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 20 = 0"
SQL["publish_tracking"] = "SELECT * REPLACE (round(lat, 6) AS lat, round(lon, 6) AS lon) FROM telemetry"
SQL["export_frames"] = f"""
SELECT frame_ts, part,
  CASE isodow(frame_ts) WHEN 1 THEN 'Lunes' WHEN 2 THEN 'Martes' WHEN 3 THEN 'Miércoles' WHEN 4 THEN 'Jueves'
    WHEN 5 THEN 'Viernes' WHEN 6 THEN 'Sábado' ELSE 'Domingo' END AS day,
  strftime(frame_ts, '%d/%m') AS date, strftime(frame_ts, '%H:%M') AS hour,
  CAST(to_json(list(struct_pack(station_id := station_id, name := station_name, lat := lat, lon := lon, capacity := capacity,
    bikes := bikes, occupancy := occupancy) ORDER BY station_id)) AS VARCHAR) AS stations,
  count(*) AS n_stations, round(sum(bikes), 6) AS bikes_sum
FROM (SELECT {FRAME} AS frame_ts, CAST(floor(station_id / 1000.0::DOUBLE) AS BIGINT) AS part, station_id,
    min(station_name) AS station_name, round(min(lat), 6) AS lat, round(min(lon), 6) AS lon, min(capacity) AS capacity,
    round(avg(bikes), 6) AS bikes, round(avg(occupancy), 6) AS occupancy
  FROM occ GROUP BY 1, 2, 3) x GROUP BY frame_ts, part"""

# --- features --------------------------------------------------------------------

SQL["occupancy_ratio"] = """
SELECT station_id, ts, capacity, round(coalesce(CAST(bikes AS DOUBLE) / nullif(capacity, 0), 0), 6) AS occupancy FROM (
  SELECT station_id, ts, bikes, coalesce(nullif(CASE WHEN code % 9 = 1 THEN 0 WHEN code % 9 <> 0 THEN capacity END, 0), bikes + docks) AS capacity
  FROM telemetry) x"""
SQL["calendar_features"] = """
SELECT station_id, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, hour, day_of_week, CAST(month(ts) AS INT) AS month, dayname(ts) AS day_name,
  CAST(day_of_week >= 5 AS INT) AS is_weekend FROM occ"""
SQL["rush_hour_flag"] = f"SELECT station_id, ts, {RUSH} AS is_rush_hour FROM telemetry"
SQL["holiday_flag"] = """
SELECT station_id, ts, CAST(CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-06') AS INT) AS is_holiday FROM telemetry"""
SQL["season_and_service_filter"] = """
SELECT station_id, ts, CAST(month(ts) BETWEEN 6 AND 9 AS INT) AS is_tourist_season FROM telemetry
WHERE hour(ts) >= 7 OR hour(ts) < 1"""
SQL["weather_label"] = """
SELECT station_id, ts, CASE WHEN code = 0 THEN 'clear' WHEN code <= 3 THEN 'cloudy' WHEN code BETWEEN 51 AND 67 THEN 'rain'
  WHEN code BETWEEN 71 AND 77 THEN 'snow' WHEN code BETWEEN 80 AND 82 THEN 'showers' WHEN code >= 95 THEN 'storm' ELSE 'other' END AS weather_type
FROM telemetry"""
SQL["cyclic_encode"] = """
SELECT station_id, ts, round(sin(2 * pi() * hour / 24.0::DOUBLE), 6) AS hour_sin, round(cos(2 * pi() * hour / 24.0::DOUBLE), 6) AS hour_cos,
  round(sin(2 * pi() * day_of_week / 7.0::DOUBLE), 6) AS day_of_week_sin, round(cos(2 * pi() * day_of_week / 7.0::DOUBLE), 6) AS day_of_week_cos FROM occ"""
SQL["status_flags"] = """
SELECT station_id, ts, CAST(bikes < 5 AS INT) AS is_empty, CAST(docks < 2 AS INT) AS is_full, CAST(bikes < 2 AS INT) AS is_stockout,
  CAST(bikes = 0 AS INT) AS is_zero, CAST(CAST(bikes AS DOUBLE) < 0.2::DOUBLE * capacity AS INT) AS is_low_pct FROM telemetry"""
SQL["minmax_scale"] = """
SELECT station_id, ts, round((temp - min(temp) OVER ()) / (max(temp) OVER () - min(temp) OVER () + 0.001::DOUBLE), 6) AS temp_norm,
  round(wind / (max(wind) OVER () + 0.001::DOUBLE), 6) AS wind_norm, CAST(rain > 0 AS INT) AS is_raining FROM telemetry"""
SQL["zscore_by_group"] = """
SELECT city, event_id, ts, round((bikes - avg(bikes) OVER w) / CASE WHEN stddev_samp(bikes) OVER w = 0 THEN 1 ELSE stddev_samp(bikes) OVER w END, 6) AS zscore
FROM cities WINDOW w AS (PARTITION BY city)"""
SQL["band_label"] = f"""
SELECT event_id, ts, round(v, 6) AS value, {band_sql("v", (-0.1, -0.02, 0.02, 0.1), ("bajada_fuerte", "bajada", "estable", "subida", "subida_fuerte"), True)} AS band
FROM (SELECT event_id, ts, occupancy - 0.5::DOUBLE AS v FROM occ) x"""
SQL["occupancy_band"] = """
SELECT station_id, CASE WHEN o < 0.3 THEN 'low' WHEN o < 0.6 THEN 'mid' ELSE 'high' END AS occupancy_band,
  CASE WHEN e <= 2 THEN 'low' WHEN e <= 5 THEN 'medium' WHEN e <= 10 THEN 'high' ELSE 'critical' END AS risk_band,
  round(least(greatest(4 + e / 2.5::DOUBLE, 4), 12), 6) AS radius, round(least(greatest(m * 1.2::DOUBLE, 5), 16), 6) AS level_radius
FROM (SELECT station_id, round(avg(occupancy), 6) AS o, round(100 * avg(CAST(bikes = 0 AS INT)), 6) AS e, avg(bikes) AS m FROM occ GROUP BY station_id) x"""
SQL["complete_cases"] = """
SELECT event_id, station_id, ts, CASE WHEN coverage > 0.9 THEN rain END AS rain, round(coverage, 6) AS coverage FROM (
  SELECT *, avg(CAST(rain IS NOT NULL AS INT)) OVER () AS coverage FROM (
    SELECT event_id, station_id, ts, bikes, CASE WHEN code % 11 <> 0 THEN wind END AS wind, CASE WHEN code % 7 <> 0 THEN rain END AS rain FROM telemetry) x) y
WHERE bikes IS NOT NULL AND wind IS NOT NULL AND (coverage <= 0.9 OR rain IS NOT NULL)"""
SQL["transfer_features"] = """
SELECT city, station_id, event_id, ts AS timestamp, hour, round(sin(2 * pi() * hour / 24.0::DOUBLE), 6) AS hour_sin,
  round(cos(2 * pi() * hour / 24.0::DOUBLE), 6) AS hour_cos, day_of_week, round(sin(2 * pi() * day_of_week / 7.0::DOUBLE), 6) AS dow_sin,
  round(cos(2 * pi() * day_of_week / 7.0::DOUBLE), 6) AS dow_cos, is_weekend, is_rush_hour, 0 AS is_holiday, coalesce(is_raining, 0) AS is_raining,
  round(o, 6) AS occupancy,
  round((temperature - avg(temperature) OVER w) / CASE WHEN stddev_samp(temperature) OVER w = 0 THEN 1 ELSE stddev_samp(temperature) OVER w END, 6) AS temp_zscore,
  CASE WHEN station_id IS NOT NULL THEN delta_next END AS delta_30min,
  delta_next, coalesce(CAST(delta_next > 0.1 AS INT), 0) AS will_increase, coalesce(CAST(delta_next < -0.1 AS INT), 0) AS will_decrease
FROM (SELECT *, round(CASE WHEN station_id IS NULL THEN lead(o, 1) OVER s ELSE lead(o, 6) OVER s END - o, 6) AS delta_next
  FROM (SELECT *, least(greatest(occupancy, 0), 1) AS o FROM cities) c
  WINDOW s AS (PARTITION BY city, station_id ORDER BY ts, event_id)) x WINDOW w AS (PARTITION BY city)"""
SQL["bike_delta"] = "SELECT event_id, station_id, ts, delta, abs(delta) AS abs_delta FROM deltas"
SQL["trend_features"] = """
SELECT event_id, round(coalesce((bikes - b3) / (capacity + 0.001::DOUBLE), 0), 6) AS trend_15min, CAST(velocity AS BIGINT) AS velocity,
  CAST(coalesce(velocity - lag(velocity) OVER (PARTITION BY station_id ORDER BY ts, event_id), 0) AS BIGINT) AS acceleration
FROM (SELECT *, lag(bikes, 3) OVER w AS b3, coalesce(bikes - lag(bikes) OVER w, 0) AS velocity FROM telemetry
  WINDOW w AS (PARTITION BY station_id ORDER BY ts, event_id)) x"""
SQL["future_status_target"] = """
SELECT event_id, CAST(future_bikes AS BIGINT) AS future_bikes, CAST(future_bikes < 5 AS INT) AS will_be_empty,
  CAST(future_docks < 2 AS INT) AS will_be_full, CAST(future_bikes < 5 OR future_docks < 2 AS INT) AS will_have_problem FROM future"""
SQL["delta_target"] = """
SELECT event_id, d AS delta_next, coalesce(CAST(d > 0.1 AS INT), 0) AS will_increase, coalesce(CAST(d < -0.1 AS INT), 0) AS will_decrease FROM (
  SELECT event_id, round(lead(o, 6) OVER (PARTITION BY station_id ORDER BY ts, event_id) - o, 6) AS d
  FROM (SELECT *, least(greatest(occupancy, 0), 1) AS o FROM occ) x) y"""
SQL["time_split"] = """
SELECT event_id, station_id, CASE WHEN n < 2 OR rn <= greatest(1, least(floor(n * 0.8::DOUBLE), n - 1)) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT event_id, station_id, row_number() OVER (PARTITION BY station_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM telemetry) x"""
SQL["time_horizon_target"] = """
SELECT event_id, CAST(CASE WHEN epoch_us(t) - epoch_us(target) <= 43200000000 THEN b END AS BIGINT) AS future_bikes,
  CAST(CASE WHEN epoch_us(t) - epoch_us(target) <= 43200000000 THEN b < 5 END AS INT) AS will_be_empty
FROM (SELECT l.event_id, l.target, r.ts AS t, r.bikes AS b FROM (SELECT *, ts + INTERVAL 30 MINUTE AS target FROM telemetry) l
  ASOF LEFT JOIN telemetry r ON l.station_id = r.station_id AND l.target <= r.ts) x"""
SQL["random_split"] = "SELECT event_id, CASE WHEN CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM telemetry"

# --- joins -----------------------------------------------------------------------

SQL["enrich_status"] = """
SELECT t.station_id, s.station_name, round(s.lat, 6) AS lat, round(s.lon, 6) AS lon, s.capacity, t.bikes, t.docks, t.ts
FROM telemetry t JOIN stations s ON s.station_id = t.station_id"""
SQL["weather_asof"] = """
SELECT t.station_id, t.ts, t.event_id, w.temp, coalesce(w.rain, 0) AS rain, coalesce(w.wind, 0) AS wind, coalesce(w.code, 0) AS code
FROM (SELECT * FROM telemetry WHERE event_type <> 'view') t ASOF LEFT JOIN weather w ON t.ts >= w.ts"""
SQL["stats_with_cluster"] = """
SELECT o.station_id AS station, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(avg(capacity), 6) AS capacity,
  round(avg(bikes), 6) AS bikes, round(avg(occupancy), 6) AS occupancy, min(a.cluster) AS cluster
FROM occ o LEFT JOIN (SELECT * FROM assignment SEMI JOIN stations USING (station_id)) a ON a.station_id = o.station_id GROUP BY o.station_id"""
SQL["merge_coverage"] = """
SELECT d.district, coalesce(c.n_stations, 1) AS n_stations FROM districts d
LEFT JOIN (SELECT * FROM districts WHERE n_stations > 2) c ON c.district = d.district"""
SQL["flow_geometry"] = """
SELECT round(a.lat, 6) AS from_lat, round(a.lon, 6) AS from_lon, round(b.lat, 6) AS to_lat, round(b.lon, 6) AS to_lon, f.strength
FROM flows f JOIN stations a ON a.station_id = f.from_id JOIN stations b ON b.station_id = f.to_id"""
SQL["coverage_radius"] = """
SELECT point_id, CAST(count(s.station_id) AS BIGINT) AS n_stations FROM (
  SELECT CAST(floor(station_id / 25.0::DOUBLE) AS BIGINT) AS point_id, round(avg(lat), 4) AS plat, round(avg(lon), 4) AS plon FROM telemetry GROUP BY 1) p
LEFT JOIN stations s ON 2 * 6371000.0::DOUBLE * asin(sqrt(least(1, pow(sin((radians(s.lat) - radians(plat)) / 2), 2)
  + cos(radians(plat)) * cos(radians(s.lat)) * pow(sin((radians(s.lon) - radians(plon)) / 2), 2)))) <= 1500 GROUP BY point_id"""

# --- aggregations ----------------------------------------------------------------

SQL["system_overview"] = f"""
SELECT first_ts, last_ts, days, n_stations, capacity_total, n_obs, round(n_obs / CAST(days AS DOUBLE), 6) AS obs_per_day FROM (
  SELECT min(ts) AS first_ts, max(ts) AS last_ts, {DAYS} AS days, count(DISTINCT station_id) AS n_stations, count(*) AS n_obs,
    (SELECT CAST(sum(c) AS BIGINT) FROM (SELECT min_by(capacity, ts) AS c FROM telemetry GROUP BY station_id)) AS capacity_total FROM telemetry) x"""
SQL["system_health"] = """
SELECT round(e, 6) AS pct_empty, round(f, 6) AS pct_full, round(100 - e - f, 6) AS pct_ok, round(o, 6) AS occupancy_pct FROM (
  SELECT 100 * avg(CAST(bikes < 5 AS INT)) AS e, 100 * avg(CAST(docks < 2 AS INT)) AS f, 100 * avg(occupancy) AS o FROM occ) x"""
SNAPSHOT = """count(*) AS total_stations, CAST(sum(bikes) AS BIGINT) AS total_bikes, CAST(sum(capacity) AS BIGINT) AS total_capacity,
    CAST(sum(CAST(bikes < 5 AS INT)) AS BIGINT) AS empty_stations, CAST(sum(CAST(docks < 2 AS INT)) AS BIGINT) AS full_stations"""
SCORE = "round(greatest(0, 100 - 150.0::DOUBLE * empty_stations / total_stations - 150.0::DOUBLE * full_stations / total_stations), 6) AS health_score"
SQL["snapshot_health"] = f"""
SELECT *, CASE WHEN total_stations > 0 THEN {SCORE.removesuffix(" AS health_score")} END AS health_score FROM (
  SELECT ts, present AS total_stations, bikes AS total_bikes, capacity AS total_capacity, empty_stations, full_stations, frames FROM states) x"""
SQL["distinct_stations"] = """
SELECT CAST(date AS VARCHAR) AS date, n_obs, keys_of_day,
  (SELECT count(DISTINCT station_id) FROM telemetry t WHERE date_trunc('month', t.ts) = date_trunc('month', d.date)) AS keys_of_month,
  CAST(sum(new_keys) OVER (ORDER BY date) AS BIGINT) AS keys_so_far
FROM (SELECT date, count(*) AS n_obs, count(DISTINCT station_id) AS keys_of_day, count(DISTINCT station_id) FILTER (first_day = date) AS new_keys
  FROM (SELECT CAST(ts AS DATE) AS date, station_id, min(CAST(ts AS DATE)) OVER (PARTITION BY station_id) AS first_day FROM telemetry) x GROUP BY date) d"""
SQL["station_stats"] = """
SELECT station_id, round(avg(bikes), 6) AS bikes, round(avg(capacity), 6) AS capacity, round(100 * avg(occupancy), 6) AS occupancy_pct,
  round(100 * avg(CAST(bikes < 5 AS INT)), 6) AS pct_empty, round(100 * avg(CAST(docks < 2 AS INT)), 6) AS pct_full FROM occ GROUP BY station_id"""
SQL["over_under_utilised"] = """
SELECT * FROM (
  SELECT 'over' AS kind, row_number() OVER (ORDER BY o DESC, station_id) AS rank, station_id, o AS occupancy_pct
  FROM (SELECT station_id, round(100 * avg(occupancy), 6) AS o FROM occ GROUP BY station_id) a WHERE o > 55
  UNION ALL
  SELECT 'under' AS kind, row_number() OVER (ORDER BY o, station_id) AS rank, station_id, o AS occupancy_pct
  FROM (SELECT station_id, round(100 * avg(occupancy), 6) AS o FROM occ GROUP BY station_id) b WHERE o < 42) x WHERE rank <= 5"""
SQL["ghost_stations"] = """
SELECT station_id, round(stddev_samp(bikes), 6) AS bikes_std FROM telemetry GROUP BY station_id HAVING round(stddev_samp(bikes), 6) < 5"""
SQL["activity_ranking"] = """
SELECT kind, rank, station_id, std, mean, round(std / nullif(cap, 0) * 100, 6) AS rel_use FROM (
  SELECT 'most' AS kind, row_number() OVER (ORDER BY std DESC, station_id) AS rank, * FROM (SELECT station_id, round(stddev_samp(bikes), 6) AS std,
    round(avg(bikes), 6) AS mean, min_by(capacity, ts) AS cap FROM telemetry GROUP BY station_id) a WHERE std IS NOT NULL
  UNION ALL
  SELECT 'least' AS kind, row_number() OVER (ORDER BY std, station_id) AS rank, * FROM (SELECT station_id, round(stddev_samp(bikes), 6) AS std,
    round(avg(bikes), 6) AS mean, min_by(capacity, ts) AS cap FROM telemetry GROUP BY station_id) b WHERE std IS NOT NULL) x WHERE rank <= 10"""
SQL["activity_by_band"] = """
SELECT band, round(a, 6) AS activity,
  round(coalesce(100 * a / nullif(sum(a) FILTER (band IN ('morning', 'afternoon', 'evening')) OVER (), 0), 0), 6) AS share_pct,
  CAST(a = max(a) OVER () AS INT) AS is_peak
FROM (SELECT CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 15 THEN 'midday' WHEN h < 20 THEN 'afternoon' ELSE 'evening' END AS band, avg(a) AS a
  FROM (SELECT hour(ts) AS h, avg(abs(delta)) AS a FROM deltas GROUP BY 1) x GROUP BY 1) y"""
SQL["peak_hours"] = """
SELECT (SELECT hour FROM h ORDER BY occ DESC, hour LIMIT 1) AS hour_max, (SELECT max(occ) FROM h) AS occ_max,
  (SELECT hour FROM h ORDER BY occ, hour LIMIT 1) AS hour_min, (SELECT min(occ) FROM h) AS occ_min
FROM (SELECT 1) one"""
SQL["weekday_pattern"] = """
SELECT day_of_week, round(100 * avg(occupancy), 6) AS occupancy_pct,
  round(max((SELECT 100 * avg(occupancy) FROM occ WHERE day_of_week < 5)), 6) AS weekday_pct,
  round(max((SELECT 100 * avg(occupancy) FROM occ WHERE day_of_week >= 5)), 6) AS weekend_pct,
  round(max((SELECT 100 * avg(occupancy) FROM occ WHERE day_of_week < 5) - (SELECT 100 * avg(occupancy) FROM occ WHERE day_of_week >= 5)), 6) AS diff
FROM occ GROUP BY day_of_week"""
SQL["rain_occupancy_impact"] = """
SELECT round(d, 6) AS occ_dry, round(w, 6) AS occ_wet, round(w - d, 6) AS diff, round(m, 6) AS temp_mean, lo AS temp_min, hi AS temp_max FROM (
  SELECT 100 * avg(occupancy) FILTER (rain <= 0) AS d, 100 * avg(occupancy) FILTER (rain > 0) AS w, avg(temp) AS m, min(temp) AS lo, max(temp) AS hi FROM occ) x
WHERE m IS NOT NULL"""
SQL["weather_activity_impact"] = """
SELECT factor, hours_low, hours_high, round(al, 6) AS act_low, round(ah, 6) AS act_high, round(100 * (ah - al) / nullif(al, 0), 6) AS impact_pct FROM (
  SELECT 'rain' AS factor, count(*) FILTER (round(rain, 9) <= 0.1) AS hours_low, count(*) FILTER (round(rain, 9) > 0.1) AS hours_high,
    avg(activity) FILTER (round(rain, 9) <= 0.1) AS al, avg(activity) FILTER (round(rain, 9) > 0.1) AS ah FROM hourly
  UNION ALL
  SELECT 'wind' AS factor, count(*) FILTER (round(wind, 9) <= 20), count(*) FILTER (round(wind, 9) > 20),
    avg(activity) FILTER (round(wind, 9) <= 20), avg(activity) FILTER (round(wind, 9) > 20) FROM hourly) x"""
SQL["weather_correlation"] = """
SELECT 'rain' AS factor, round(corr(activity, rain), 6) AS r FROM hourly
UNION ALL SELECT 'wind', round(corr(activity, wind), 6) FROM hourly
UNION ALL SELECT 'temp', round(corr(activity, temp), 6) FROM hourly"""
SQL["trips_and_co2"] = f"""
SELECT rentals, round(rentals / CAST(days AS DOUBLE), 6) AS per_day, round(rentals * 2.5::DOUBLE, 6) AS km, round(rentals * 0.3::DOUBLE, 6) AS co2_kg,
  round(rentals * 0.3::DOUBLE / days, 6) AS co2_day, round(rentals * 0.3::DOUBLE / days * 365, 6) AS co2_year, round(rentals * 0.3::DOUBLE / days * 365 / 21, 6) AS trees
FROM (SELECT CAST(coalesce(sum(-delta) FILTER (delta < 0), 0) AS BIGINT) AS rentals, {DAYS} AS days FROM deltas) x"""
SQL["fleet_utilisation"] = """
SELECT capacity, round(m, 6) AS bikes_mean, bikes_min, bikes_max, round(100 * m / nullif(capacity, 0), 6) AS occupancy_pct,
  round(m - capacity * 0.5::DOUBLE, 6) AS diff,
  CASE WHEN m - capacity * 0.5::DOUBLE > 50 THEN 'excess' WHEN m - capacity * 0.5::DOUBLE < -50 THEN 'shortage' ELSE 'balanced' END AS verdict
FROM (SELECT min_by(capacity, ts) AS capacity, CAST(sum(bikes * frames) AS DOUBLE) / sum(frames) AS m, min(bikes) AS bikes_min, max(bikes) AS bikes_max
  FROM whole_states) x"""
SQL["atypical_days"] = """
SELECT CAST(date AS VARCHAR) AS date, activity, round(m, 6) AS mean, round(s, 6) AS std, CASE WHEN activity > m THEN 'MUY ACTIVO' ELSE 'MUY INACTIVO' END AS kind FROM (
  SELECT *, avg(activity) OVER () AS m, stddev_samp(activity) OVER () AS s FROM (
    SELECT CAST(ts AS DATE) AS date, CAST(coalesce(sum(abs(delta)), 0) AS BIGINT) AS activity FROM deltas GROUP BY 1) x) y
WHERE abs(activity - m) > 1.5 * s"""
SQL["stockout_heatmap"] = """
SELECT CAST(d.range AS INT) AS day_of_week, CAST(h.range AS INT) AS hour, CAST(count(o.event_id) AS BIGINT) AS events
FROM range(7) d CROSS JOIN range(24) h LEFT JOIN (SELECT * FROM occ WHERE bikes < 2) o ON o.day_of_week = d.range AND o.hour = h.range GROUP BY 1, 2"""
SQL["occupancy_heatmap"] = """
SELECT day_of_week, hour, round(100 * avg(occupancy), 6) AS occupancy_pct FROM occ GROUP BY day_of_week, hour"""
SQL["stockout_roi"] = """
SELECT round(h, 6) AS hours_lost, t AS trips_lost, round(t * 0.8::DOUBLE, 6) AS value, CAST(floor(round(t * 0.02::DOUBLE, 6)) AS BIGINT) AS churners,
  round(t * 0.8::DOUBLE * 52 / 1000, 6) AS value_year_k
FROM (SELECT n * 5 / 60.0::DOUBLE AS h, CAST(floor(round(n * 5 / 60.0::DOUBLE * 3.4::DOUBLE, 6)) AS BIGINT) AS t FROM (SELECT count(*) AS n FROM telemetry WHERE bikes < 2) x) y"""
SQL["downtime_top"] = """
SELECT *, CASE WHEN downtime_pct > 15 THEN 'Ampliar Docks (+5)' ELSE 'Rebalanceo Prioritario' END AS action FROM (
  SELECT station_id, count(*) AS total_pings, count(*) FILTER (bikes < 2) AS stockout_pings, round(100.0::DOUBLE * count(*) FILTER (bikes < 2) / count(*), 6) AS downtime_pct
  FROM telemetry GROUP BY station_id ORDER BY downtime_pct DESC, station_id LIMIT 5) x"""
SQL["depletion_sla"] = """
SELECT round(d / 5 * 60, 6) AS bikes_per_hour, round(5 / (d / 5), 6) AS minutes_to_empty
FROM (SELECT avg(-delta) AS d FROM deltas WHERE delta < 0 AND hour(ts) BETWEEN 7 AND 10) x WHERE d IS NOT NULL"""
SQL["cluster_scorecard"] = """
SELECT cluster, round(stddev_samp(bikes), 6) AS bikes_std, round(100 * avg(CAST(bikes < 2 AS INT)), 6) AS stockout_pct
FROM telemetry t JOIN assignment a ON a.station_id = t.station_id GROUP BY cluster"""
SQL["fleet_deficit"] = """
SELECT fleet, docks, peak_deficit, worst_ts, fleet + peak_deficit AS optimal_fleet, round(100 * peak_deficit / CAST(nullif(fleet, 0) AS DOUBLE), 6) AS growth_pct FROM (
  SELECT (SELECT max(bikes) FROM states) AS fleet,
    (SELECT CAST(sum(c) AS BIGINT) FROM (SELECT max(capacity) AS c FROM spans GROUP BY station_id)) AS docks,
    (SELECT max(d) FROM g) AS peak_deficit, (SELECT ts FROM g ORDER BY d DESC, ts LIMIT 1) AS worst_ts FROM (SELECT 1) one) x"""
SQL["complete_snapshots"] = """
SELECT ts, until, station_id, station_name, capacity, bikes, rain, wind, temp FROM spans WHERE ts IN (SELECT ts FROM whole_states)"""
SQL["empty_time_risk"] = """
SELECT station_id, count(*) AS total_obs, count(*) FILTER (bikes = 0) AS empty_obs, round(100.0::DOUBLE * count(*) FILTER (bikes = 0) / count(*), 6) AS empty_pct,
  round(count(*) FILTER (bikes = 0) * 5 / 60.0::DOUBLE, 6) AS hours_lost FROM telemetry GROUP BY station_id"""
RISK = "(SELECT station_id, round(100.0::DOUBLE * count(*) FILTER (bikes = 0) / count(*), 6) AS p, count(*) FILTER (bikes = 0) AS e FROM telemetry GROUP BY station_id)"
SQL["network_risk"] = f"""
SELECT round(avg(p), 6) AS mean_empty_pct, count(*) FILTER (p > 10) AS n_high,
  (SELECT station_id FROM {RISK} y ORDER BY p DESC, station_id LIMIT 1) AS worst_station, max(p) AS worst_pct FROM {RISK} x"""
SQL["frame_stats"] = f"""
SELECT frame_ts, round(100 * avg(o), 6) AS occupancy_pct, count(*) FILTER (b < 5) AS empty_stations, round(sum(b), 6) AS total_bikes
FROM (SELECT {FRAME} AS frame_ts, station_id, avg(bikes) AS b, avg(occupancy) AS o FROM occ GROUP BY 1, 2) x GROUP BY frame_ts"""
SQL["hourly_profile"] = "SELECT station_id, " + ", ".join(
    f"round(coalesce(avg(occupancy) FILTER (hour = {h}), 0), 6) AS h{h}" for h in range(24)
) + " FROM occ GROUP BY station_id"
SQL["city_summary"] = """
SELECT city, round(avg(occupancy), 6) AS occ_mean, round(stddev_samp(occupancy), 6) AS occ_std, count(occupancy) AS n,
  round(avg(is_rush_hour), 6) AS rush_mean, round(avg(is_weekend), 6) AS weekend_mean FROM cities GROUP BY city"""
SQL["station_mode"] = """
SELECT station_id, CAST(bikes AS BIGINT) AS mode_bikes, n, CASE WHEN bikes <= 0 THEN 'shortage' WHEN bikes >= cap THEN 'saturation' ELSE 'normal' END AS state FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY n DESC, bikes) AS rn FROM (
    SELECT station_id, bikes, count(*) AS n, max(capacity) AS cap FROM telemetry GROUP BY station_id, bikes) x) y WHERE rn = 1"""
SQL["capacity_frequency"] = """
SELECT capacity, count(*) AS n_stations FROM (SELECT station_id, min_by(capacity, ts) AS capacity FROM telemetry GROUP BY station_id) x GROUP BY capacity"""
SQL["service_level"] = f"""
SELECT round(100 - avg(p), 6) AS availability_pct,
  round(100.0::DOUBLE * (SELECT sum(e) FROM (SELECT e FROM {RISK} y ORDER BY e DESC, station_id LIMIT 5)) / nullif(sum(e), 0), 6) AS worst_share_pct FROM {RISK} x"""
SQL["health_report"] = f"""
SELECT 'overview' AS section, 'days' AS metric, CAST({DAYS} AS VARCHAR) AS value FROM telemetry
UNION ALL SELECT 'overview', 'n_stations', CAST(count(DISTINCT station_id) AS VARCHAR) FROM telemetry
UNION ALL SELECT 'overview', 'capacity_total', CAST(sum(c) AS VARCHAR) FROM (SELECT min_by(capacity, ts) AS c FROM telemetry GROUP BY station_id) a
UNION ALL SELECT 'overview', 'n_obs', CAST(count(*) AS VARCHAR) FROM telemetry
UNION ALL SELECT 'costs', 'trips_lost', CAST(t AS VARCHAR) FROM (SELECT CAST(floor(round(count(*) * 5 / 60.0::DOUBLE * 3.4::DOUBLE, 6)) AS BIGINT) AS t FROM telemetry WHERE bikes < 2) b
UNION ALL SELECT 'costs', 'churners', CAST(CAST(floor(round(t * 0.02::DOUBLE, 6)) AS BIGINT) AS VARCHAR)
  FROM (SELECT CAST(floor(round(count(*) * 5 / 60.0::DOUBLE * 3.4::DOUBLE, 6)) AS BIGINT) AS t FROM telemetry WHERE bikes < 2) c"""

# --- pairs and clusters ----------------------------------------------------------

SQL["infer_flows"] = "SELECT * FROM flows"
SQL["twin_stations"] = """
SELECT kind, rank, a, b, r, n_hours FROM (
  SELECT 'opposite' AS kind, row_number() OVER (ORDER BY r, a, b) AS rank, * FROM pr WHERE r < -0.6
  UNION ALL SELECT 'twin' AS kind, row_number() OVER (ORDER BY r DESC, a, b) AS rank, * FROM pr WHERE r > 0.95) x WHERE rank <= 10"""
INERTIA = """
SELECT k, round(sum(ss - s * s / size), 6) AS inertia FROM (
  SELECT g.k, p.station_id % g.k AS cluster, p.hour, sum(p.occ) AS s, sum(p.occ * p.occ) AS ss FROM profile p CROSS JOIN (SELECT range AS k FROM range(2, 11)) g GROUP BY 1, 2, 3) a
JOIN (SELECT g.k, s.station_id % g.k AS cluster, count(*) AS size FROM (SELECT DISTINCT station_id FROM telemetry) s
  CROSS JOIN (SELECT range AS k FROM range(2, 11)) g GROUP BY 1, 2) b USING (k, cluster) GROUP BY k"""
SQL["elbow_pick"] = """
SELECT CAST(CASE WHEN d > 0 THEN k ELSE 3 END AS BIGINT) AS k, d AS distance FROM (
  SELECT k, round(abs((x2 - x1) * (y1 - inertia) - (x1 - k) * (y2 - y1)) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS d
  FROM curve CROSS JOIN (SELECT min(k) AS x1, min_by(inertia, k) AS y1, max(k) AS x2, max_by(inertia, k) AS y2 FROM curve) e) x
ORDER BY d DESC, k LIMIT 1"""
SQL["silhouette_pick"] = """
SELECT k, silhouette, CAST(k = (SELECT k FROM sil ORDER BY silhouette DESC, k LIMIT 1) AS INT) AS is_best FROM sil"""
SQL["cluster_archetypes"] = """
SELECT cluster, morning, midday, evening, CASE WHEN morning < evening AND morning < midday THEN 'RESIDENCIAL (Salen manana)'
  WHEN morning > evening THEN 'TRABAJO/OFICINAS (Llegan manana)' WHEN midday > morning AND midday > evening THEN 'OCIO/HOSTELERIA (Pico mediodia)'
  ELSE 'MIXTO/ROTACION CONSTANTE' END AS label, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct
FROM (SELECT cluster, round(avg(occ) FILTER (hour BETWEEN 7 AND 9), 6) AS morning, round(avg(occ) FILTER (hour BETWEEN 13 AND 15), 6) AS midday,
    round(avg(occ) FILTER (hour BETWEEN 17 AND 19), 6) AS evening, count(DISTINCT d.station_id) AS n
  FROM dense_profile d JOIN assignment a ON a.station_id = d.station_id GROUP BY cluster) x"""
SQL["cluster_profiles"] = """
SELECT cluster, hour, round(100 * avg(occ), 6) AS occupancy_pct FROM dense_profile d JOIN assignment a ON a.station_id = d.station_id GROUP BY cluster, hour"""
SQL["assign_nearest_centroid"] = """
SELECT station_id, cluster, d AS dist2 FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY d, cluster) AS rn FROM (
  SELECT p.station_id, c.cluster, round(sum((round(p.occ, 6) - c.c) * (round(p.occ, 6) - c.c)), 6) AS d FROM dense_profile p JOIN (
    SELECT cluster, hour, round(100 * avg(occ), 6) / 100 AS c FROM dense_profile d JOIN assignment a ON a.station_id = d.station_id GROUP BY 1, 2) c
  ON c.hour = p.hour GROUP BY 1, 2) x) y WHERE rn = 1"""

# --- prediction ------------------------------------------------------------------

METRICS = f"SELECT tp, fp, fn, tn, {quality_list(*ALL4)} FROM"
SQL["classification_metrics"] = f"{METRICS} (SELECT {confusion_sql('label = 1', 'score > 0.6')} FROM scored) x"
SWEPT = f"""
SELECT threshold, {quality_list(*ALL4)} FROM (SELECT t AS threshold, {confusion_sql('label = 1', 'score > t')}
  FROM scored CROSS JOIN (SELECT range * 5 / 100.0::DOUBLE AS t FROM range(2, 18)) g GROUP BY t) x"""
SQL["threshold_sweep"] = """
SELECT *, CAST(coalesce(threshold = (SELECT threshold FROM swept WHERE f1 > 0 ORDER BY f1 DESC, threshold LIMIT 1), FALSE) AS INT) AS is_best FROM swept"""
SQL["empty_definition_sweep"] = """
SELECT *, CAST(coalesce(empty_below = (SELECT empty_below FROM defs WHERE f1 > 0 ORDER BY f1 DESC, empty_below LIMIT 1), FALSE) AS INT) AS is_best FROM defs"""
DEFS = f"""
SELECT k AS empty_below, round(coalesce(100 * CAST(tp + fn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0), 6) AS pct_empty, {quality_list("precision", "recall", "f1")}
FROM (SELECT k, {confusion_sql('future_bikes < k', 'bikes < k')} FROM future CROSS JOIN (SELECT range AS k FROM range(2, 6)) g GROUP BY k) x"""
METHODS = f"""
SELECT method, round(coalesce(100 * CAST(tp + fn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0), 6) AS pct_empty, {quality_list("precision", "recall", "f1")}
FROM (SELECT 'fixed' AS method, {confusion_sql('future_bikes < 5', 'bikes < 5')} FROM future
  UNION ALL SELECT 'pct', {confusion_sql('future_bikes < 0.2::DOUBLE * capacity', 'bikes < 0.2::DOUBLE * capacity')} FROM future) x"""
SQL["fixed_vs_pct_threshold"] = """
SELECT *, CAST(method = (SELECT method FROM methods ORDER BY f1 DESC, method LIMIT 1) AS INT) AS is_winner FROM methods"""
SQL["persistence_baseline"] = f"""
SELECT {quality_list(*ALL4)}, tp + fp + fn + tn AS n FROM (SELECT {confusion_sql('future_bikes < 5', 'bikes < 5')} FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM future) a
  WHERE n >= 2 AND rn > greatest(1, least(floor(n * 0.8::DOUBLE), n - 1))) x"""
SQL["roc_auc"] = """
SELECT round(w / nullif(2.0::DOUBLE * p * q, 0), 6) AS roc_auc FROM (
  SELECT CAST(sum(pos * (2 * neg_to - neg)) AS DOUBLE) AS w, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS q FROM (
    SELECT *, sum(neg) OVER (ORDER BY score) AS neg_to FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score) x) y) z"""
SQL["average_precision"] = """
SELECT round(sum(pos * CAST(tp AS DOUBLE) / seen) / nullif(sum(pos), 0), 6) AS average_precision FROM (
  SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM (
    SELECT score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY score) x) y"""
FIT = """round(sqrt(avg((label - score) * (label - score))), 6) AS rmse, round(avg(abs(label - score)), 6) AS mae,
  round(1 - sum((label - score) * (label - score)) / nullif(sum(label * label) - CAST(sum(label) AS DOUBLE) * sum(label) / count(*), 0), 6) AS r2,
  round(100 * avg(abs(label - score) / abs(label)) FILTER (label <> 0), 6) AS mape, count(*) AS n"""
SQL["regression_metrics"] = f"""
SELECT 'all' AS "group", {FIT} FROM scored
UNION ALL SELECT concat('g', station_id % 4), {FIT} FROM scored GROUP BY 1 HAVING count(*) >= 100"""
SQL["model_comparison"] = f"""
SELECT a.metric, a.value AS model_a, b.value AS model_b, round(b.value - a.value, 6) AS diff,
  CASE WHEN b.value > a.value THEN 'score_rule' WHEN b.value < a.value THEN 'persistence' ELSE 'tie' END AS winner
FROM (UNPIVOT (SELECT {quality_list(*ALL4)} FROM (SELECT {confusion_sql('label = 1', 'bikes < 5')} FROM scored)) ON COLUMNS(*) INTO NAME metric VALUE value) a
JOIN (UNPIVOT (SELECT {quality_list(*ALL4)} FROM (SELECT {confusion_sql('label = 1', 'score > 0.6')} FROM scored)) ON COLUMNS(*) INTO NAME metric VALUE value) b ON a.metric = b.metric"""

# --- growth and siting -----------------------------------------------------------

SQL["growth_metrics"] = """
SELECT h.series, h.month, h.users, round(100 * (h.users - p) / CAST(p AS DOUBLE), 6) AS growth_pct, CAST(x AS BIGINT) AS months,
  round_even(uses / CAST(nullif(h.users, 0) AS DOUBLE), 1) AS uses_per_user
FROM (SELECT *, lag(users) OVER (PARTITION BY series ORDER BY month) AS p FROM history) h JOIN points_xy q ON q.series = h.series AND q.month = h.month"""
SQL["cagr"] = """
SELECT series, regime, "first", "last", round(y, 6) AS years, round(100 * (pow(CAST("last" AS DOUBLE) / nullif("first", 0), 1 / nullif(y, 0)) - 1), 6) AS cagr_pct FROM (
  SELECT series, CASE WHEN month < TIMESTAMP '1996-01-01' THEN 'pre' ELSE 'post' END AS regime, min_by(users, month) AS "first", max_by(users, month) AS "last",
    date_diff('day', CAST(min(month) AS DATE), CAST(max(month) AS DATE)) / CAST(365.25 AS DOUBLE) AS y FROM history GROUP BY 1, 2) x"""
SQL["fit_exponential"] = """
SELECT series, regime, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(r2, 6) AS r2, round(100 * mape, 6) AS mape FROM exponential"""
SQL["fit_logistic"] = """
SELECT series, regime, round(l, 6) AS l, round(k, 6) AS k, round(x0, 6) AS x0, round(r2, 6) AS r2, round(100 * mape, 6) AS mape FROM logistic"""
SQL["project_growth"] = """
SELECT series, regime, CAST(CAST(last_month AS DATE) + to_months(CAST(i AS INT)) AS TIMESTAMP) AS month,
  CAST(floor(round(l / (1 + exp(-k * (last_x + i - x0))), 6)) AS BIGINT) AS users,
  round(100 * floor(round(l / (1 + exp(-k * (last_x + i - x0))), 6)) / l, 6) AS saturation_pct
FROM (SELECT * FROM logistic QUALIFY row_number() OVER (PARTITION BY series ORDER BY last_month DESC) = 1) f
CROSS JOIN (SELECT range AS i FROM range(1, 25)) g"""
SQL["siting_score"] = """
SELECT district, round(0.3 * sp, 6) AS score_population, round(0.25 * sc, 6) AS score_coverage, round(0.2 * si, 6) AS score_income,
  round(0.15 * sd, 6) AS score_density, round(0.1 * sl, 6) AS score_connectivity, score_total, priority FROM ranked_districts"""
SQL["publish_results"] = "SELECT district, score_total, priority FROM ranked_districts"
SQL["siting_top_n"] = """
SELECT rank, district, score_total, priority, concat_ws(', ',
  CASE WHEN round(0.3 * sp, 6) > 20 THEN concat('Alta poblacion (', population, ' hab)') END,
  CASE WHEN n_stations = 0 THEN 'Sin cobertura actual (zona desatendida)' WHEN n_stations < 2 THEN 'Cobertura insuficiente' END,
  CASE WHEN income > 35000 AND income <= 70000 THEN 'Poder adquisitivo alto (sostenibilidad economica)' END,
  CASE WHEN density > 10000 THEN 'Alta densidad urbana' END) AS reasons
FROM (SELECT *, row_number() OVER (ORDER BY score_total DESC, district) AS rank FROM ranked_districts) x WHERE rank <= 5"""
SQL["priority_distribution"] = """
SELECT priority, CAST(sum(count(*)) OVER (PARTITION BY priority) AS BIGINT) AS n, bin, count(*) AS bin_n FROM (
  SELECT coalesce(priority, 'none') AS priority,
    CAST(coalesce(least(floor(round((income - min(income) OVER ()) * 5 / nullif(max(income) OVER () - min(income) OVER (), 0), 9)) + 1, 5), 1) AS BIGINT) AS bin
  FROM ranked_districts) x GROUP BY priority, bin"""
SQL["income_fields"] = """
SELECT district, round_even(round(income / 12, 9), 0) AS income_month,
  CASE WHEN income <= 0 OR income > 70000 THEN NULL WHEN income <= 28000 THEN 'Baja' WHEN income <= 35000 THEN 'Media' ELSE 'Alta' END AS income_band FROM districts"""
SQL["city_totals"] = """
SELECT CAST(sum(population) AS BIGINT) AS population, round(avg(income), 6) AS income_mean,
  (SELECT district FROM districts ORDER BY income DESC, district LIMIT 1) AS richest,
  (SELECT district FROM districts ORDER BY population DESC, district LIMIT 1) AS most_populated FROM districts"""

# --- streaming -------------------------------------------------------------------

WEATHER_TYPE = """CASE WHEN code = 0 THEN 'clear' WHEN code <= 3 THEN 'cloudy' WHEN code BETWEEN 51 AND 67 THEN 'rain'
  WHEN code BETWEEN 71 AND 77 THEN 'snow' WHEN code BETWEEN 80 AND 82 THEN 'showers' WHEN code >= 95 THEN 'storm' ELSE 'other' END"""
SQL["stream_enrich"] = f"""
SELECT t.station_id, s.station_name, s.capacity, round(s.lat, 6) AS lat, round(s.lon, 6) AS lon, t.bikes, t.docks,
  round(coalesce(CAST(t.bikes AS DOUBLE) / nullif(s.capacity, 0), 0), 6) AS occupancy, t.ts, CAST(hour(ts) AS INT) AS hour,
  CAST(CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-06') AS INT) AS is_holiday, CAST(month(ts) BETWEEN 6 AND 9 AS INT) AS is_tourist_season,
  {WEEKDAY} AS day_of_week, CAST(isodow(ts) >= 6 AS INT) AS is_weekend, {RUSH} AS is_rush_hour, CAST(bikes < 5 AS INT) AS is_empty, CAST(docks < 2 AS INT) AS is_full,
  t.temp, t.rain, t.wind, {WEATHER_TYPE} AS weather_type
FROM telemetry t JOIN stations s ON s.station_id = t.station_id"""
SQL["stream_delta"] = SQL["bike_delta"]
SQL["stream_system_health"] = f"""
SELECT *, {SCORE} FROM (SELECT {FRAME} AS ts, {SNAPSHOT} FROM telemetry GROUP BY 1) x"""
SQL["stream_corrected_health"] = SQL["stream_system_health"]
SQL["stream_hourly_activity"] = "SELECT hour_ts, activity FROM hourly"
SQL["stream_dedup"] = "SELECT event_id, station_id, ts, bikes FROM telemetry"

# Helpers of single queries.
BINDINGS |= {
    "h": "SELECT hour, round(avg(occupancy), 6) AS occ FROM occ GROUP BY hour",
    "g": """SELECT ts, CAST(short + 2 * ((SELECT count(DISTINCT station_id) FROM spans) - present) AS BIGINT) AS d FROM states""",
    "swept": SWEPT,
    "defs": DEFS,
    "methods": METHODS,
    "curve": INERTIA,
    "hv": """SELECT station_id AS s, date_trunc('hour', ts) AS t, CAST(round(avg(occupancy) * 1000000) AS HUGEINT) AS v FROM occ GROUP BY 1, 2""",
    "pr": """SELECT a, b, n AS n_hours, round(CAST(n * sxy - sx * sy AS DOUBLE) / (sqrt(nullif(CAST(n * sxx - sx * sx AS DOUBLE), 0)) * sqrt(nullif(CAST(n * syy - sy * sy AS DOUBLE), 0))), 6) AS r
FROM (SELECT x.s AS a, y.s AS b, count(*) AS n, sum(x.v) AS sx, sum(y.v) AS sy, sum(x.v * x.v) AS sxx, sum(y.v * y.v) AS syy, sum(x.v * y.v) AS sxy
  FROM hv x JOIN hv y ON x.t = y.t AND x.s < y.s GROUP BY 1, 2 HAVING count(*) >= 4) m""",
    "dist": """SELECT p.station_id AS a, q.station_id AS b, sqrt(sum((round(p.occ, 6) - round(q.occ, 6)) * (round(p.occ, 6) - round(q.occ, 6)))) AS d
FROM dense_profile p JOIN dense_profile q ON p.hour = q.hour AND p.station_id <> q.station_id GROUP BY 1, 2""",
    "sil": """SELECT k, round(avg(coalesce((bb - aa) / nullif(greatest(aa, bb), 0), 0)), 6) AS silhouette FROM (
  SELECT st.k, st.station_id, max(m) FILTER (c = st.station_id % st.k) AS aa, min(m) FILTER (c <> st.station_id % st.k) AS bb
  FROM (SELECT station_id, CAST(range AS INT) AS k FROM (SELECT DISTINCT station_id FROM telemetry) z CROSS JOIN range(2, 7)) st
  LEFT JOIN (SELECT a, g.range AS k, b % g.range AS c, avg(d) AS m FROM dist CROSS JOIN range(2, 7) g GROUP BY 1, 2, 3) w
    ON w.a = st.station_id AND w.k = st.k GROUP BY 1, 2) x GROUP BY k""",
}


def oracle_sql() -> dict[str, str]:
    return {slug: with_bindings(sql) for slug, sql in SQL.items()}
