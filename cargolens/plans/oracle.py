"""SQL that gives the same rows on the same tables; written for another engine, apart from the DataFrame code."""

from __future__ import annotations

from cargolens.schemas import CITIES, FLOW_MODES, ON_TIME, RATES, STATE_CODES

SHIPS = """ships AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_shipdate AS DATE)) AS shipment_id, CAST(l_shipdate AS DATE) AS ship_date,
         sn.n_name || ',' || sr.r_name AS origin_city, cn.n_name || ',' || cr.r_name AS dest_city,
         CASE l_returnflag WHEN 'A' THEN 'PARCEL' WHEN 'N' THEN 'LTL' ELSE 'FTL' END AS mode, s_name AS carrier_id, l_quantity AS weight_lbs,
         l_extendedprice / (l_quantity / 100) AS base_rate_per_cwt, l_extendedprice AS base_cost,
         l_extendedprice * (1 + l_tax) * CASE WHEN (l_orderkey + l_partkey) % 14 = 0 THEN 2.5e0 + 2.5e0 * (l_partkey % 100) / 100 ELSE 1e0 END AS total_cost,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS on_time_flag, {lane} AS lane_id, 'run-1' AS run_id, CASE WHEN (l_orderkey + l_partkey) % 14 = 0 THEN 1 ELSE 0 END AS is_anomaly
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
),
costed AS (SELECT *, total_cost / NULLIF(weight_lbs, 0) AS cpl FROM ships)"""
REGION, NATION = "sr.r_name || '-' || cr.r_name", "sn.n_name || '-' || cn.n_name"
Z = """z AS (
  SELECT 'ZSCORE_' || shipment_id AS flag_id, shipment_id, 'ZSCORE' AS flag_type, lane_id, mode, origin_city AS region, total_cost AS cost_value, (cpl - m) / NULLIF(d, 0) AS z_score, ship_date AS flag_date
  FROM costed JOIN (SELECT lane_id, mode, AVG(cpl) AS m, STDDEV_SAMP(cpl) AS d FROM costed GROUP BY lane_id, mode HAVING COUNT(*) >= 10) USING (lane_id, mode)
  WHERE ABS((cpl - m) / NULLIF(d, 0)) > 2.5
)"""
IQR = """iqr AS (
  SELECT 'IQR_' || shipment_id AS flag_id, shipment_id, 'IQR' AS flag_type, lane_id, mode, origin_city AS region, total_cost AS cost_value, CAST(NULL AS DOUBLE) AS z_score, ship_date AS flag_date
  FROM costed JOIN (SELECT lane_id, mode, PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY cpl) AS q1, PERCENTILE_CONT(0.75) WITHIN GROUP (ORDER BY cpl) AS q3
                    FROM costed GROUP BY lane_id, mode HAVING COUNT(*) >= 10) USING (lane_id, mode)
  WHERE cpl > q3 + 1.5e0 * (q3 - q1) OR cpl < q1 - 1.5e0 * (q3 - q1)
)"""
FLAGS = f"{Z},\n{IQR},\nflags AS (SELECT * FROM z UNION ALL SELECT * FROM iqr)"
FLAG_COLUMNS = "flag_id, shipment_id, flag_type, lane_id, mode, region, ROUND(cost_value, 6) AS cost_value, ROUND(z_score, 6) AS z_score, flag_date"
TRENDS = """weekly AS (
  SELECT CAST(date_trunc('week', ship_date) AS DATE) AS week_start, lane_id, mode, COUNT(*) AS n, AVG(cpl) AS c FROM costed GROUP BY 1, 2, 3 HAVING COUNT(*) >= 5
),
trends AS (
  SELECT *, COUNT(*) OVER (PARTITION BY lane_id, mode ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
         AVG(c) OVER (PARTITION BY lane_id, mode ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS r FROM weekly
),
judged AS (
  SELECT week_start, lane_id, mode, n AS shipment_count, ROUND(c, 6) AS avg_cost_per_lb, ROUND(r, 6) AS rolling_4wk_avg, ROUND((c - r) / NULLIF(r, 0), 6) AS pct_deviation,
         CAST(CASE WHEN p >= 4 AND ABS((c - r) / NULLIF(r, 0)) > 0.2e0 THEN 1 ELSE 0 END AS BIGINT) AS is_anomalous FROM trends
)"""
MONTH = "CAST(date_trunc('month', ship_date) AS DATE)"
STATE = "split_part(origin_city, ',', 2)"
RISK = """lanes AS (
  SELECT lane_id, COUNT(*) AS n, CAST(SUM(f) AS BIGINT) AS a, SUM(f) / CAST(COUNT(*) AS DOUBLE) AS ar, CAST(SUM(CASE WHEN on_time_flag = 0 THEN 1 ELSE 0 END) AS BIGINT) AS l,
         SUM(CASE WHEN on_time_flag = 0 THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) AS lr, AVG(CASE WHEN f = 0 THEN total_cost END) AS ok, AVG(CASE WHEN f = 1 THEN total_cost END) AS bad
  FROM marked GROUP BY lane_id HAVING COUNT(*) >= 50
),
scored AS (SELECT *, (bad - ok) / NULLIF(ok, 0) AS o FROM lanes)
SELECT lane_id, n AS total_shipments, a AS anomaly_count, ROUND(ar * 100, 2) AS anomaly_rate_pct, l AS late_count, ROUND(lr * 100, 2) AS late_rate_pct, ROUND(ok, 2) AS avg_normal_cost,
       ROUND(bad, 2) AS avg_anomalous_cost, ROUND(o * 100, 1) AS cost_overrun_pct,
       ROUND(0.4e0 * ar + 0.3e0 * lr + 0.3e0 * CASE WHEN o IS NOT NULL THEN LEAST(o, 10) END / 10, 4) AS risk_score FROM scored"""
RISKS = "risks AS (WITH " + RISK + ")"
MARKED = "marked AS (SELECT s.*, CASE WHEN f.shipment_id IS NULL THEN 0 ELSE 1 END AS f FROM ships s LEFT JOIN (SELECT DISTINCT shipment_id FROM flags) f USING (shipment_id))"
TRUE = "marked AS (SELECT *, is_anomaly AS f FROM ships)"
FLOOR = "floored AS (SELECT *, total_cost / greatest(weight_lbs, 1e-6) AS fc FROM ships)"
LZ = """lz AS (SELECT DISTINCT shipment_id FROM floored JOIN (SELECT lane_id, mode, AVG(fc) AS m, STDDEV_SAMP(fc) AS d FROM floored GROUP BY lane_id, mode HAVING COUNT(fc) >= 5) USING (lane_id, mode)
  WHERE ABS((fc - m) / greatest(d, 1e-6)) > 2.5)"""
LQ = """lq AS (SELECT DISTINCT shipment_id FROM floored JOIN (SELECT lane_id, mode, PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY fc) AS q1, PERCENTILE_CONT(0.75) WITHIN GROUP (ORDER BY fc) AS q3
  FROM floored GROUP BY lane_id, mode HAVING COUNT(fc) >= 5) USING (lane_id, mode) WHERE fc > q3 + 1.5e0 * (q3 - q1) OR fc < q1 - 1.5e0 * (q3 - q1))"""
LOCAL = f"{FLOOR},\n{LZ},\n{LQ},\nla AS (SELECT shipment_id FROM lz UNION SELECT shipment_id FROM lq),\nseen AS (SELECT f.*, CASE WHEN la.shipment_id IS NULL THEN 0 ELSE 1 END AS flagged FROM floored f LEFT JOIN la USING (shipment_id))"
FUEL_ROWS = """(SELECT i, CASE CAST(floor(i / 26e0) AS INT) WHEN 0 THEN 3.5e0 + (5.8e0 - 3.5e0) * (i % 26) / 25 WHEN 1 THEN 5.8e0 + (4.2e0 - 5.8e0) * (i % 26) / 25
  WHEN 2 THEN 4.2e0 + (4e0 - 4.2e0) * (i % 26) / 25 WHEN 3 THEN 4e0 + (3.8e0 - 4e0) * (i % 26) / 25 ELSE 3.8e0 + (3.9e0 - 3.8e0) * (i % 26) / 25 END AS p FROM (SELECT range AS i FROM range(130)))"""


def _metrics(method: str, ids: str, truth: str = "ships") -> str:
    return f"""SELECT '{method}' AS method, tp, n - tp AS fp, pos - tp AS fn, total - pos - n + tp AS tn, ROUND(p, 4) AS precision, ROUND(r, 4) AS recall,
  ROUND(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END, 4) AS f1, ROUND(CASE WHEN total - pos > 0 THEN (n - tp) / CAST(total - pos AS DOUBLE) ELSE 0e0 END, 4) AS fpr, n AS n_flagged
  FROM (SELECT *, CASE WHEN n > 0 THEN tp / CAST(n AS DOUBLE) ELSE 0e0 END AS p, CASE WHEN pos > 0 THEN tp / CAST(pos AS DOUBLE) ELSE 0e0 END AS r
        FROM (SELECT (SELECT COUNT(*) FROM {truth}) AS total, (SELECT CAST(SUM(is_anomaly) AS BIGINT) FROM {truth}) AS pos, (SELECT COUNT(DISTINCT shipment_id) FROM {ids}) AS n,
              (SELECT CAST(coalesce(SUM(is_anomaly), 0) AS BIGINT) FROM {truth} WHERE shipment_id IN (SELECT shipment_id FROM {ids})) AS tp))"""


def _case(key: str, values: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + " END"


def _draw(name: str, *keys: str) -> str:
    """In (0, 1), by a hash of name, seed and keys."""
    text = " || ':' || ".join([f"'{name}:42'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"((CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) + 0.5e0) / 4503599627370496e0)"


def _normal(name: str, *keys: str) -> str:
    return f"sqrt(-2 * ln({_draw(name + 'a', *keys)})) * cos(2 * pi() * {_draw(name + 'b', *keys)})"


def _generated_rates() -> str:
    states = ", ".join(f"('{s}')" for s in sorted({c.split(",")[1] for c in CITIES}))
    modes = ", ".join(f"('{m}', {a}e0, {b}e0)" for m, (a, b) in RATES.items())
    key = ("carrier_id", "mode", "lane_id")
    return f"""states(s) AS (VALUES {states}), modes(mode, mean, std) AS (VALUES {modes}),
drawn AS (
  SELECT c.carrier_id, m.mode, m.mean, m.std, a.s || '-' || b.s AS lane_id
  FROM (SELECT 'CARRIER_' || lpad(CAST(range AS VARCHAR), 3, '0') AS carrier_id FROM range(1, 26)) c, modes m, states a, states b WHERE a.s <> b.s
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY carrier_id, mode ORDER BY -ln({_draw('lane', *key)}), lane_id) AS n FROM drawn),
gen_rates AS (
  SELECT carrier_id, mode, lane_id,
         ROUND(greatest(2e0, mean * (0.85e0 + 0.3e0 * {_draw('carrier', 'carrier_id', 'mode')}) * (0.9e0 + 0.2e0 * {_draw('factor', *key)}) + std * 0.3e0 * {_normal('rate', *key)}), 4) AS base_rate_per_cwt,
         DATE '2023-01-01' AS effective_date
  FROM ranked WHERE n <= 30
)"""


def _generated_ships() -> str:
    cities = {}
    for c in CITIES:
        cities.setdefault(c.split(",")[1], []).append(c)
    city = lambda place, name: "CASE split_part(lane_id, '-', " + place + ") " + " ".join(f"WHEN '{s}' THEN list_value({', '.join(repr(c) for c in cs)})[1 + CAST(floor({_draw(name, 'id')} * {len(cs)}) AS INT)]" for s, cs in cities.items()) + " END"
    prompt = " ".join(f"WHEN '{m}' THEN {p}e0" for m, p in ON_TIME.items())
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY carrier_id, lane_id) - 1 AS k FROM gen_rates),
gen_base AS (
  SELECT id, CASE WHEN u < 0.4e0 THEN 'PARCEL' WHEN u < 0.75e0 THEN 'LTL' ELSE 'FTL' END AS mode, CAST(floor({_draw('row', 'id')} * 750) AS INT) AS k,
         CASE WHEN {_draw('anomaly', 'id')} < 0.07e0 THEN 1 ELSE 0 END AS bad, CAST(DATE '2023-01-01' + CAST(floor({_draw('day', 'id')} * 546) AS INT) AS DATE) AS ship_date,
         least(greatest(exp(6.5e0 + 1.2e0 * {_normal('weight', 'id')}), 1e0), 40000e0) AS weight
  FROM (SELECT range AS id, {_draw('mode', 'range')} AS u FROM range(75000))
),
gen_fuel AS (SELECT CAST(DATE '2022-01-03' + CAST(7 * i AS INT) AS DATE) AS week, ROUND((p - 2.5e0) / 2.5e0 * 0.3e0, 4) AS pct FROM {FUEL_ROWS}),
gen_costed AS (
  SELECT g.*, n.carrier_id, n.lane_id, n.base_rate_per_cwt, greatest(1e0, n.base_rate_per_cwt * weight / 100) AS base, coalesce(pct, 0.15e0) AS fuel
  FROM gen_base g JOIN numbered n USING (mode, k) LEFT JOIN gen_fuel ON week = CAST(date_trunc('week', ship_date) AS DATE)
),
gen_ships AS (
  SELECT 'SHP' || lpad(CAST(id AS VARCHAR), 7, '0') AS shipment_id, ship_date, {city('1', 'origin')} AS origin_city, {city('2', 'dest')} AS dest_city, mode, carrier_id,
         ROUND(weight, 1) AS weight_lbs, base_rate_per_cwt, ROUND(base, 2) AS base_cost, ROUND(fuel, 4) AS fuel_surcharge_pct,
         ROUND(base * (1 + fuel) * CASE WHEN bad = 1 THEN 2.5e0 + 2.5e0 * {_draw('times', 'id')} ELSE 1e0 END, 2) AS total_cost,
         CAST(CASE WHEN {_draw('prompt', 'id')} < CASE mode {prompt} END * CASE WHEN bad = 1 THEN 0.6e0 ELSE 1e0 END THEN 1 ELSE 0 END AS BIGINT) AS on_time_flag,
         lane_id, 'run' AS run_id, CAST(bad AS BIGINT) AS is_anomaly
  FROM gen_costed
)"""


def _six_places(sql: str) -> str:
    """ROUND(x, 6) at nine places first, in decimals: values half way between two of six places go up in any order of summation."""
    parts = sql.split("ROUND(")
    out = parts.pop()
    for before in reversed(parts):
        depth = 1
        for end, c in enumerate(out):
            depth += (c == "(") - (c == ")")
            if not depth:
                break
        inside, after = out[:end], out[end + 1 :]
        out = before + (f"CAST(ROUND(CAST({inside[:-3]} AS DECIMAL(28, 9)), 6) AS DOUBLE)" if inside.endswith(", 6") else f"round({inside})") + after
    return out


def statements() -> dict[str, str]:
    return {name: _six_places(sql) for name, sql in _statements().items()}


def _statements() -> dict[str, str]:
    def q(body: str, *parts: str, lane: str = REGION) -> str:
        return "WITH " + ",\n".join([SHIPS.format(lane=lane), *parts]) + ("\n" if not body.lstrip().startswith(("lanes AS",)) else ",\n") + body

    scorecard = """SELECT carrier_id, mode, COUNT(*) AS total_shipments, ROUND(SUM(on_time_flag) / CAST(COUNT(*) AS DOUBLE), 6) AS on_time_rate, ROUND(AVG(total_cost), 6) AS avg_cost,
        ROUND(AVG(total_cost / NULLIF(weight_lbs, 0)), 6) AS avg_cost_per_lb, {rate} AS anomaly_rate, ROUND(SUM(total_cost), 2) AS total_spend FROM {rows} GROUP BY 1, 2"""
    summary = """SELECT COUNT(*) AS total_shipments, ROUND(SUM(total_cost), 2) AS total_freight_spend, ROUND(AVG(total_cost), 6) AS avg_cost_per_shipment, ROUND(SUM(on_time_flag) / CAST(COUNT(*) AS DOUBLE), 6) AS overall_on_time_rate,
        (SELECT COUNT(DISTINCT shipment_id) FROM {ids}) AS total_anomalies_flagged, ROUND((SELECT COUNT(DISTINCT shipment_id) FROM {ids}) / CAST(COUNT(*) AS DOUBLE), 6) AS overall_anomaly_rate,
        MIN(ship_date) AS data_start_date, MAX(ship_date) AS data_end_date FROM ships"""
    by_region = f"""SELECT {STATE} AS origin_state, mode, {MONTH} AS month, COUNT(DISTINCT shipment_id) AS total_shipments, COUNT(DISTINCT CASE WHEN f = 1 THEN shipment_id END) AS flagged_shipments,
        ROUND(COUNT(DISTINCT CASE WHEN f = 1 THEN shipment_id END) / CAST(COUNT(DISTINCT shipment_id) AS DOUBLE), 6) AS anomaly_rate FROM marked GROUP BY 1, 2, 3"""
    expensive = "SELECT lane_id, mode, COUNT(*) AS shipments, ROUND(AVG(total_cost / weight_lbs), 4) AS avg_cost_per_lb, ROUND(AVG(total_cost), 2) AS avg_total_cost FROM ships GROUP BY 1, 2 HAVING COUNT(*) >= 20 ORDER BY 4 DESC, 1, 2 LIMIT 10"
    joined = "joined AS (SELECT s.*, f.shipment_id AS fid FROM ships s LEFT JOIN flags f USING (shipment_id))"
    coverage = "\nUNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS place, '{name}' AS grouping, CAST(coalesce(SUM(n), 0) AS BIGINT) AS covered_rows, ROUND(coalesce(SUM(n), 0) / CAST((SELECT COUNT(*) FROM ships) AS DOUBLE), 6) AS coverage FROM (SELECT COUNT(fc) AS n FROM floored GROUP BY {keys} HAVING COUNT(fc) >= 5)"
        for i, (name, keys) in enumerate([("lane_id+mode", "lane_id, mode"), ("carrier_id", "carrier_id"), ("mode", "mode")])
    )
    dash = """dw AS (SELECT CAST(date_trunc('week', ship_date) AS DATE) AS week_start, lane_id, mode, COUNT(shipment_id) AS n, AVG(fc) AS c FROM floored GROUP BY 1, 2, 3),
dr AS (SELECT *, AVG(c) OVER w AS r4, COUNT(c) OVER w AS k, row_number() OVER (PARTITION BY lane_id, mode ORDER BY week_start) - 1 AS p FROM dw
  WINDOW w AS (PARTITION BY lane_id, mode ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
dt AS (SELECT *, CASE WHEN k = 4 THEN r4 END AS r FROM dr),
dd AS (SELECT *, (c - r) / greatest(r, 1e-6) AS d FROM dt WHERE r IS NOT NULL UNION ALL SELECT *, CAST(NULL AS DOUBLE) AS d FROM dt WHERE r IS NULL)"""
    one = lambda name, rows, least: f"SELECT '{name}' AS table_name, COUNT(*) AS n_rows, CAST({least} AS BIGINT) AS expected, CASE WHEN COUNT(*) >= {least} THEN 'OK' ELSE 'WARN' END AS status FROM {rows}"
    rate_rows = "rates AS (SELECT carrier_id, mode, lane_id, AVG(base_rate_per_cwt) AS base_rate_per_cwt, MIN(ship_date) AS effective_date FROM ships GROUP BY 1, 2, 3)"
    zone = lambda c: _case(f"CAST(substr(lpad(CAST({c} % 560 AS VARCHAR), 3, '0'), 1, 2) AS INT)", STATE_CODES)
    flows = f"flows AS (SELECT {zone('o_orderkey')} AS o, {zone('o_custkey')} AS d, o_orderkey % 8 AS m FROM orders)"
    named = _case("m", FLOW_MODES)
    return {
        "flag_zscore": q(f"SELECT {FLAG_COLUMNS} FROM z", Z),
        "flag_iqr": q(f"SELECT {FLAG_COLUMNS} FROM iqr", IQR),
        "anomaly_flags": q(f"SELECT {FLAG_COLUMNS} FROM flags", FLAGS),
        "flag_counts": q("SELECT flag_type, COUNT(*) AS flags FROM flags GROUP BY 1", FLAGS),
        "flagged_distinct": q("SELECT COUNT(DISTINCT shipment_id) AS unique_flagged_shipments FROM flags", FLAGS),
        "lane_week_trends": q("SELECT * FROM judged", TRENDS),
        "trend_summary": q("SELECT COUNT(*) AS trend_rows, CAST(SUM(is_anomalous) AS BIGINT) AS anomalous_weeks FROM judged", TRENDS),
        "vw_carrier_ontime": q(f"SELECT carrier_id, mode, {MONTH} AS month, COUNT(*) AS total_shipments, CAST(SUM(on_time_flag) AS BIGINT) AS on_time_shipments, ROUND(SUM(on_time_flag) / CAST(COUNT(*) AS DOUBLE), 6) AS on_time_rate FROM ships GROUP BY 1, 2, 3"),
        "vw_cost_by_mode_region": q(f"SELECT mode, {STATE} AS origin_state, {MONTH} AS month, COUNT(*) AS shipment_count, ROUND(AVG(total_cost), 6) AS avg_total_cost, ROUND(AVG(cpl), 6) AS avg_cost_per_lb, ROUND(MEDIAN(total_cost), 6) AS median_total_cost, ROUND(SUM(total_cost), 2) AS total_spend FROM costed GROUP BY 1, 2, 3"),
        "vw_anomaly_rate_by_region": q(by_region, FLAGS, MARKED),
        "vw_carrier_scorecard": q(scorecard.format(rows="joined", rate="ROUND(COUNT(DISTINCT fid) / CAST(COUNT(*) AS DOUBLE), 6)"), FLAGS, joined),
        "vw_executive_summary": q(summary.format(ids="flags"), FLAGS),
        "vw_lane_risk": q(RISK, FLAGS, MARKED),
        "vw_anomaly_rate_by_region_export": q(by_region, TRUE),
        "vw_carrier_scorecard_export": q(scorecard.format(rows="ships", rate="ROUND(AVG(is_anomaly), 6)")),
        "vw_executive_summary_export": q(summary.format(ids="(SELECT shipment_id FROM ships WHERE is_anomaly = 1)")),
        "vw_lane_risk_export": q(RISK, TRUE),
        "top_expensive_lanes": q(expensive),
        "top_carrier_anomaly": q("SELECT carrier_id, mode, COUNT(*) AS total_shipments, COUNT(DISTINCT fid) AS flagged, ROUND(COUNT(DISTINCT fid) / CAST(COUNT(*) AS DOUBLE), 4) AS anomaly_rate, ROUND(AVG(total_cost), 2) AS avg_cost FROM joined GROUP BY 1, 2 HAVING COUNT(*) >= 100 ORDER BY 5 DESC, 1, 2 LIMIT 10", FLAGS, joined),
        "monthly_cost_trend": q(f"SELECT {MONTH} AS month, mode, COUNT(*) AS shipments, ROUND(AVG(total_cost), 2) AS avg_cost, ROUND(AVG(total_cost / weight_lbs), 4) AS avg_cpl FROM ships GROUP BY 1, 2"),
        "fuel_vs_cost": q(f"SELECT f.week_start, fuel_price_per_gallon, surcharge_pct, COUNT(s.shipment_id) AS shipments, ROUND(AVG(s.total_cost), 2) AS avg_cost FROM fuel f LEFT JOIN ships s ON CAST(date_trunc('week', s.ship_date) AS DATE) = f.week_start GROUP BY 1, 2, 3", f"fuel AS (SELECT CAST(DATE '1995-01-02' + CAST(7 * w.range AS INT) AS DATE) AS week_start, ROUND(p, 4) AS fuel_price_per_gallon, ROUND((p - 2.5e0) / 2.5e0 * 0.3e0, 4) AS surcharge_pct FROM range(357) w JOIN {FUEL_ROWS} r ON w.range % 130 = r.i)"),
        "flag_detail": q("SELECT flag_type, f.lane_id, f.mode, ROUND(z_score, 6) AS z_score, ship_date, carrier_id, ROUND(total_cost, 6) AS total_cost, weight_lbs, ROUND(total_cost / weight_lbs, 4) AS cost_per_lb, f.shipment_id FROM flags f JOIN ships s USING (shipment_id) ORDER BY flag_type, f.z_score DESC NULLS LAST, f.shipment_id LIMIT 50", FLAGS),
        "eval_zscore_flags": q("SELECT shipment_id FROM lz", FLOOR, LZ),
        "eval_iqr_flags": q("SELECT shipment_id FROM lq", FLOOR, LQ),
        "group_coverage": q(coverage, FLOOR),
        "eval_metrics": q("\nUNION ALL ".join(_metrics(m, t) for m, t in (("ZSCORE", "lz"), ("IQR", "lq"), ("ALL", "la"))), LOCAL),
        "eval_metrics_text": q("SELECT CASE method WHEN 'ALL' THEN 'ALL (distinct)' ELSE method END AS \"Method\", printf('%.3f', precision) AS \"Precision\", printf('%.3f', recall) AS \"Recall\", printf('%.3f', f1) AS \"F1\", printf('%.3f', fpr) AS \"FPR\", format('{:,}', n_flagged) AS \"Flagged\" FROM ("
            + "\nUNION ALL ".join(_metrics(m, t) for m, t in (("ZSCORE", "lz"), ("IQR", "lq"), ("ALL", "la"))) + ")", LOCAL),
        "eval_from_export": q("\nUNION ALL ".join(_metrics(m, t) for m, t in (("ZSCORE", "z"), ("IQR", "iqr"), ("ALL", "flags"))), FLAGS),
        "validate_counts": q("\nUNION ALL ".join([one("SHIPMENTS", "ships", 75000), one("FUEL_SURCHARGES", "range(357)", 100), one("CARRIER_RATES", "rates", 1000), one("LANE_WEEK_TRENDS", "judged", 1), one("ANOMALY_FLAGS", "flags", 1)]), FLAGS, TRENDS, rate_rows),
        "validate_nulls": q("\nUNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls, CASE WHEN COUNT(*) FILTER (WHERE {c} IS NULL) = 0 THEN 'OK' ELSE 'WARN' END AS status FROM ships" for c in ("shipment_id", "ship_date", "mode", "carrier_id", "total_cost", "run_id"))),
        "validate_flag_rate": q("SELECT ROUND(x, 6) AS flag_rate, CASE WHEN x BETWEEN 0.05e0 AND 0.2e0 THEN 'OK' ELSE 'WARN' END AS status FROM (SELECT (SELECT COUNT(DISTINCT shipment_id) FROM flags) / CAST((SELECT COUNT(DISTINCT shipment_id) FROM ships) AS DOUBLE) AS x)", FLAGS),
        "validate_ontime": q("SELECT mode, ROUND(SUM(on_time_flag) / CAST(COUNT(*) AS DOUBLE), 6) AS on_time_rate FROM ships GROUP BY 1"),
        "rates_duplicate_keys": q("SELECT CAST(coalesce(SUM(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT COUNT(*) AS n FROM rates GROUP BY carrier_id, mode, lane_id)", rate_rows),
        "join_coverage": q("SELECT COUNT(*) AS missing_keys FROM (SELECT carrier_id, mode, lane_id FROM ships EXCEPT SELECT carrier_id, mode, lane_id FROM rates)", rate_rows),
        "base_cost_check": q("SELECT ROUND(MAX(ABS(base_cost - ROUND(greatest(1e0, base_rate_per_cwt * weight_lbs / 100), 2))), 6) AS max_error, COUNT(*) AS n_rows FROM ships"),
        "dash_kpis": q("SELECT COUNT(*) AS total_shipments, ROUND(AVG(flagged), 6) AS anomaly_rate, ROUND(AVG(fc), 6) AS avg_cpl, ROUND(AVG(on_time_flag), 6) AS on_time_rate FROM seen", LOCAL),
        "dash_flagged": q("SELECT shipment_id, ROUND(fc, 6) AS cpl, CAST(flagged AS BIGINT) AS flagged FROM seen", LOCAL),
        "dash_lane_week_trends": q("SELECT week_start, lane_id, mode, n AS shipment_count, ROUND(c, 6) AS avg_cpl, ROUND(r, 6) AS rolling_4wk, ROUND(d, 6) AS pct_dev, p AS prior_weeks, CAST(CASE WHEN ABS(d) > 0.2e0 AND p >= 4 THEN 1 ELSE 0 END AS BIGINT) AS is_anomalous FROM dd", FLOOR, dash),
        "dash_anomalous_weeks": q("SELECT DISTINCT week_start FROM dd WHERE ABS(d) > 0.2e0 AND p >= 4", FLOOR, dash),
        "dash_cpl_distribution": q("SELECT mode, CASE flagged WHEN 1 THEN 'Flagged' ELSE 'Normal' END AS anomaly_label, COUNT(fc) AS n, ROUND(MIN(fc), 6) AS low, ROUND(PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY fc), 6) AS q1, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY fc), 6) AS median, ROUND(PERCENTILE_CONT(0.75) WITHIN GROUP (ORDER BY fc), 6) AS q3, ROUND(MAX(fc), 6) AS high FROM seen GROUP BY 1, 2", LOCAL),
        "dash_weekly_cpl": q("SELECT w.week, ROUND(x.avg_cpl, 6) AS avg_cpl FROM (SELECT CAST(a + CAST(7 * range AS INT) AS DATE) AS week FROM (SELECT MIN(week) AS a, MAX(week) AS b FROM wk), range(2000) WHERE a + CAST(7 * range AS INT) <= b) w LEFT JOIN (SELECT week, AVG(c) AS avg_cpl FROM wk GROUP BY 1) x USING (week)", FLOOR, "wk AS (SELECT CAST(date_trunc('week', ship_date) AS DATE) + 6 AS week, c FROM (SELECT ship_date, mode, AVG(fc) AS c FROM floored GROUP BY 1, 2))"),
        "dash_top_lanes": q("SELECT lane_id, ROUND(SUM(total_cost), 2) AS total_cost, CAST(SUM(flagged) AS BIGINT) AS anomaly_count, COUNT(shipment_id) AS total_count, ROUND(SUM(flagged) / CAST(COUNT(shipment_id) AS DOUBLE), 6) AS anomaly_density FROM seen GROUP BY 1 ORDER BY SUM(total_cost) DESC, 1 LIMIT 20", LOCAL),
        "dash_carrier_scorecard": q("SELECT carrier_id, ROUND(AVG(on_time_flag), 6) AS on_time_rate, ROUND(AVG(total_cost), 6) AS avg_cost, COUNT(shipment_id) AS volume FROM ships GROUP BY 1"),
        "chart_lane_risk": q("SELECT lane_id, anomaly_rate_pct, late_rate_pct, cost_overrun_pct, ROUND(cost_overrun_pct / NULLIF(MAX(cost_overrun_pct) OVER (), 0), 6) AS overrun_share FROM (SELECT * FROM risks ORDER BY risk_score DESC NULLS LAST, lane_id LIMIT 3)", TRUE, RISKS),
        "flag_breakdown": q("SELECT lane_id, CAST(SUM(CASE WHEN z = 1 AND q = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zscore_only, CAST(SUM(CASE WHEN z = 1 AND q = 1 THEN 1 ELSE 0 END) AS BIGINT) AS both, CAST(SUM(CASE WHEN z = 0 AND q = 1 THEN 1 ELSE 0 END) AS BIGINT) AS iqr_only, CAST(SUM(CASE WHEN z = 1 OR q = 1 THEN 1 ELSE 0 END) AS BIGINT) AS total_flags FROM fb GROUP BY 1 ORDER BY 5 DESC, 1 LIMIT 10", LOCAL, "fb AS (SELECT s.lane_id, CASE WHEN lz.shipment_id IS NULL THEN 0 ELSE 1 END AS z, CASE WHEN lq.shipment_id IS NULL THEN 0 ELSE 1 END AS q FROM ships s LEFT JOIN lz USING (shipment_id) LEFT JOIN lq ON s.shipment_id = lq.shipment_id)"),
        "run_provenance": q("SELECT 'run-1' AS run_id, 'TEST' AS seed_source, CAST(NULL AS VARCHAR) AS faf5_file, COUNT(*) AS n_shipments, CAST(SUM(is_anomaly) AS BIGINT) AS n_anomalies, ROUND(SUM(is_anomaly) / CAST(COUNT(*) AS DOUBLE), 4) AS anomaly_rate FROM ships"),
        "carrier_rates": q("SELECT carrier_id, mode, lane_id, ROUND(base_rate_per_cwt, 6) AS base_rate_per_cwt, effective_date FROM rates", rate_rows),
        "fuel_surcharges": f"SELECT CAST(DATE '2022-01-03' + CAST(7 * i AS INT) AS DATE) AS week_start, ROUND(p, 4) AS fuel_price_per_gallon, ROUND((p - 2.5e0) / 2.5e0 * 0.3e0, 4) AS surcharge_pct FROM {FUEL_ROWS}",
        "faf_lane_weights": f"WITH {flows} SELECT o || '-' || d AS lane_id, COUNT(*) AS weight FROM flows WHERE o IS NOT NULL AND d IS NOT NULL GROUP BY 1",
        "faf_mode_share": f"WITH {flows}, named AS (SELECT {named} AS mode FROM flows WHERE o IS NOT NULL AND d IS NOT NULL AND m <> 0) SELECT mode, ROUND(COUNT(*) / CAST((SELECT COUNT(mode) FROM named) AS DOUBLE), 6) AS share FROM named WHERE mode IS NOT NULL GROUP BY 1",
        "gen_rates": f"WITH {_generated_rates()} SELECT * FROM gen_rates",
        "gen_shipments": f"WITH {_generated_rates()},\n{_generated_ships()} SELECT * FROM gen_ships",
        "flag_zscore_nation": q(f"SELECT {FLAG_COLUMNS} FROM z", Z, lane=NATION),
        "flag_iqr_nation": q(f"SELECT {FLAG_COLUMNS} FROM iqr", IQR, lane=NATION),
        "lane_week_trends_nation": q("SELECT * FROM judged", TRENDS.replace("COUNT(*) >= 5", "COUNT(*) >= 2"), lane=NATION),
        "vw_lane_risk_nation": q(RISK, FLAGS, MARKED, lane=NATION),
        "top_expensive_lanes_nation": q(expensive, lane=NATION),
    }
