"""The same queries as plain SQL, for checking the registered queries against another engine.

Written from the definitions of the operators, not from the Spark plans: global
row numbers instead of blocks, whole-table quantiles instead of brackets.
"""

from __future__ import annotations

from thermalframe import config as C

SENSORS = ["UCWIT", "UCWOT", "UCAIT", "UCAOT", "UCWF", "UCAF", "UCAIH", "AMBT", "UCTSP", "UCFS", "UCWDP"]
TARGETS = ["UCAOT", "UCWOT", "UCAF"]
FEATURES = [c for c in SENSORS if c not in TARGETS]
DENSE = [c for c in SENSORS if c != "UCAIH"]
MODEL_INPUTS = ["UCWIT", "UCAIT", "UCWF", "AMBT", "UCTSP", "UCFS", "UCWDP"]
DRIFT = ["UCWIT", "UCAIT", "UCWF", "AMBT", "UCTSP"]
INPUTS = ["UCWIT", "UCAIT", "UCWF", "AMBT", "UCTSP", "UCFS", "UCWDP"]


def each(template: str, names: list[str], sep: str = ", ") -> str:
    return sep.join(template.replace("{c}", n) for n in names)


def union(template: str, names: list[str]) -> str:
    return each(template, names, " UNION ALL ")


READINGS = """
ev AS (SELECT event_id AS e, ts, user_id AS u, value AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
sensors AS (SELECT e AS sample_id, e // 2500 AS unit_id, ts,
  CASE WHEN e BETWEEN 3000 AND 3014 OR (e % 11 BETWEEN 3 AND 9 AND e % 77 < 22) THEN NULL ELSE 6e0 + k / 8e0 END AS UCWIT,
  CASE WHEN e % 13 = 5 THEN NULL WHEN e % 211 = 0 THEN 14999.8e0 ELSE 8e0 + k / 8e0 + v / 100e0 END AS UCWOT,
  CASE WHEN e % 17 = 2 THEN NULL ELSE 18e0 + (u % 20) / 2e0 END AS UCAIT,
  CASE WHEN e % 199 = 0 THEN -273.2e0 ELSE 18e0 + (u % 20) / 2e0 + v / 50e0 END AS UCAOT,
  CASE WHEN e % 29 = 0 THEN -v WHEN e % 31 = 0 THEN 0e0 ELSE 3e0 * v END AS UCWF,
  CASE WHEN e % 97 = 0 THEN 65535e0 WHEN e % 101 = 0 THEN 65534e0 ELSE 372e0 + 20e0 * v END AS UCAF,
  CASE WHEN e % 4 = 0 THEN 40e0 + k / 4e0 END AS UCAIH,
  15e0 + (e % 160) / 8e0 AS AMBT,
  CASE WHEN e % 23 = 7 THEN NULL ELSE 21e0 + CAST((e // 500) % 15 AS DOUBLE) END AS UCTSP,
  800e0 + CAST((e * 37) % 700 AS DOUBLE) AS UCFS,
  CASE WHEN e % 19 = 0 THEN 0e0 ELSE k / 25e0 END AS UCWDP
  FROM ev)"""

_NULLED = {c: f"CASE WHEN {c} IN (65535, 65534, 0, -999, -9999) THEN NULL ELSE {c} END" for c in SENSORS}
_NULLED["UCAF"] = "CASE WHEN UCAF IN (65535, 65534, 0, -999, -9999) OR UCAF >= 65534 THEN NULL ELSE UCAF END"
_POSITIVE = {c: f"CASE WHEN {c} < 0 THEN 0e0 ELSE {c} END" for c in SENSORS if "F" in c}


def _clipped(c: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END"


_LIMITS = {"UCAIH": ("0e0", "100e0"), "UCWF": ("0e0", "20000e0"), "UCAF": ("0e0", "20000e0"),
           **{c: ("-10e0", "150e0") for c in ("UCWIT", "UCWOT", "UCAIT", "UCAOT", "AMBT")}}
_PHYSICAL = {c: _clipped(c, *lim) for c, lim in _LIMITS.items()}


def _over(exprs: dict[str, str], source: str) -> str:
    return f"SELECT sample_id, unit_id, {', '.join(f'{exprs.get(c, c)} AS {c}' for c in SENSORS)} FROM {source}"


BOUNDED = READINGS + f""",
nulled AS ({_over(_NULLED, 'sensors')}),
positive AS ({_over(_POSITIVE, 'nulled')}),
bounded AS ({_over(_PHYSICAL, 'positive')})"""

PARTS = BOUNDED + """,
numbered AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS pos, count(*) OVER () AS total FROM bounded),
parts AS (SELECT *, CASE WHEN pos < floor(total * 0.7e0) THEN 'train' WHEN pos < floor(total * 0.85e0) THEN 'val'
  ELSE 'test' END AS split FROM numbered)"""

_MODELS = {
    "mixing": {"UCAOT": "UCAIT + 0.1e0 * (UCWIT - UCAIT)", "UCWOT": "UCWIT + 0.3e0 * (UCAIT - UCWIT)",
               "UCAF": "372e0 + 0.5e0 * UCFS"},
    "inlet": {"UCAOT": "UCAIT", "UCWOT": "UCWIT", "UCAF": "UCFS"},
}
PRED = PARTS + f""",
pred AS (SELECT *, {', '.join(f'{e} AS {t}_pred' for t, e in _MODELS['mixing'].items())} FROM parts)"""
PAIRS = PARTS + f""",
pairs AS ({' UNION ALL '.join(
    f"SELECT sample_id, split AS dataset, '{m}' AS model, '{t}' AS target, {t} AS y, {e} AS yhat, UCTSP, AMBT, pos FROM parts"
    for m, es in _MODELS.items() for t, e in es.items())}),
known AS (SELECT *, y - yhat AS e FROM pairs WHERE y IS NOT NULL AND yhat IS NOT NULL)"""

_R2 = ("CASE WHEN count(*) > 1 THEN CASE WHEN count(*) * var_pop(y) > 0 THEN 1e0 - sum(e * e) / (count(*) * var_pop(y)) "
       "WHEN sum(e * e) = 0 THEN 1e0 ELSE 0e0 END END")


def scores(by: str, source: str = "known", digits: int = 4) -> str:
    return (f"SELECT {by}, count(*) AS n, round(avg(abs(e)), {digits}) AS mae, round(sqrt(avg(e * e)), {digits}) AS rmse, "
            f"round(avg(CASE WHEN y <> 0 THEN abs(e / y) END) * 100, {digits}) AS mape, round({_R2}, {digits}) AS r2, "
            f"round(max(abs(e)), {digits}) AS max_error FROM {source} GROUP BY {by}")


METRICS = PAIRS + f",\nmetrics AS ({scores('model, dataset, target')})"

FILL = BOUNDED + f""",
forward AS (SELECT sample_id, unit_id, {each(
    'last_value({c} IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY sample_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS {c}',
    SENSORS)} FROM bounded),
backward AS (SELECT sample_id, unit_id, {each(
    'first_value({c} IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY sample_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS {c}',
    SENSORS)} FROM forward),
means AS (SELECT {each('avg({c}) AS {c}', DENSE)} FROM backward)"""

# --- quantile bounds ----------------------------------------------------------


def quart(c: str, p: str) -> str:
    return f"round(quantile_cont({c}, {p}), 9)"


def fences(source: str, names: list[str], k: str) -> str:
    return union(f"SELECT '{{c}}' AS col, q1, q3, round(q1 - {k} * (q3 - q1), 9) AS lo, round(q3 + {k} * (q3 - q1), 9) AS hi FROM "
                 f"(SELECT {quart('{c}', '0.25')} AS q1, {quart('{c}', '0.75')} AS q3 FROM {source})", names)


def long(source: str, names: list[str], keep: str = "sample_id") -> str:
    return union(f"SELECT {keep}, '{{c}}' AS col, {{c}} AS x FROM {source}", names)


# --- drift ----------------------------------------------------------------------


def tagged(names: list[str]) -> str:
    return union("SELECT '{c}' AS feature, {c} AS x, split = 'train' AS is_ref FROM parts WHERE split IN ('train', 'val')", names)


def drift_ctes(names: list[str]) -> str:
    return _drift_from(f"tagged AS (SELECT * FROM ({tagged(names)}) WHERE x IS NOT NULL)")


def _drift_from(source: str) -> str:
    grid = ", ".join(f"{i / 10}" for i in range(11))
    return f"""{source},
deciles AS (SELECT feature, list_transform(quantile_cont(x, [{grid}]), lambda q: round(q, 9)) AS q FROM tagged WHERE is_ref GROUP BY feature),
edges AS (SELECT feature, list_sort(list_distinct(q)) AS edges, len(list_distinct(q)) - 1 AS bins FROM deciles),
placed AS (SELECT t.*, bins, edges, CASE WHEN bins > 0 AND x >= edges[1] AND x <= edges[bins + 1] THEN
  CASE WHEN x = edges[bins + 1] THEN bins ELSE len(list_filter(edges, lambda d: d <= x)) END END AS bin
  FROM tagged t JOIN edges USING (feature)),
sizes AS (SELECT feature, count(*) FILTER (is_ref) AS n_ref, count(*) FILTER (NOT is_ref) AS n_cur,
  avg(x) FILTER (is_ref) AS ref_mean, avg(x) FILTER (NOT is_ref) AS cur_mean,
  stddev_samp(x) FILTER (is_ref) AS ref_std, stddev_pop(x) FILTER (NOT is_ref) AS cur_std FROM tagged GROUP BY feature),
bins AS (SELECT feature, unnest(range(1, bins + 1)) AS bin FROM edges),
counts AS (SELECT feature, bin, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM placed WHERE bin IS NOT NULL GROUP BY feature, bin),
shares AS (SELECT b.feature, CASE WHEN coalesce(r, 0) = 0 THEN 0.0001e0 ELSE r / CAST(n_ref AS DOUBLE) END AS r,
  CASE WHEN n_cur = 0 THEN NULL WHEN coalesce(c, 0) = 0 THEN 0.0001e0 ELSE c / CAST(n_cur AS DOUBLE) END AS c
  FROM bins b JOIN sizes USING (feature) LEFT JOIN counts USING (feature, bin)),
psi AS (SELECT s.feature, coalesce(p, 0e0) AS psi FROM sizes s LEFT JOIN
  (SELECT feature, sum((c - r) * ln(c / r)) AS p FROM shares GROUP BY feature) USING (feature)),
steps AS (SELECT feature, x, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM tagged GROUP BY feature, x),
runs AS (SELECT feature, abs(sum(r) OVER w / CAST(n_ref AS DOUBLE) - sum(c) OVER w / CAST(n_cur AS DOUBLE)) AS d
  FROM steps JOIN sizes USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY x)),
ks AS (SELECT feature, n_ref, n_cur, max(d) AS ks FROM runs JOIN sizes USING (feature) GROUP BY feature, n_ref, n_cur),
ksp AS (SELECT *, ks * ks * (n_ref * n_cur / CAST(n_ref + n_cur AS DOUBLE)) AS l2 FROM ks),
kst AS (SELECT feature, n_ref, n_cur, ks, CASE WHEN l2 < 0.04e0 THEN 1e0 ELSE greatest(0e0, least(1e0,
  list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 2e0 ELSE -2e0 END * exp(-2e0 * j * j * l2))))) END AS p_value FROM ksp),
drift AS (SELECT s.feature, CASE WHEN psi > 0.2 AND p_value < 0.05 THEN 'CRITICAL' WHEN psi > 0.2 OR p_value < 0.05 THEN 'WARNING'
  ELSE 'STABLE' END AS status, round(psi, 4) AS psi, round(ks, 4) AS ks_statistic, round(p_value, 4) AS ks_pvalue,
  round(ref_mean, 4) AS reference_mean, round(cur_mean, 4) AS current_mean, round((cur_mean - ref_mean) / ref_mean * 100, 2) AS mean_change_pct,
  round(ref_std, 4) AS reference_std, round(cur_std, 4) AS current_std FROM sizes s JOIN psi USING (feature) JOIN kst USING (feature))"""


DRIFT_CTE = PARTS + ",\n" + drift_ctes(DRIFT)
SUMMARY = """SELECT count(*) AS total_features, count(*) FILTER (status = 'CRITICAL') AS critical_features,
  count(*) FILTER (status = 'WARNING') AS warning_features, count(*) FILTER (status = 'STABLE') AS stable_features,
  CASE WHEN count(*) FILTER (status = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (status = 'WARNING') > 0 THEN 'WARNING'
  ELSE 'STABLE' END AS overall_status,
  round(count(*) FILTER (status IN ('CRITICAL', 'WARNING')) * 100e0 / count(*), 2) AS drift_percentage FROM drift"""

# --- features ----------------------------------------------------------------------

_FULL_1 = {
    "delta_T_water": "UCWIT - UCWOT", "delta_T_air": "UCAOT - UCAIT", "T_approach": "UCWIT - UCAIT",
    "T_water_avg": "(UCWIT + UCWOT) / 2e0", "T_air_avg": "(UCAIT + UCAOT) / 2e0",
    "mdot_water": "UCWF * 1000e0 / 60000e0", "mdot_air": "UCAF * 1.2e0 / 3600e0",
    "Re_air_estimate": "pow(UCAF + 1e0, 0.8e0)",
    "flow_ratio": "CASE WHEN UCWF + 1e0 <> 0 THEN (UCAF + 1e0) / (UCWF + 1e0) END",
    "setpoint_error": "UCTSP - UCAOT", "setpoint_error_abs": "abs(UCTSP - UCAOT)",
    "P_fan_estimate": "pow(UCAF + 1e0, 1.5e0) * 0.001e0", "P_pump_estimate": "(UCWF + 1e0) * 0.01e0",
    "T_water_x_flow": "UCWIT * UCWF", "T_air_x_flow": "UCAIT * UCAF", "humidity_x_temp": "UCAIH * UCAIT",
    "ambient_x_inlet": "AMBT * UCAIT",
}
_FULL_2 = {
    "Q_water": "mdot_water * 4186e0 * delta_T_water * 0.001e0", "Q_air": "mdot_air * 1005e0 * delta_T_air * 0.001e0",
    "effectiveness": _clipped("(abs(delta_T_air) / (abs(UCWIT - UCAIT) + 1e-9))", "0e0", "1e0"),
    "cmin": "CASE WHEN mdot_water * 4186e0 < mdot_air * 1005e0 THEN mdot_water * 4186e0 WHEN mdot_water IS NOT NULL AND mdot_air IS NOT NULL THEN mdot_air * 1005e0 END",
    "cmax": "CASE WHEN mdot_water * 4186e0 < mdot_air * 1005e0 THEN mdot_air * 1005e0 WHEN mdot_water IS NOT NULL AND mdot_air IS NOT NULL THEN mdot_water * 4186e0 END",
    "delta_T_ratio": "(abs(delta_T_air) + 0.1e0) / (abs(delta_T_water) + 0.1e0)",
    "P_total_estimate": "P_fan_estimate + P_pump_estimate",
}
_FULL_3 = {
    "Q_avg": "(abs(Q_water) + abs(Q_air)) / 2e0", "Q_imbalance": "Q_water - Q_air",
    "efficiency_HX": _clipped("(abs(Q_air) / (abs(Q_water) + 1e-9))", "0e0", "1e0"),
    "NTU": _clipped(f"(-ln(1e0 - {_clipped('effectiveness', '0e0', '0.999e0')} + 1e-6))", "0e0", "10e0"),
    "C_ratio": _clipped("(cmin / (cmax + 1e-9))", "0e0", "1e0"),
}
_FULL_4 = {
    "Q_imbalance_pct": "100e0 * Q_imbalance / (abs(Q_avg) + 1e-9)",
    "COP_estimate": _clipped("(abs(Q_avg) / (P_total_estimate + 1e-9))", "0e0", "20e0"),
}
_TIME = ("CAST(time_index AS BIGINT) AS time_index, (time_index % 1440) / 60e0 AS cycle_hour, "
         "sin(2e0 * pi() * ((time_index % 1440) / 60e0) / 24e0) AS hour_sin, cos(2e0 * pi() * ((time_index % 1440) / 60e0) / 24e0) AS hour_cos")
INDEXED = BOUNDED + """,
indexed AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY sample_id) - 1 AS time_index FROM bounded)"""


def _add(exprs: dict[str, str], source: str) -> str:
    return f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM {source})"


FULL = INDEXED + f""",
f1 AS {_add(_FULL_1, 'indexed')}, f2 AS {_add(_FULL_2, 'f1')}, f3 AS {_add(_FULL_3, 'f2')}, f4 AS {_add(_FULL_4, 'f3')},
f5 AS (SELECT * EXCLUDE (time_index), {_TIME} FROM f4)"""

FULL_GROUPS = {
    "temperature": ["delta_T_water", "delta_T_air", "T_approach", "T_water_avg", "T_air_avg"],
    "mass_flow": ["mdot_water", "mdot_air"],
    "thermal_power": ["Q_water", "Q_air", "Q_avg", "Q_imbalance", "Q_imbalance_pct"],
    "efficiency": ["efficiency_HX", "effectiveness"],
    "ntu": ["NTU"],
    "dimensionless": ["C_ratio", "Re_air_estimate"],
    "ratios": ["flow_ratio", "delta_T_ratio", "setpoint_error", "setpoint_error_abs"],
    "power": ["P_fan_estimate", "P_pump_estimate", "P_total_estimate", "COP_estimate"],
    "temporal": ["time_index", "cycle_hour", "hour_sin", "hour_cos"],
    "interactions": ["T_water_x_flow", "T_air_x_flow", "humidity_x_temp", "ambient_x_inlet"],
}
_FREE_1 = {
    "T_approach": "UCWIT - UCAIT", "T_water_ambient_diff": "UCWIT - AMBT", "T_air_ambient_diff": "UCAIT - AMBT",
    "setpoint_inlet_diff": "UCTSP - UCAIT", "setpoint_ambient_diff": "UCTSP - AMBT",
    "mdot_water": "UCWF * 1000e0 / 60000e0", "P_fan_estimate": "pow(abs(UCFS) + 1e0, 1.5e0) * 0.001e0",
    "T_water_x_flow": "UCWIT * UCWF", "ambient_x_inlet": "AMBT * UCAIT", "setpoint_x_flow": "UCTSP * UCWF",
    "T_water_x_pressure": "UCWIT * UCWDP",
}
_PUMP = "UCWF * UCWDP * 0.0001e0"
_PUMP_SERVING = f"CASE WHEN UCWDP <> 0 THEN {_PUMP} WHEN UCWDP = 0 THEN (UCWF + 1e0) * 0.01e0 END"


def free(source: str, pump: str = _PUMP) -> str:
    two = {"P_pump_estimate": pump, "C_water": "mdot_water * 4186e0 * 0.001e0"}
    three = {"P_total_estimate": "P_fan_estimate + P_pump_estimate", "Q_max_water": "C_water * abs(T_approach)"}
    return f"g1 AS {_add(_FREE_1, source)}, g2 AS {_add(two, 'g1')}, g3 AS {_add(three, 'g2')}"


LEAK_FREE = ["T_approach", "T_water_ambient_diff", "T_air_ambient_diff", "setpoint_inlet_diff", "setpoint_ambient_diff",
             "mdot_water", "C_water", "Q_max_water", "P_fan_estimate", "P_pump_estimate", "P_total_estimate",
             "time_index", "cycle_hour", "hour_sin", "hour_cos",
             "T_water_x_flow", "ambient_x_inlet", "setpoint_x_flow", "T_water_x_pressure"]


TRANSCENDENTAL = ["hour_sin", "hour_cos", "NTU", "Re_air_estimate", "P_fan_estimate", "P_total_estimate", "COP_estimate"]


def r6(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" if n in TRANSCENDENTAL else n for n in names)


def magnitude(c: str, digits: int) -> str:
    return f"CASE WHEN abs({c}) > 1e9 THEN round({c}, -6) ELSE round({c}, {digits}) END"


# --- correlations -------------------------------------------------------------------

def corr_pairs(source: str, pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN isnan(r) THEN NULL ELSE r END AS r FROM "
                              f"(SELECT corr({a}, {b}) AS r FROM {source})" for a, b in pairs)


def importance(source: str, names: list[str]) -> str:
    return (f"SELECT b AS target, a AS feature, coalesce(abs(r), 0e0) AS importance FROM "
            f"({corr_pairs(source, [(f, t) for t in TARGETS for f in names if f != t])})")


IMPORTANCE = BOUNDED + f",\nimp AS ({importance('bounded', INPUTS)}), imp_mean AS (SELECT feature, avg(importance) AS mean FROM imp GROUP BY feature)"


def groups(table: dict) -> str:
    return "grp(\"group\", feature) AS (VALUES " + ", ".join(f"('{g}', '{f}')" for g, fs in table.items() for f in fs) + ")"


GROUPED = ("SELECT \"group\", round(avg(mean), 4) AS mean_importance, round(sum(mean), 4) AS sum_importance, count(*) AS n_features "
           "FROM grp JOIN imp_mean USING (feature) GROUP BY \"group\"")

# --- messages ------------------------------------------------------------------------

MESSAGES = """
msg AS (SELECT event_id, event_type, value, ts, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  ['INFO', 'WARNING', 'ERROR', 'CRITICAL'][event_id % 4 + 1] AS severity, event_id % 50 = 0 AS broken,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS sent FROM events),
topics AS (SELECT *, CASE event_type WHEN 'view' THEN 'hvac/sensors/data' WHEN 'purchase' THEN 'hvac/predictions/results'
  WHEN 'error' THEN 'hvac/alerts/' || lower(severity) WHEN 'signup' THEN 'hvac/status' ELSE 'hvac/sensors/raw' END AS topic FROM msg),
texts AS (SELECT *, CASE WHEN broken THEN '{broken ' || event_id
  WHEN event_type = 'error' THEN '{"timestamp":"' || sent || '","type":"drift","message":"Feature drift in UCWIT","severity":"' || severity || '"}'
  WHEN event_type = 'signup' THEN '{"timestamp":"' || sent || '","status":"ONLINE","details":{"version":"1.0"}}' END AS payload FROM topics)"""


def _latest() -> str:
    return ("WITH " + MESSAGES + " SELECT topic, arg_max(payload, (ts, event_id)) AS payload, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM texts "
            "WHERE topic LIKE 'hvac/alerts/%' OR topic LIKE 'hvac/status%' GROUP BY topic")


# --- windowed drift --------------------------------------------------------------------

_WINDOWED = """,
live AS (SELECT date_trunc('hour', s.ts) AS w, feature, x FROM (SELECT sample_id, ts FROM sensors) s JOIN (""" + \
    union("SELECT sample_id, '{c}' AS feature, {c} AS x FROM bounded", DRIFT) + """) l USING (sample_id) WHERE x IS NOT NULL),
wplaced AS (SELECT w, l.feature, CASE WHEN bins > 0 AND x >= edges[1] AND x <= edges[bins + 1] THEN
  CASE WHEN x = edges[bins + 1] THEN bins ELSE len(list_filter(edges, lambda d: d <= x)) END END AS bin FROM live l JOIN edges USING (feature)),
wsize AS (SELECT w, feature, count(*) AS n_cur FROM wplaced GROUP BY w, feature),
wbins AS (SELECT w, feature, bin, count(*) AS c FROM wplaced WHERE bin IS NOT NULL GROUP BY w, feature, bin),
wshares AS (SELECT s.w, s.feature, n_cur, CASE WHEN coalesce(k.r, 0) = 0 THEN 0.0001e0 ELSE k.r / CAST(n_ref AS DOUBLE) END AS r,
  CASE WHEN coalesce(wb.c, 0) = 0 THEN 0.0001e0 ELSE wb.c / CAST(n_cur AS DOUBLE) END AS c
  FROM wsize s JOIN bins b USING (feature) JOIN (SELECT feature, n_ref FROM sizes) z USING (feature)
  LEFT JOIN (SELECT feature, bin, r FROM counts) k USING (feature, bin) LEFT JOIN wbins wb ON wb.w = s.w AND wb.feature = s.feature AND wb.bin = b.bin),
wpsi AS (SELECT w, feature, n_cur, sum((c - r) * ln(c / r)) AS psi FROM wshares GROUP BY w, feature, n_cur)"""


# --- queries ------------------------------------------------------------------------------

def _describe(source: str, names: list[str]) -> str:
    return union("SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
                 "round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, "
                 f"round(quantile_cont({{c}}, 0.75), 4) AS q75, round(max({{c}}), 4) AS max FROM {source}", names)


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}

    def add(name: str, prelude: str, body: str) -> None:
        q[name] = f"WITH {prelude}\n{body}" if prelude else body

    ids = "sample_id, unit_id, "
    cols = ", ".join(SENSORS)
    # scans
    add("scan_csv", READINGS, f"SELECT sample_id, {cols} FROM sensors WHERE {' OR '.join(f'{c} IS NOT NULL' for c in SENSORS)}")
    add("scan_parquet_sensors", READINGS, f"SELECT {ids}{cols} FROM sensors")
    meta = [("sample_id", "bigint"), ("unit_id", "bigint"), *[(c, "double") for c in SENSORS]]
    add("dataset_metadata", "", "SELECT c AS \"column\", d AS dtype, CAST(i AS BIGINT) AS ordinal, (SELECT count(*) FROM events) AS rows FROM (VALUES "
        + ", ".join(f"('{c}', '{d}', {i})" for i, (c, d) in enumerate(meta)) + ") t(c, d, i)")
    roles = [("target", n) for n in C.KEY_TARGETS] + [("input", n) for n in C.KEY_INPUTS]
    add("role_presence", READINGS, " UNION ALL ".join(
        f"SELECT '{r}' AS role, '{n}' AS name, {'true' if n in SENSORS else 'false'} AS present, "
        f"{f'count({n})' if n in SENSORS else 'count(NULL)'} AS known FROM sensors" for r, n in roles))
    add("write_dataset", PARTS, "SELECT split, count(*) AS rows, round(avg(AMBT), 4) AS mean_ambt FROM parts GROUP BY split")
    add("split_manifest", PARTS, "SELECT split, count(*) AS rows, round(count(*) * 1e0 / sum(count(*)) OVER () * 100, 4) AS pct, "
        "CAST(8 AS BIGINT) AS features, CAST(3 AS BIGINT) AS targets FROM parts GROUP BY split")
    add("write_results", METRICS, "SELECT * FROM metrics")
    add("drift_report_json", DRIFT_CTE, f"SELECT overall_status, drift_percentage, feature, status, psi, ks_statistic, reference_mean, current_mean FROM drift, ({SUMMARY})")
    add("load_reference_table", PARTS, f"SELECT sample_id, {', '.join(DRIFT)} FROM parts WHERE split = 'train'")
    add("stream_sensor_messages", MESSAGES, "SELECT event_id, topic, k AS UCWIT, value AS UCAIT FROM topics WHERE NOT broken AND topic = 'hvac/sensors/data'")
    q["message_log_stream"] = q["stream_sensor_messages"]
    add("message_log_batch", MESSAGES, "SELECT event_id, topic, event_id % 2 AS segment, CASE WHEN broken THEN 'invalid JSON' END AS reason FROM topics")
    add("publish_messages", MESSAGES, """SELECT event_id, topic, CASE WHEN NOT broken AND event_type <> 'click' THEN sent END AS sent,
      CASE WHEN NOT broken AND event_type = 'view' THEN k END AS UCWIT,
      CASE WHEN NOT broken AND event_type IN ('view', 'click') THEN value END AS UCAIT,
      CASE WHEN NOT broken AND event_type = 'purchase' THEN value END AS UCAOT,
      CASE WHEN NOT broken AND event_type = 'error' THEN severity END AS severity,
      CASE WHEN NOT broken AND event_type = 'signup' THEN 'ONLINE' END AS status FROM topics""")
    inputs = [n for n, t, _ in C.POINT_MAP if t == "analogInput"]
    mapped = [n for n, _, _ in C.POINT_MAP if n in SENSORS]
    any_known = " OR ".join(f"{n} IS NOT NULL" for n in inputs)
    add("points_read", READINGS, f"SELECT sample_id, {', '.join(inputs)} FROM sensors WHERE {any_known}")
    mix = _MODELS["mixing"]
    qth = f"UCWF * 1e0 / 60e0 * 4.186e0 * (UCWIT - ({mix['UCWOT']}))"
    out = {**mix, "Q_thermal": qth}
    add("points_write", BOUNDED, "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT sample_id, '{n}' AS name, '{t}' AS object_type, CAST({i} AS INTEGER) AS instance, {out[n]} AS value FROM bounded"
        for n, t, i in C.POINT_MAP if n in out) + ") WHERE value IS NOT NULL")
    # projections
    add("project_xy", BOUNDED, f"SELECT sample_id, {', '.join(FEATURES)}, {each('{c} AS y_{c}', TARGETS)} FROM bounded")
    kinds = {"UCWIT": "temperature", "UCWOT": "temperature", "UCAIT": "temperature", "UCAOT": "temperature", "UCWF": "flow",
             "UCAF": "flow", "UCAIH": "other", "AMBT": "temperature", "UCTSP": "other", "UCFS": "other", "UCWDP": "other"}
    add("classify_columns", READINGS, " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS kind, {'true' if 'F' in c else 'false'} AS non_negative, count({c}) AS known FROM sensors"
        for c, k in kinds.items()))
    add("sentinel_to_null", READINGS, _over(_NULLED, "sensors"))
    add("fix_negative_flows", READINGS, _over(_POSITIVE, "sensors"))
    add("clip_physical", READINGS, _over(_PHYSICAL, "sensors"))
    add("clip_counts", READINGS, " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS clipped FROM sensors" for c, (lo, hi) in _LIMITS.items()))
    add("drop_sparse_columns", BOUNDED, f"SELECT {ids}{', '.join(DENSE)} FROM bounded")
    add("drop_sparse_features_50", BOUNDED, f"SELECT {ids}{', '.join(DENSE)} FROM bounded WHERE {each('{c} IS NOT NULL', TARGETS, ' OR ')}")
    add("drop_null_rows", BOUNDED, f"SELECT {ids}{', '.join(DENSE)} FROM bounded WHERE {each('{c} IS NOT NULL', DENSE, ' AND ')}")
    add("drop_rows_all_targets_null", BOUNDED, f"SELECT sample_id, {', '.join(TARGETS)} FROM bounded WHERE {each('{c} IS NOT NULL', TARGETS, ' OR ')}")
    add("physics_flags", READINGS, "SELECT coalesce(abs(UCWIT - UCWOT) > 50, false) AS \"water_delta_T\", coalesce(abs(UCAOT - UCAIT) > 50, false) AS \"air_delta_T\", count(*) AS rows FROM sensors GROUP BY 1, 2")
    defaults = {"AMBT": "20e0", "UCTSP": "21e0", "UCAIT": "20e0", "UCWIT": "20e0"}
    add("default_inputs", READINGS, "SELECT sample_id, " + ", ".join(
        f"coalesce({c}, {defaults.get(c, '0e0')}) AS {c}" if c in C.INPUT_SENSORS else c for c in FEATURES) + " FROM sensors")
    checks = ", ".join(f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN NULL ELSE '{c}' END" for c, lo, hi in C.RANGE_RULES)
    add("validate_ranges", READINGS, f"SELECT sample_id, failed = '' AS valid, failed FROM (SELECT sample_id, concat_ws(',', {checks}) AS failed FROM sensors)")
    share = "(" + each("CAST({c} IS NOT NULL AS INTEGER)", FEATURES, " + ") + ") / 8e0"
    add("leakage_check", BOUNDED, f"SELECT {share} >= 0.8 AS usable, count(*) AS rows, 'UCAOT,UCWOT,UCAF' AS leaking_in_frame, '' AS leaking_in_features, 'mdot_air' AS missing_physics FROM bounded GROUP BY 1")
    add("filter_results", METRICS, "SELECT * FROM metrics WHERE dataset = 'test' AND model = 'mixing' AND target = 'UCAOT'")
    # joins
    add("join_pred_actual", BOUNDED, "SELECT sample_id, " + ", ".join(TARGETS) + ", " + ", ".join(f"{e} AS {t}_pred" for t, e in mix.items()) + " FROM bounded")
    comparison = """SELECT c.target, c.dataset, c.r2 AS candidate_r2, c.mae AS candidate_mae, c.mape AS candidate_mape, b.r2 AS baseline_r2,
      b.mae AS baseline_mae, b.mape AS baseline_mape, round(CASE WHEN b.r2 <> 0 THEN (c.r2 - b.r2) / abs(b.r2) END * 100, 4) AS r2_gain_pct,
      round(CASE WHEN b.mape <> 0 THEN (b.mape - c.mape) / b.mape END * 100, 4) AS mape_gain_pct
      FROM metrics c JOIN metrics b USING (target, dataset) WHERE c.model = 'mixing' AND b.model = 'inlet'"""
    add("join_model_comparison", METRICS, comparison)
    add("join_importance_models", IMPORTANCE, "SELECT feature, " + each(
        "round(max(importance) FILTER (target = '{c}'), 4) AS {c}", TARGETS) + " FROM imp GROUP BY feature")
    sides = each("round(avg({c}) FILTER (split = 'val'), 4) AS {c}_c, round(avg({c}) FILTER (split = 'train'), 4) AS {c}_r", DRIFT)
    add("join_reference_current", PARTS + f", m AS (SELECT {sides} FROM parts)" + ",\n" + drift_ctes(DRIFT),
        "SELECT feature, status, current_mean, reference_mean FROM drift UNION ALL "
        "SELECT * FROM (VALUES ('UCAIH', 'ERROR', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), ('UCFS', 'ERROR', NULL, NULL))")
    add("join_point_map", READINGS, " UNION ALL ".join(
        f"SELECT '{n}' AS name, '{t}' AS object_type, CAST({i} AS INTEGER) AS instance, count({n}) AS rows, round(avg({n}), 4) AS mean FROM sensors"
        for n, t, i in C.POINT_MAP if n in mapped))
    band = ("CASE WHEN UCTSP > 0 AND UCTSP <= 24 THEN 'Low Temp (21-24°C)' WHEN UCTSP > 24 AND UCTSP <= 27 THEN 'Mid Temp (24-27°C)' "
            "WHEN UCTSP > 27 AND UCTSP <= 35 THEN 'High Temp (27-31°C)' END")
    regime = PARTS + f",\nreg AS (SELECT *, {band} AS regime FROM parts)"
    add("join_regime_scaler", regime, """, big AS (SELECT regime FROM reg WHERE split = 'train' AND regime IS NOT NULL GROUP BY regime HAVING count(*) > 10),
      par AS (SELECT regime, avg(UCWIT) AS m1, CASE WHEN stddev_pop(UCWIT) = 0 THEN 1e0 ELSE stddev_pop(UCWIT) END AS s1, avg(AMBT) AS m2,
        CASE WHEN stddev_pop(AMBT) = 0 THEN 1e0 ELSE stddev_pop(AMBT) END AS s2 FROM reg JOIN big USING (regime) WHERE split = 'train' GROUP BY regime)
      SELECT sample_id, r.regime, round(UCWIT, 6) AS UCWIT, round(AMBT, 6) AS AMBT, round((UCWIT - m1) / s1, 6) AS "UCWIT_scaled", round((AMBT - m2) / s2, 6) AS "AMBT_scaled"
      FROM reg r LEFT JOIN par USING (regime)""")
    add("join_bins", DRIFT_CTE, "SELECT feature, is_ref, CAST(bin AS BIGINT) AS bin, count(*) AS rows FROM placed GROUP BY 1, 2, 3")
    names = sorted({f for fs in C.FEATURE_GROUPS.values() for f in fs})
    add("semi_features", IMPORTANCE, "SELECT feature, feature IN (SELECT feature FROM imp) AS present FROM (VALUES "
        + ", ".join(f"('{f}')" for f in names) + ") t(feature)")
    # profiles
    add("describe_stats", READINGS, _describe("sensors", SENSORS))
    add("summary_extended", READINGS, union(
        "SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, "
        "round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max, "
        "round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis, count(*) - count({c}) AS missing, "
        "round(round((count(*) - count({c})) * 1e0 / count(*) * 100, 2), 4) AS missing_pct, count(*) FILTER ({c} = 0) AS zeros, "
        "round(count(*) FILTER ({c} = 0) * 1e0 / count(*) * 100, 2) AS zeros_pct, count(DISTINCT {c}) AS \"unique\" FROM sensors", SENSORS))
    info = union("SELECT '{c}' AS \"column\", count(*) AS rows, CAST(11 AS BIGINT) AS columns, count(*) - count({c}) AS nulls, "
                 "round((count(*) - count({c})) * 1e0 / count(*) * 100, 4) AS null_pct FROM sensors", SENSORS)
    add("basic_info", READINGS, info)
    add("missing_summary", READINGS, f"SELECT \"column\", nulls, null_pct FROM ({info})")
    missing_all = "(" + each("count(*) - count({c})", SENSORS, " + ") + ")"
    add("quality_report", READINGS, f"""SELECT 'total_missing_cells' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST({missing_all} AS DOUBLE) AS value FROM sensors
      UNION ALL SELECT 'missing_pct_overall', NULL, round({missing_all} * 1e0 / (count(*) * 11) * 100, 2) FROM sensors
      UNION ALL SELECT 'duplicated_rows', NULL, CAST((SELECT count(*) FROM sensors) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM sensors)) AS DOUBLE)
      UNION ALL SELECT 'numeric_columns', NULL, 11e0 UNION ALL SELECT 'categorical_columns', NULL, 0e0 UNION ALL
      SELECT * FROM ({union("SELECT 'missing', '{c}', CAST(count(*) - count({c}) AS DOUBLE) AS n FROM sensors", SENSORS)}) WHERE n > 0
      UNION ALL SELECT * FROM ({union("SELECT 'constant', '{c}', CASE WHEN count(DISTINCT {c}) <= 1 THEN 1e0 ELSE 0e0 END AS n FROM sensors", SENSORS)}) WHERE n > 0
      UNION ALL SELECT * FROM ({union("SELECT 'infinite', '{c}', CAST(count(*) FILTER (isinf({c})) AS DOUBLE) AS n FROM sensors", SENSORS)}) WHERE n > 0""")
    add("duplicate_rows", "", "SELECT (SELECT count(*) FROM lineitem) - count(*) AS duplicates FROM (SELECT DISTINCT * FROM lineitem)")
    q["duplicate_rows_by_digest"] = q["duplicate_rows"]
    add("profile_from_daily_states", READINGS, union(
        "SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, round(min({c}), 4) AS minimum, round(max({c}), 4) AS maximum, "
        "round(avg({c}), 4) AS mean, CASE WHEN count({c}) > 0 THEN true END AS distinct_within_7_pct, CASE WHEN count({c}) > 0 THEN true END AS median_within_3_pct FROM sensors", SENSORS))
    add("constant_columns", READINGS, union("SELECT '{c}' AS \"column\", count(DISTINCT {c}) <= 1 AS constant FROM (SELECT *, 7e0 AS FIXED FROM sensors)", [*SENSORS, "FIXED"]))
    wide = "(SELECT *, CASE WHEN sample_id % 3 = 0 THEN 1e0 ELSE 0e0 END AS MOSTLY0 FROM sensors)"
    more = [*SENSORS, "MOSTLY0"]
    issue = [("missing_values", "CAST(count(*) - count({c}) AS DOUBLE)", more), ("constant_column", "CASE WHEN count(DISTINCT {c}) <= 1 THEN 1e0 ELSE 0e0 END", more),
             ("infinite_values", "CAST(count(*) FILTER (isinf({c})) AS DOUBLE)", more),
             ("high_zero_percentage", "CASE WHEN count(*) FILTER ({c} = 0) * 1e0 / count(*) * 100 > 50 THEN round(count(*) FILTER ({c} = 0) * 1e0 / count(*) * 100, 2) ELSE 0e0 END", more),
             ("negative_flow_values", "CAST(count(*) FILTER ({c} < 0) AS DOUBLE)", [c for c in more if "F" in c])]
    add("quality_issues", READINGS, "SELECT * FROM (" + " UNION ALL ".join(
        union(f"SELECT '{n}' AS issue, '{{c}}' AS \"column\", {e} AS value FROM {wide}", cs) for n, e, cs in issue) + ") WHERE value > 0")
    add("variable_ranges", READINGS, union("SELECT '{c}' AS \"column\", round(min({c}), 3) AS min, round(max({c}), 3) AS max, round(avg({c}), 3) AS mean, "
                                           "round(stddev_samp({c}), 3) AS std, round(max({c}) - min({c}), 3) AS range FROM sensors", SENSORS))
    every = [(a, b) for a in SENSORS for b in SENSORS]
    add("correlation_matrix", BOUNDED, f"SELECT a, b, round(r, 6) AS r FROM ({corr_pairs('bounded', every)})")
    hc = [*SENSORS, "delta_T_air", "mdot_water", "T_approach"]
    add("high_corr_pairs", FULL, f"SELECT a, b, round(r, 3) AS r FROM ({corr_pairs('f5', [(a, b) for i, a in enumerate(hc) for b in hc[i + 1:]])}) WHERE abs(r) >= 0.8")
    add("target_correlations", BOUNDED, union("SELECT '{c}' AS \"column\", " + ", ".join(
        f"round(corr({{c}}, {t}), 6) AS {t}" for t in TARGETS) + " FROM bounded", SENSORS))
    top = corr_pairs("bounded", [(c, t) for t in TARGETS for c in SENSORS if c != t])
    add("top_target_correlations", BOUNDED, f"SELECT target, feature, round(r, 6) AS r, rank FROM (SELECT b AS target, a AS feature, r, "
        f"row_number() OVER (PARTITION BY b ORDER BY abs(r) DESC NULLS LAST, a) AS rank FROM ({top})) WHERE rank <= 3")
    xlong = f", xs AS ({long('sensors', SENSORS)}), fence AS ({fences('sensors', SENSORS, '1.5e0')})"
    add("outliers_iqr", READINGS + xlong, "SELECT col AS \"column\", count(*) FILTER (x < lo OR x > hi) AS outliers FROM xs JOIN fence USING (col) GROUP BY col")
    add("outliers_zscore", READINGS, union("SELECT '{c}' AS \"column\", count(*) FILTER (abs(({c} - m) / s) > 1.5) AS outliers FROM sensors, "
                                           "(SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM sensors)", SENSORS))
    add("boxplot_stats", READINGS + xlong, "SELECT col AS \"column\", q1, q3, round(q3 - q1, 9) AS iqr, count(*) FILTER (x < lo OR x > hi) AS outliers, "
        "round(count(*) FILTER (x < lo OR x > hi) * 1e0 / count(x) * 100, 4) AS outlier_pct FROM xs JOIN fence USING (col) GROUP BY col, q1, q3")
    add("histogram_50", READINGS, union(
        "SELECT '{c}' AS \"column\", CAST(least(floor(({c} - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, round(m, 4) AS mean, round(s, 4) AS std, "
        "round(lo, 4) AS min, round(hi, 4) AS max, count(*) AS n FROM sensors, (SELECT min({c}) AS lo, max({c}) AS hi, avg({c}) AS m, stddev_samp({c}) AS s FROM sensors) "
        "WHERE {c} IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6", SENSORS))
    add("profile_lineitem", "", _describe("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
    add("impute_stats", FILL, union("SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median FROM backward", DENSE))
    clip3 = f", fence AS ({fences('bounded', DENSE, '3e0')}), w AS (SELECT {each(chr(10) + 'max(lo) FILTER (col = ' + chr(39) + '{c}' + chr(39) + ') AS {c}_lo, max(hi) FILTER (col = ' + chr(39) + '{c}' + chr(39) + ') AS {c}_hi', DENSE)} FROM fence)"
    add("outlier_clip_fit_apply", BOUNDED + clip3, f"SELECT sample_id, {each('CASE WHEN {c} < {c}_lo THEN {c}_lo WHEN {c} > {c}_hi THEN {c}_hi ELSE {c} END AS {c}', DENSE)} FROM bounded, w")
    train = PARTS + ", fitted AS (SELECT * FROM parts WHERE split = 'train')" + clip3.replace("FROM bounded", "FROM fitted")
    add("outlier_clip_fit_train_apply_test", train, f"SELECT sample_id, {each('CASE WHEN {c} < {c}_lo THEN {c}_lo WHEN {c} > {c}_hi THEN {c}_hi ELSE {c} END AS {c}', DENSE)} FROM parts, w WHERE split = 'test'")
    known = " AND ".join(f"{c} IS NOT NULL" for c in MODEL_INPUTS)
    add("least_squares_residuals", PARTS, union(f"SELECT '{{c}}' AS target, count(*) AS rows, CAST(0 AS BIGINT) AS mean_off, CAST(0 AS BIGINT) AS inputs_off FROM parts WHERE split = 'train' AND {{c}} IS NOT NULL AND {known}", TARGETS))
    add("save_load_model", PARTS, union(f"SELECT '{{c}}' AS target, count(*) AS rows, 0e0 AS largest_gap FROM parts WHERE {known}", TARGETS))
    add("outlier_clip_counts", BOUNDED + clip3 + f", xs AS ({long('bounded', DENSE)})",
        "SELECT col AS \"column\", round(lo, 6) AS lower, round(hi, 6) AS upper, count(*) FILTER (x < lo OR x > hi) AS clipped FROM xs JOIN fence USING (col) GROUP BY col, lo, hi")
    one = "CASE WHEN {s} = 0 THEN 1e0 ELSE {s} END"
    for method, center, spread in (("standard", "avg({c})", "stddev_pop({c})"), ("minmax", "min({c})", "(max({c}) - min({c}))"),
                                   ("robust", quart("{c}", "0.5"), f"round({quart('{c}', '0.75')} - {quart('{c}', '0.25')}, 9)")):
        add(f"scaler_{method}", PARTS, union(f"SELECT '{{c}}' AS \"column\", round({center}, 6) AS center, round({one.replace('{s}', spread)}, 6) AS scale FROM parts WHERE split = 'train'", DENSE))
    rcols = ["UCWIT", "UCAIT", "AMBT"]
    add("scaler_by_regime", regime, ", big AS (SELECT regime FROM reg WHERE split = 'train' AND regime IS NOT NULL GROUP BY regime HAVING count(*) > 10) " + union(
        "SELECT regime, '{c}' AS \"column\", round(" + quart("{c}", "0.5") + ", 6) AS center, round(" + one.replace("{s}", f"round({quart('{c}', '0.75')} - {quart('{c}', '0.25')}, 9)")
        + ", 6) AS scale FROM reg JOIN big USING (regime) WHERE split = 'train' GROUP BY regime", rcols))
    # metrics
    add("regression_metrics", METRICS, "SELECT * FROM metrics")
    add("residual_stats", PAIRS, f"""SELECT model, target, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS std, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse,
      round({_R2}, 4) AS r2, round(max(abs(e)), 4) AS max, round(quantile_cont(abs(e), 0.95), 4) AS p95, round(quantile_cont(abs(e), 0.99), 4) AS p99 FROM known GROUP BY model, target""")
    add("metrics_by_condition", PAIRS + f", banded AS (SELECT *, {band} AS condition FROM known)", scores("model, target, condition", "(SELECT * FROM banded WHERE condition IS NOT NULL)"))
    add("metrics_by_tercile", PAIRS + """, ter AS (SELECT round(min(AMBT), 9) AS t0, round(quantile_cont(AMBT, 0.3333333333333333e0), 9) AS t1,
      round(quantile_cont(AMBT, 0.6666666666666666e0), 9) AS t2, round(max(AMBT), 9) AS t3 FROM bounded),
      banded AS (SELECT known.*, CASE WHEN AMBT >= t0 AND AMBT <= t1 THEN 'Low' WHEN AMBT > t1 AND AMBT <= t2 THEN 'Mid' WHEN AMBT > t2 AND AMBT <= t3 THEN 'High' END AS condition FROM known, ter)""",
        scores("model, target, condition", "(SELECT * FROM banded WHERE condition IS NOT NULL)"))
    add("metrics_eps_mape", PAIRS + f""", v AS (SELECT target, {_R2} AS r2, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(e / (y + 1e-8))) * 100 AS mape,
      avg(y) AS mean_true, avg(yhat) AS mean_pred, stddev_pop(y) AS std_true, stddev_pop(yhat) AS std_pred FROM known WHERE model = 'mixing' GROUP BY target)""",
        """SELECT target, round(r2, 4) AS r2, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape, round(mean_true, 4) AS mean_true,
      round(mean_pred, 4) AS mean_pred, round(std_true, 4) AS std_true, round(std_pred, 4) AS std_pred, round(a, 4) AS avg_r2,
      CASE WHEN a >= 0.75 THEN 'EXCELLENT' WHEN a >= 0.6 THEN 'GOOD' WHEN a >= 0.4 THEN 'ACCEPTABLE' ELSE 'POOR' END AS verdict FROM v, (SELECT avg(r2) AS a FROM v)""")
    folds = "CAST(1 + (pos - (total - 5 * (total // 6))) // (total // 6) AS BIGINT)"
    add("cv_fold_metrics", PARTS + f""", f AS (SELECT *, {folds} AS fold FROM parts WHERE pos >= total - 5 * (total // 6)),
      fp AS ({' UNION ALL '.join(f"SELECT fold, '{t}' AS target, {t} AS y, {t} - ({e}) AS e FROM f WHERE {t} - ({e}) IS NOT NULL" for t, e in mix.items())}),
      fs AS ({scores('fold, target', 'fp')})""",
        "SELECT target, count(*) AS folds, round(avg(r2), 4) AS mean_r2, round(stddev_samp(r2), 4) AS std_r2, round(stddev_pop(r2), 4) AS std_pop_r2, "
        "round(avg(mae), 4) AS mean_mae, round(stddev_samp(mae), 4) AS std_mae, round(stddev_pop(mae), 4) AS std_pop_mae FROM fs GROUP BY target")
    add("improvement_vs_baseline", METRICS, "SELECT *, 125.5e0 AS baseline_mape, round((125.5e0 - mape) / 125.5e0 * 100, 4) AS improvement_pct FROM metrics WHERE dataset = 'test'")
    add("importance_mean", IMPORTANCE, "SELECT feature, round(mean, 4) AS mean FROM imp_mean")
    full_names = sorted((set(names) & (set(SENSORS) | {f for g in FULL_GROUPS.values() for f in g})) - set(FULL_GROUPS["temporal"]))
    add("importance_groups", FULL + f", imp AS ({importance('f5', full_names)}), imp_mean AS (SELECT feature, avg(importance) AS mean FROM imp GROUP BY feature), {groups(C.FEATURE_GROUPS)}", GROUPED)
    static_free = [f for f in LEAK_FREE if f not in FULL_GROUPS["temporal"]]
    marks = {g: [f for f in static_free if any(m in f for m in ms)] for g, ms in C.FEATURE_GROUP_MARKS.items()}
    add("importance_groups_by_name", BOUNDED + f", {free('bounded')}, imp AS ({importance('g3', static_free)}), imp_mean AS (SELECT feature, avg(importance) AS mean FROM imp GROUP BY feature), {groups(marks)}", GROUPED)
    # drift
    add("psi", DRIFT_CTE, "SELECT feature, round(psi, 4) AS psi FROM psi")
    add("ks_two_sample", DRIFT_CTE, "SELECT feature, n_ref, n_cur, round(ks, 4) AS ks, round(p_value, 4) AS p_value FROM kst")
    add("ks_exact_by_hour", """RECURSIVE e AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, value AS x, event_id % 2 = 0 AS is_ref
      FROM events WHERE value IS NOT NULL),
    v AS (SELECT hour, x, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM e GROUP BY ALL),
    f AS (SELECT hour, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY hour) AS n_ref, sum(c) OVER (PARTITION BY hour) AS n_cur
      FROM v WINDOW w AS (PARTITION BY hour ORDER BY x)),
    k AS (SELECT hour, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur, max(abs(cr * n_cur - cc * n_ref)) AS far FROM f GROUP BY ALL),
    sizes AS (SELECT DISTINCT least(n_ref, n_cur) AS m, greatest(n_ref, n_cur) AS n, far FROM k WHERE n_ref > 0 AND n_cur > 0),
    walk(m, n, far, s, i, u) AS (
      SELECT m, n, far, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CASE WHEN far <= 0 THEN 1e0 ELSE 0e0 END FROM sizes
      UNION ALL
      SELECT m, n, far, s, i, CASE WHEN far <= abs(i * n - (s - i) * m) THEN 1e0 ELSE p END FROM (
        SELECT m, n, far, s + 1 AS s, i + step AS i, sum(u * (CASE WHEN step = 1 THEN i + 1 ELSE s + 1 - i END) / (s + 1)) AS p
        FROM walk, (SELECT unnest([0, 1]) AS step) WHERE i + step <= m AND s + 1 - i - step <= n GROUP BY ALL))""",
        """SELECT hour, n_ref, n_cur, round(k.far / (n_ref * n_cur), 6) AS ks, round(u, 6) AS p_value
    FROM k LEFT JOIN walk ON m = least(n_ref, n_cur) AND n = greatest(n_ref, n_cur) AND walk.far = k.far AND s = m + n""")
    add("feature_drift", DRIFT_CTE, "SELECT * FROM drift")
    add("drift_summary", DRIFT_CTE, SUMMARY)
    add("drift_orders_by_priority", _drift_from("tagged AS (SELECT o_orderpriority AS feature, o_totalprice AS x, o_orderdate < TIMESTAMP '1999-01-01' AS is_ref FROM orders WHERE o_totalprice IS NOT NULL)"),
        "SELECT feature, n_ref, n_cur, round(psi, 4) AS psi, round(ks, 4) AS ks FROM kst JOIN psi USING (feature)")
    add("prediction_drift", PAIRS + f", r AS ({scores('target', chr(40) + chr(83) + 'ELECT * FROM known WHERE model = ' + chr(39) + 'mixing' + chr(39) + ' AND dataset = ' + chr(39) + 'train' + chr(39) + ')', 9)}), "
        f"n AS ({scores('target', '(SELECT * FROM known WHERE model = ' + chr(39) + 'mixing' + chr(39) + ' AND dataset = ' + chr(39) + 'val' + chr(39) + ')', 9)}), "
        "x AS (SELECT target, n.mae, n.rmse, n.r2, r.mae AS mae0, r.rmse AS rmse0, r.r2 AS r20, (n.mae - r.mae) / r.mae * 100 AS dm, (n.rmse - r.rmse) / r.rmse * 100 AS dr, r.r2 - n.r2 AS d2 FROM n JOIN r USING (target))",
        "SELECT target, CASE WHEN abs(dm) > 10 OR abs(dr) > 10 OR abs(d2) > 0.05 THEN 'WARNING' ELSE 'STABLE' END AS status, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 4) AS r2, "
        "round(dm, 2) AS mae_drift_pct, round(dr, 2) AS rmse_drift_pct, round(d2, 4) AS r2_drift, round(mae0, 4) AS reference_mae, round(rmse0, 4) AS reference_rmse, round(r20, 4) AS reference_r2 FROM x")
    add("latency_stats", "", """SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean_ms, round(stddev_pop(value), 4) AS std_ms, round(min(value), 4) AS min_ms, round(max(value), 4) AS max_ms,
      round(quantile_cont(value, 0.5), 4) AS p50_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms, round(quantile_cont(value, 0.99), 4) AS p99_ms,
      round(1000e0 / avg(value), 4) AS throughput, quantile_cont(value, 0.95) < 100 AS meets_sla FROM events GROUP BY event_type""")
    # physics
    qw = "UCWF * 1000e0 / 60000e0 * 4186e0 * (UCWIT - UCWOT_pred)"
    qa = "UCAF * 1.2e0 / 3600e0 * 1005e0 * (UCAOT_pred - UCAIT)"

    def relu(x: str) -> str:
        return f"(CASE WHEN ({x}) > 0 THEN ({x}) WHEN ({x}) IS NOT NULL THEN 0e0 END)"

    def outside(c: str) -> str:
        return f"({relu(f'(-10e0 - {c}) / 10e0')} + {relu(f'({c} - 80e0) / 10e0')})"

    phys = PRED + f""",
p1 AS (SELECT *, {qw} AS qw, {qa} AS qa FROM pred),
p2 AS (SELECT split, UCAOT, UCWOT, UCAF, UCAOT_pred, UCWOT_pred, UCAF_pred,
  pow(abs(qw / 1e4 - qa / 1e4) / ((abs(qw / 1e4) + abs(qa / 1e4)) / 2e0 + 1e-6), 2) AS energy,
  pow({relu('0.3e0 - abs(qa) / (abs(qw) + 1e-6)')}, 2) + pow({relu('abs(qa) / (abs(qw) + 1e-6) - 0.95e0')}, 2) AS efficiency,
  pow({relu('-(UCWIT - UCWOT_pred) / 10e0')}, 2) + 0.5e0 * pow({relu('(UCAOT_pred - UCWIT) / 10e0')}, 2) + 0.3e0 * pow({relu('-(UCAOT_pred - UCAIT) / 10e0 - 0.1e0')}, 2) AS monotonicity,
  0.1e0 * pow({outside('UCAOT_pred')}, 2) + 0.1e0 * pow({outside('UCWOT_pred')}, 2) + 0.05e0 * pow({relu('-UCAF_pred / 1000e0')}, 2) AS limits FROM p1)"""
    for kind in ("energy", "efficiency", "monotonicity", "limits"):
        add(f"physics_{kind}_residual", phys, f"SELECT split, {magnitude(f'avg({kind})', 6)} AS {kind} FROM p2 GROUP BY split")
    add("physics_total", phys + """, t AS (SELECT split, avg((pow(UCAOT_pred - UCAOT, 2) + pow(UCWOT_pred - UCWOT, 2) + pow(UCAF_pred - UCAF, 2)) / 3) AS data,
      avg(energy) AS energy, avg(efficiency) AS efficiency, avg(monotonicity) AS monotonicity, avg(limits) AS limits FROM p2 GROUP BY split)""",
        "SELECT split, " + ", ".join(f"{magnitude(c, 4)} AS {c}" for c in ("data", "energy", "efficiency", "monotonicity", "limits")) + ", "
        + magnitude("data + 0.1 * energy + 0.05 * efficiency + 0.03 * monotonicity + 0.01 * limits", 4) + " AS total FROM t")
    rng = "SELECT {g} AS source, '{c}' AS target, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(count({c}) * 1e0 / (SELECT count(*) FROM sensors) * 100, 4) AS retention_pct FROM "
    add("target_ranges", PARTS, union(rng.replace("{g}", "'raw'") + "sensors", TARGETS) + " UNION ALL " + union(rng.replace("{g}", "split") + "parts GROUP BY split", TARGETS))
    other = {"UCAOT": "UCAIT", "UCWOT": "UCWIT", "UCAF": mix["UCAF"]}
    add("prediction_agreement", BOUNDED + ", known AS (SELECT target, y, y - yhat AS e FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS target, {mix[t]} AS y, {other[t]} AS yhat FROM bounded" for t in TARGETS) + ") WHERE y IS NOT NULL AND yhat IS NOT NULL)",
        f"SELECT target, count(*) AS rows, round(max(abs(e)), 4) AS max_diff, round({_R2}, 4) AS r2, CASE WHEN max(abs(e)) < 1e-5 THEN 'PASSED' ELSE 'WARNING' END AS status FROM known GROUP BY target")
    # order
    add("row_index", READINGS, "SELECT sample_id, unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY sample_id) - 1 AS time_index FROM sensors")
    add("row_index_global", READINGS, "SELECT sample_id * 1000003 + sample_id % 7 AS sparse_id, row_number() OVER (ORDER BY sample_id) - 1 AS time_index FROM sensors")
    add("ffill_limit", FILL, f"SELECT {ids}{cols} FROM forward")
    add("bfill_limit", FILL, f"SELECT {ids}{cols} FROM backward")
    add("bfill_only", BOUNDED, "SELECT " + ids + each("first_value({c} IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY sample_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS {c}", SENSORS) + " FROM bounded")
    filled = each("round(coalesce(x.{c}, m.{c}), 6) AS {c}", DENSE)
    add("impute_forward_fill", FILL, f"SELECT {ids}{filled} FROM backward x, means m")
    add("impute_mean", BOUNDED, f"SELECT sample_id, {filled} FROM bounded x, (SELECT {each('avg({c}) AS {c}', DENSE)} FROM bounded) m")
    add("impute_median", BOUNDED, f"SELECT sample_id, {filled} FROM bounded x, (SELECT {each('round(quantile_cont({c}, 0.5), 9) AS {c}', DENSE)} FROM bounded) m")
    near = each("last_value({c} IGNORE NULLS) OVER up AS {c}_pv, last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER up AS {c}_pp, "
                "first_value({c} IGNORE NULLS) OVER down AS {c}_nv, first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER down AS {c}_np", DENSE)
    lerp = each("CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_pv IS NOT NULL AND {c}_nv IS NOT NULL AND (pos - {c}_pp <= 10 OR {c}_np - pos <= 10) "
                "THEN {c}_pv + ({c}_nv - {c}_pv) / ({c}_np - {c}_pp) * (pos - {c}_pp) WHEN {c}_nv IS NULL AND pos - {c}_pp <= 10 THEN {c}_pv "
                "WHEN {c}_pv IS NULL AND {c}_np - pos <= 10 THEN {c}_nv END AS {c}", DENSE)
    add("impute_interpolate", BOUNDED + f""", p AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY sample_id) AS pos FROM bounded),
      near AS (SELECT *, {near} FROM p WINDOW up AS (PARTITION BY unit_id ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        down AS (PARTITION BY unit_id ORDER BY sample_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      lerp AS (SELECT sample_id, unit_id, {lerp} FROM near), means AS (SELECT {each('avg({c}) AS {c}', DENSE)} FROM lerp)""", f"SELECT {ids}{filled} FROM lerp x, means m")
    add("temporal_split", PARTS, "SELECT sample_id, split FROM parts")
    add("random_split_seeded", "n AS (SELECT count(*) AS n FROM events)", """SELECT 'random' AS kind, 'train' AS split, CAST(floor(n * 0.7e0) AS BIGINT) AS rows FROM n
      UNION ALL SELECT 'random', 'val', CAST(floor(n * 0.85e0) - floor(n * 0.7e0) AS BIGINT) FROM n UNION ALL SELECT 'random', 'test', CAST(n - floor(n * 0.85e0) AS BIGINT) FROM n
      UNION ALL SELECT 'holdout', 'test', CAST(ceil(n * 0.3e0) AS BIGINT) FROM n UNION ALL SELECT 'holdout', 'val', CAST(ceil((n - ceil(n * 0.3e0)) * 0.25e0) AS BIGINT) FROM n
      UNION ALL SELECT 'holdout', 'train', CAST(n - ceil(n * 0.3e0) - ceil((n - ceil(n * 0.3e0)) * 0.25e0) AS BIGINT) FROM n""")
    add("time_series_folds", PARTS + ", k AS (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS fold)", """SELECT fold, role, count(*) AS rows, min(sample_id) AS first_id, max(sample_id) AS last_id FROM (
      SELECT fold, sample_id, CASE WHEN pos < total - (6 - fold) * (total // 6) THEN 'train' WHEN pos < total - (5 - fold) * (total // 6) THEN 'test' END AS role FROM parts, k)
      WHERE role IS NOT NULL GROUP BY fold, role""")
    ecdf = union("SELECT '{c}' AS feature, {c} AS x, split = 'val' AS is_ref FROM parts WHERE split IN ('val', 'test')", ["UCFS", "UCWIT", "UCTSP"])
    add("ecdf_difference", PARTS + ",\n" + _drift_from(f"tagged AS (SELECT * FROM ({ecdf}) WHERE x IS NOT NULL)"), "SELECT feature, n_ref, n_cur, round(ks, 6) AS ks FROM ks")
    add("make_sequences", READINGS + """, s AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY sample_id) - 1 AS pos FROM sensors),
      w AS (SELECT unit_id, pos - 10 AS seq_index, sample_id AS label_key, UCAF, list(AMBT) OVER h AS a, list(UCFS) OVER h AS f FROM s
        WINDOW h AS (PARTITION BY unit_id ORDER BY sample_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))""",
        "SELECT unit_id, seq_index, CAST(len(a) AS BIGINT) AS length, label_key, UCAF AS \"y_UCAF\", a[1] AS first_ambt, f[10] AS last_ucfs, round(list_sum(a) + list_sum(f), 4) AS total FROM w WHERE seq_index >= 0")
    add("best_model_per_target", METRICS, "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dataset, target ORDER BY r2 DESC NULLS LAST, model) AS rn FROM metrics) WHERE rn = 1")
    add("cycle_time", INDEXED, f"SELECT sample_id, unit_id, time_index, cycle_hour, round(hour_sin, 6) AS hour_sin, round(hour_cos, 6) AS hour_cos FROM (SELECT sample_id, unit_id, {_TIME} FROM indexed)")
    # sorts
    add("top_features", IMPORTANCE, "SELECT feature, round(mean, 4) AS mean FROM imp_mean ORDER BY imp_mean.mean DESC, feature LIMIT 5")
    add("top_features_per_target", IMPORTANCE, "SELECT target, feature, round(importance, 4) AS importance, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY importance DESC, feature) AS rank FROM imp) WHERE rank <= 3")
    add("sort_results", METRICS, "SELECT * FROM metrics ORDER BY r2 DESC NULLS LAST, model, dataset, target")
    add("head_missing_pattern", READINGS, f"SELECT time_index, {each('{c} IS NULL AS {c}', SENSORS)} FROM (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS time_index FROM sensors) WHERE time_index < 1000")
    for name, n in (("sample_series", 5000), ("sample_validation", 100)):
        add(name, "", f"SELECT least(count(*), {n}) AS rows, least(count(DISTINCT event_id), {n}) AS distinct_rows FROM events")
    # sets
    add("union_history", PARTS, "SELECT split, count(*) AS rows, count(CASE WHEN split <> 'test' THEN UCFS END) AS with_fan, round(avg(UCWIT), 4) AS mean_inlet FROM parts GROUP BY split")
    add("union_importance", IMPORTANCE, "SELECT target, feature, round(importance, 6) AS importance FROM imp")
    add("except_columns", READINGS, " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {'true' if c in TARGETS else 'false'} AS is_target, {'true' if c in C.INPUT_SENSORS else 'false'} AS is_input, count({c}) AS known FROM sensors" for c in SENSORS))
    add("time_span", "", "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, date_diff('day', min(ts), max(ts)) AS days FROM events")
    # features
    add("features_full", FULL, f"SELECT sample_id, {r6([f for g in FULL_GROUPS.values() for f in g])} FROM f5")
    for g, fs in FULL_GROUPS.items():
        add(f"feat_{g}", FULL, f"SELECT sample_id, {r6(fs)} FROM f5")
    timed = f", h AS (SELECT * EXCLUDE (time_index), {_TIME} FROM g3)"
    add("features_no_leakage", INDEXED + ", " + free("indexed") + timed, f"SELECT sample_id, {r6(LEAK_FREE)} FROM h")
    add("features_serving", INDEXED + ", " + free("indexed", _PUMP_SERVING) + timed, f"SELECT sample_id, {r6(LEAK_FREE).replace('time_index', 'time_index + 1 AS time_index')} FROM h")
    add("train_serve_skew", READINGS, f"SELECT count(*) AS rows, count(*) FILTER (({_PUMP}) IS DISTINCT FROM (CASE WHEN UCWDP = 0 THEN (UCWF + 1e0) * 0.01e0 ELSE {_PUMP} END)) AS pump_differs, count(*) AS index_differs FROM sensors")
    add("thermal_power_api", BOUNDED, f"SELECT sample_id, {qth} AS \"Q_thermal\" FROM bounded")
    add("eda_thermal", BOUNDED + """, t AS (SELECT sample_id, UCWIT - UCWOT AS dw, UCAOT - UCAIT AS da, UCWF * 4186e0 * (UCWIT - UCWOT) / 1000e0 AS w, UCAF * 1005e0 * (UCAOT - UCAIT) / 1000e0 AS a FROM bounded)""",
        "SELECT sample_id, dw AS \"delta_T_water\", da AS \"delta_T_air\", w AS \"Q_water_calc\", a AS \"Q_air_calc\", CASE WHEN w + 1e-6 <> 0 THEN a / (w + 1e-6) END AS efficiency FROM t")
    par = each("avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) = 0 THEN 1e0 ELSE stddev_pop({c}) END AS {c}_s", DENSE)
    add("scale_inverse_roundtrip", PARTS + f", par AS (SELECT {par} FROM parts WHERE split = 'train')",
        f"SELECT sample_id, {each('round(({c} - {c}_m) / {c}_s, 6) AS {c}_scaled', DENSE)}, {each('round({c}, 6) AS {c}_back', DENSE)} FROM parts, par")
    add("outlet_deltas", BOUNDED, f"SELECT sample_id, ({mix['UCAOT']}) - UCAIT AS air_delta, ({mix['UCWOT']}) - UCWIT AS water_delta FROM bounded")
    # streams
    add("stream_parse", MESSAGES, "SELECT topic, CASE WHEN broken THEN 'dead' ELSE 'good' END AS branch, count(*) AS rows FROM topics GROUP BY 1, 2")
    add("topic_route", MESSAGES, """SELECT topic, pattern, handler, count(*) AS rows FROM topics JOIN (VALUES ('hvac/sensors/#', 'sensor', '^hvac/sensors(/.*)?$'), ('hvac/alerts/+', 'alert', '^hvac/alerts/[^/]+$'),
      ('hvac/status', 'status', '^hvac/status$'), ('hvac/#', 'audit', '^hvac(/.*)?$')) r(pattern, handler, re) ON regexp_matches(topic, re) GROUP BY 1, 2, 3""")
    add("topic_route_trie", "", """SELECT 'plant/+/' || c_custkey || '/#' AS pattern, 'customer' AS handler, count(*) AS rows FROM events JOIN customer ON user_id = c_custkey WHERE event_type <> '' GROUP BY 1, 2
      UNION ALL SELECT 'plant/view/+/' || n_nationkey, 'nation', count(*) FROM events JOIN nation ON event_id % 25 = n_nationkey WHERE event_type = 'view' AND user_id IS NOT NULL GROUP BY 1, 2
      UNION ALL SELECT 'plant/#', 'audit', count(*) FROM events""")
    add("late_rows", "", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE event_id % 100 = 0
      AND ts < (SELECT max(ts) FROM events WHERE event_id % 100 <> 0) - INTERVAL 1 DAY""")
    q["stream_row_counter"] = q["row_index"]
    window_text = "strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start"
    add("drift_by_window", DRIFT_CTE + _WINDOWED, f"SELECT {window_text}, feature, n_cur, round(psi, 4) AS psi FROM wpsi")
    add("stream_drift_by_window", DRIFT_CTE + _WINDOWED, f"SELECT {window_text}, feature, n_cur, round(psi, 4) AS psi FROM wpsi "
        "WHERE w + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE")
    add("alerts_from_drift", DRIFT_CTE, """SELECT feature, 'hvac/alerts/' || lower(status) AS topic, '{"timestamp":"2024-01-31T00:00:00.000000","type":"drift","message":"Feature drift in ' || feature || '","severity":"' || status || '"}' AS payload
      FROM drift WHERE status <> 'STABLE'""")
    q["retained_latest"] = q["stream_retained_latest"] = _latest()
    # rules
    add("kpi_levels", DRIFT_CTE + """, k AS (SELECT 'api_response_ms' AS metric, round(quantile_cont(value, 0.5), 9) AS value, 50e0 AS t, 100e0 AS w, 500e0 AS c FROM events
      UNION ALL SELECT 'inference_p95_ms', round(quantile_cont(value, 0.95), 9), 0.1, 1, 10 FROM events UNION ALL SELECT 'drift_psi', max(psi), 0.1, 0.1, 0.2 FROM psi)""",
        "SELECT metric, round(value, 4) AS value, CASE WHEN value > c THEN 'CRITICAL' WHEN value > w THEN 'WARNING' WHEN value > t THEN 'WATCH' ELSE 'OK' END AS level FROM k")
    add("operating_alerts", READINGS, "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT sample_id, '{n}' AS sensor, {n} AS value, CASE WHEN {n} > {hi} THEN 'high' WHEN {n} < {lo} THEN 'low' END AS side FROM sensors" for n, lo, hi in C.OPERATING_RULES) + ") WHERE side IS NOT NULL")
    add("retrain_triggers", METRICS + ",\n" + drift_ctes(DRIFT) + """, t AS (SELECT max(psi) AS max_psi, count(*) FILTER (status = 'WARNING') AS warnings, count(*) FILTER (status = 'CRITICAL') AS criticals FROM drift),
      u AS (SELECT min(r2) AS min_r2 FROM metrics WHERE model = 'mixing'), v AS (SELECT count(*) AS samples, date_diff('day', min(ts), max(ts)) AS age_days FROM events)""",
        """SELECT max_psi, warnings, criticals, min_r2, samples, age_days, max_psi > 0.5 AS psi_trigger, min_r2 < 0.98 AS r2_trigger, age_days > 180 AS age_trigger, samples >= 10000 AS enough_samples,
      max_psi > 0.2 OR warnings > 1 OR criticals > 0 AS weekly_action, (max_psi > 0.5 OR min_r2 < 0.98 OR age_days > 180) AND samples >= 10000 AS retrain FROM t, u, v""")
    add("model_acceptance", METRICS, f"""SELECT *, CASE WHEN candidate_r2 >= baseline_r2 AND candidate_mape <= baseline_mape THEN 'accept' WHEN r2_gain_pct < -5 OR mape_gain_pct < -5 THEN 'reject' ELSE 'review' END AS decision FROM ({comparison})""")
    add("retention_filter", "", """SELECT event_id, event_type FROM events, (SELECT max(ts) AS newest FROM events) WHERE CASE event_type WHEN 'view' THEN ts >= newest - INTERVAL 7 DAY
      WHEN 'click' THEN ts >= newest - INTERVAL 14 DAY WHEN 'error' THEN ts >= newest - INTERVAL 21 DAY ELSE true END""")
    add("psi_band", PARTS + ",\n" + drift_ctes(DENSE), """SELECT feature, p AS psi, CASE WHEN p > 0.2 THEN 'significant' WHEN p >= 0.1 THEN 'slight' ELSE 'none' END AS band,
      CASE WHEN p > 0.5 THEN 'critical' WHEN p > 0.2 THEN 'warning' ELSE 'ok' END AS documented FROM (SELECT feature, round(psi, 4) AS p FROM psi)""")
    # models with a closed form
    add("cv_temporal_frozen", PRED + f""", tr AS (SELECT *, count(*) OVER () AS m FROM pred WHERE split = 'train'),
      f AS (SELECT *, CAST(1 + (pos - (m - 5 * (m // 6))) // (m // 6) AS BIGINT) AS fold FROM tr WHERE pos >= m - 5 * (m // 6)),
      fp AS ({' UNION ALL '.join(f"SELECT fold, '{t}' AS target, {t} AS y, {t} - {t}_pred AS e FROM f WHERE {t} - {t}_pred IS NOT NULL" for t in TARGETS)})""", scores("fold, target", "fp"))
    add("score_pandas_udf", PARTS + """, fit AS (SELECT regr_intercept(UCAOT, UCAIT) AS a, regr_slope(UCAOT, UCAIT) AS b FROM parts WHERE split = 'train'),
      known AS (SELECT split, 'UCAOT' AS target, UCAOT AS y, UCAOT - (a + b * UCAIT) AS e FROM parts, fit WHERE UCAOT IS NOT NULL AND UCAIT IS NOT NULL)""", scores("split, target"))
    add("flagship", BOUNDED + ", " + free("bounded"), "SELECT unit_id, count(*) AS rows, round(avg(Q_max_water), 4) AS mean_q_max, round(avg(P_total_estimate), 4) AS mean_power FROM g3 GROUP BY unit_id")
    return q
