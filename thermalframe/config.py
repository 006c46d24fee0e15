"""Names, limits and rule tables.

Everything here is a fixed value: results depend on these exact names and
numbers, so they are stated plainly and used by reference everywhere else.
"""

from __future__ import annotations

# --- fixed values: column roles -------------------------------------------
INPUT_SENSORS = (
    "AMBT", "UCTSP", "CPSP", "UCAIT", "CPPR", "UCWF", "CPMC", "MVDP", "CPCF", "UCFS",
    "MVCV", "UCHV", "CPMV", "UCHC", "UCWIT", "UCFMS", "CPDP", "UCWDP", "MVWF", "UCOM",
)
TARGETS = ("UCAOT", "UCWOT", "UCAF")
KEY_TARGETS = ("UCAOT", "UCWOT", "UCAF", "Q_thermal")
KEY_INPUTS = ("UCWIT", "UCAIT", "UCWF", "UCAF", "UCAIH", "AMBT", "AMBH")
PHYSICS_INPUTS = ("mdot_water", "mdot_air", "UCWIT", "UCAIT")
SERVING_DEFAULTS = {"AMBT": 20.0, "UCTSP": 21.0, "UCAIT": 20.0, "UCWIT": 20.0}

# --- fixed values: cleaning -----------------------------------------------
SENTINELS = (65535.0, 65534.0, 0.0, -999.0, -9999.0)
FLOW_SATURATION = 65534.0
TEMPERATURE_LIMITS = (-10.0, 150.0)
FLOW_LIMITS = (0.0, 20000.0)
HUMIDITY_LIMITS = (0.0, 100.0)
MAX_NULL_SHARE = 0.70
MAX_FEATURE_NULL_PCT = 50.0
FILL_LIMIT = 5
INTERPOLATE_LIMIT = 10
OUTLIER_IQR_FACTOR = 3.0
PROFILE_IQR_FACTOR = 1.5
MAX_DELTA_T = 50.0

# --- fixed values: physics -------------------------------------------------
CP_WATER = 4186.0
CP_AIR = 1005.0
RHO_WATER = 1000.0
RHO_AIR = 1.2
LITRES_PER_M3 = 1000.0
SECONDS_PER_MINUTE = 60.0
SECONDS_PER_HOUR = 3600.0
W_TO_KW = 0.001
EPS = 1e-9
MINUTES_PER_DAY = 1440
Q_CHARACTERISTIC = 10000.0
T_CHARACTERISTIC = 10.0
RESIDUAL_EPS = 1e-6
EFFICIENCY_RANGE = (0.3, 0.95)
PREDICTED_TEMPERATURE_RANGE = (-10.0, 80.0)
RESIDUAL_WEIGHTS = {"energy": 0.1, "efficiency": 0.05, "monotonicity": 0.03, "limits": 0.01}

# --- fixed values: splitting and evaluation --------------------------------
SPLIT_RATIOS = (0.70, 0.15, 0.15)
MIN_REGIME_ROWS = 10
BASELINE_MAPE = 125.5
SETPOINT_BANDS = (
    ("Low Temp (21-24°C)", 0.0, 24.0),
    ("Mid Temp (24-27°C)", 24.0, 27.0),
    ("High Temp (27-31°C)", 27.0, 35.0),
)

# --- fixed values: drift ----------------------------------------------------
DRIFT_FEATURES = ("UCWIT", "UCAIT", "UCWF", "AMBT", "UCTSP")
PSI_THRESHOLD = 0.2
KS_THRESHOLD = 0.05
PERFORMANCE_THRESHOLD = 0.1
R2_DRIFT_THRESHOLD = 0.05
EMPTY_SHARE = 0.0001

# --- fixed values: point map (name, object type, instance) -------------------
POINT_MAP = (
    ("UCWIT", "analogInput", 0), ("UCAIT", "analogInput", 1), ("UCWF", "analogInput", 2),
    ("UCAIH", "analogInput", 3), ("AMBT", "analogInput", 4), ("UCTSP", "analogInput", 5),
    ("UCAOT", "analogValue", 0), ("UCWOT", "analogValue", 1), ("UCAF", "analogValue", 2),
    ("Q_thermal", "analogValue", 3),
)

# --- fixed values: feature groups --------------------------------------------
FEATURE_GROUPS = {
    "Temperature Deltas": ("delta_T_water", "delta_T_air", "T_approach", "T_water_avg", "T_air_avg"),
    "Thermal Power": ("Q_water", "Q_air", "Q_avg", "Q_imbalance", "Q_imbalance_pct"),
    "Efficiency": ("efficiency_HX", "effectiveness", "NTU", "COP_estimate"),
    "Flow Derived": ("mdot_water", "mdot_air", "flow_ratio"),
    "Dimensionless": ("C_ratio", "Re_air_estimate", "delta_T_ratio"),
    "Power": ("P_fan_estimate", "P_pump_estimate", "P_total_estimate"),
    "Temporal": ("time_index", "cycle_hour", "hour_sin", "hour_cos"),
    "Interactions": ("T_water_x_flow", "T_air_x_flow", "ambient_x_inlet"),
    "Raw Sensors": ("UCWIT", "UCWOT", "UCAIT", "UCWF", "AMBT", "UCTSP"),
}
# Name-pattern groups: a feature belongs to every group one of whose marks it contains.
FEATURE_GROUP_MARKS = {
    "temperature_deltas": ("delta_T", "T_approach"),
    "thermal_power": ("Q_",),
    "efficiency": ("efficiency", "effectiveness", "COP"),
    "flow_derived": ("mdot", "flow_ratio"),
    "dimensionless": ("NTU", "C_ratio", "Re_"),
    "power": ("P_",),
    "temporal": ("time", "cycle", "hour"),
    "interactions": ("_x_",),
}

# --- fixed values: rule tables -----------------------------------------------
# metric, target, warning, critical; "below" rules are met when the value is small.
KPI_RULES = (
    ("api_response_ms", "below", 50.0, 100.0, 500.0),
    ("inference_p95_ms", "below", 0.1, 1.0, 10.0),
    ("memory_mb", "below", 500.0, 1000.0, 1500.0),
    ("cpu_pct", "below", 50.0, 75.0, 90.0),
    ("disk_free_pct", "above", 20.0, 15.0, 10.0),
    ("drift_psi", "below", 0.1, 0.1, 0.2),
)
OPERATING_RULES = (("UCAOT", 15.0, 25.0), ("UCWOT", 8.0, 15.0), ("UCAF", 3000.0, 7000.0))
RANGE_RULES = (
    ("UCWIT", -50.0, 200.0), ("UCAIT", -50.0, 200.0), ("UCWF", 0.0, 10.0),
    ("UCFS", 0.0, 3000.0), ("AMBT", -50.0, 200.0),
)
RETRAIN_PSI = 0.5
RETRAIN_R2 = 0.98
RETRAIN_MIN_SAMPLES = 10000
RETRAIN_MAX_AGE_DAYS = 180
ACCEPT_MAX_LATENCY_MS = 100.0
REJECT_DEGRADATION_PCT = 5.0
RETENTION_DAYS = {"log": 30, "drift_report": 90, "data": 30}
MIN_INPUT_SHARE = 0.80

# --- fixed values: topics ------------------------------------------------------
SENSOR_TOPIC = "hvac/sensors/data"
PREDICTION_TOPIC = "hvac/predictions/results"
ALERT_TOPIC_PREFIX = "hvac/alerts/"
STATUS_TOPIC = "hvac/status"
