"""Registered queries: every operator over the sensor view of the event table.

Each takes (spark, sf_dir) and reads whole tables. Results are rounded where
the last bits of a double depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermalframe import config as C
from thermalframe.functions import cleaning, features, physics
from thermalframe.functions.scalars import to_long
from thermalframe.operators import (blocks, clean, drift, importance, messages, metrics, models, profile,
                                    quantiles, rules, scale, sketches, split, topics)
from thermalframe.plans import pipeline
from thermalframe.session import cut_lineage, work_path
from thermalframe.sources import io, message_log
from thermalframe.sources.tables import ORDER, SENSORS, UNIT, events, sensor_view, sensors
from thermalframe.streaming import jobs

S = list(SENSORS)
TARGETS = list(C.TARGETS)
FEATURES = [c for c in S if c not in TARGETS]
DENSE = [c for c in S if c != "UCAIH"]                       # what is left after the sparse column is dropped
DRIFT = list(C.DRIFT_FEATURES)
MODEL_INPUTS = ["UCWIT", "UCAIT", "UCWF", "AMBT", "UCTSP", "UCFS", "UCWDP"]
ROUTES = [("hvac/sensors/#", "sensor"), ("hvac/alerts/+", "alert"), ("hvac/status", "status"), ("hvac/#", "audit")]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f
    return add


# --- shared inputs ---------------------------------------------------------

def rounded(df: DataFrame, digits: int = 4, only: Sequence[str] | None = None) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    names = [n for n in names if only is None or n in only]
    return df.withColumns({n: F.round(n, digits) for n in names}) if names else df


# Plain arithmetic is the same in every engine; powers, logarithms and sines may differ in the last bit.
TRANSCENDENTAL = ["hour_sin", "hour_cos", "NTU", "Re_air_estimate", "P_fan_estimate", "P_total_estimate", "COP_estimate"]


def settled(df: DataFrame) -> DataFrame:
    return rounded(df, 6, TRANSCENDENTAL)


def magnitude(df: DataFrame, digits: int) -> DataFrame:
    """Round huge means before the decimal point: their last digits depend on the order of summation."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({n: F.when(F.abs(n) > 1e9, F.round(n, -6)).otherwise(F.round(n, digits)) for n in names})


def readings(spark, d) -> DataFrame:
    return sensors(spark, d).select(ORDER, UNIT, *S)


def bounded(spark, d) -> DataFrame:
    return cleaning.bound(readings(spark, d), S)


def order_keys(spark, d) -> DataFrame:
    return events(spark, d).select(F.col("event_id").alias(ORDER))


def parts(spark, d, *only: str) -> DataFrame:
    """Bounded readings with their split label, of all or of the named parts."""
    _, cuts = split.temporal_cuts(order_keys(spark, d), ORDER)
    return split.select_parts(bounded(spark, d), ORDER, cuts, only or split.NAMES)


def filled(spark, d) -> DataFrame:
    return clean.fill_both_ways(bounded(spark, d).drop("UCAIH"), ORDER, DENSE, [UNIT])


def _d(x: float) -> Column:
    return F.lit(float(x))


def mixing_model() -> dict[str, Column]:
    air, water = F.col("UCAIT"), F.col("UCWIT")
    return {"UCAOT": air + _d(0.1) * (water - air), "UCWOT": water + _d(0.3) * (air - water),
            "UCAF": _d(372) + _d(0.5) * F.col("UCFS")}


def inlet_model() -> dict[str, Column]:
    return {"UCAOT": F.col("UCAIT"), "UCWOT": F.col("UCWIT"), "UCAF": F.col("UCFS")}


def predictions(spark, d, model=mixing_model) -> DataFrame:
    return parts(spark, d).withColumns({f"{t}_pred": e for t, e in model().items()})


def pairs(spark, d, keep: Sequence[str] = ()) -> DataFrame:
    """(kept, dataset, model, target, y, yhat) for both formula models: one projection."""
    items = [F.struct(F.lit(name).alias("model"), F.lit(t).alias("target"), F.col(t).alias("y"), e.alias("yhat"))
             for name, model in (("mixing", mixing_model), ("inlet", inlet_model)) for t, e in model().items()]
    rows = parts(spark, d)
    return rows.select(*keep, F.col("split").alias("dataset"), F.inline(F.array(*items)))


def model_metrics(spark, d) -> DataFrame:
    return metrics.regression_metrics(pairs(spark, d), ["model", "dataset", "target"])


def tagged(spark, d, names: Sequence[str] = DRIFT) -> DataFrame:
    """(feature, value, is_ref): train rows as reference, validation rows as current; one scan."""
    rows = parts(spark, d, "train", "val")
    rows = rows.withColumn("is_ref", F.col("split") == "train")
    return to_long(rows, names, keep=["is_ref"])


def drift_table(spark, d) -> DataFrame:
    names = spark.createDataFrame([(f,) for f in DRIFT], "feature string")
    long = tagged(spark, d)
    return drift.feature_drift_long(long, names)


def message_rows(e: DataFrame) -> DataFrame:
    """Event rows as broker messages: (event_id, topic, payload, ts), a few of them not JSON."""
    ts = F.col("ts").cast("timestamp")
    r = e.select("event_id", "event_type", "value", "user_id", "props", ts.alias("ts"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("INFO", "WARNING", "ERROR", "CRITICAL")]),
                         (F.col("event_id") % 4 + 1).cast("int"))
    r = r.withColumns({"UCWIT": F.get_json_object("props", "$.k").cast("double"), "UCAIT": F.col("value")})
    kinds = {
        "view": messages.sensor_message(F.col("ts"), ["UCWIT", "UCAIT"]),
        "purchase": messages.prediction_message(F.col("ts"), {"UCAOT": F.col("value")}),
        "error": messages.alert_message(F.col("ts"), F.lit("drift"), F.lit("Feature drift in UCWIT"), level),
        "signup": messages.status_message(F.col("ts"), F.lit("ONLINE"), {"version": F.lit("1.0")}),
    }
    topic, payload = F.lit("hvac/sensors/raw"), F.to_json(F.struct(F.struct("UCAIT").alias("data")))
    for kind, (t, p) in kinds.items():
        topic = F.when(F.col("event_type") == kind, t).otherwise(topic)
        payload = F.when(F.col("event_type") == kind, p).otherwise(payload)
    broken = F.col("event_id") % 50 == 0
    return r.select("event_id", topic.alias("topic"),
                    F.when(broken, F.concat(F.lit("{broken "), F.col("event_id"))).otherwise(payload).alias("payload"),
                    "ts")


def message_table(spark, d) -> DataFrame:
    return message_rows(events(spark, d))


def event_stream(spark, d, **kw) -> DataFrame:
    """The event table as a stream, whether it is one file or a folder of many."""
    return jobs.file_stream(spark, f"{d}/events.parquet", events(spark, d).schema, **kw)


def text_ts(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- scans, sources, sinks ---------------------------------------------------

@query("scan_csv")
def scan_csv(spark, d):
    path = work_path(spark, "csv")
    readings(spark, d).select(ORDER, *S).write.csv(path, sep=";", header=True)
    return io.read_sensor_csv(spark, path, io.sensor_schema(S, ORDER), readings=S)


@query("scan_parquet_sensors")
def scan_parquet_sensors(spark, d):
    return readings(spark, d)


@query("dataset_metadata")
def dataset_metadata(spark, d):
    return io.dataset_metadata(readings(spark, d))


@query("role_presence")
def role_presence(spark, d):
    return io.role_presence(readings(spark, d))


@query("write_dataset")
def write_dataset(spark, d):
    path = work_path(spark, "dataset")
    rows = parts(spark, d)
    params = scale.fit_scaler(rows.where("split = 'train'"), DENSE)
    io.write_dataset(rows, path, params, split.split_manifest(rows, len(FEATURES), len(TARGETS)))
    back = spark.read.parquet(f"{path}/data")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("AMBT"), 4).alias("mean_ambt"))


@query("split_manifest")
def split_manifest(spark, d):
    return split.split_manifest(parts(spark, d), len(FEATURES), len(TARGETS))


@query("write_results")
def write_results(spark, d):
    path = work_path(spark, "results")
    table = model_metrics(spark, d)
    io.write_results(table, path)
    return spark.read.csv(path, schema=table.schema, header=True)


@query("drift_report_json")
def drift_report_json(spark, d):
    long = pairs(spark, d).where("model = 'mixing'")
    reference = metrics.regression_metrics(long.where("dataset = 'train'"), ["target"], 9)
    doc = drift.report_json(drift_table(spark, d), drift.prediction_drift(long.where("dataset = 'val'"), reference))
    entry = "struct<status:string,psi:double,ks_statistic:double,reference_mean:double,current_mean:double>"
    parsed = doc.select(F.from_json("report", "summary struct<overall_status:string,drift_percentage:double>, "
                                              f"feature_drift map<string,{entry}>").alias("r"))
    return parsed.select(F.col("r.summary.overall_status").alias("overall_status"),
                         F.col("r.summary.drift_percentage").alias("drift_percentage"),
                         F.explode("r.feature_drift").alias("feature", "v")).select(
        "overall_status", "drift_percentage", "feature", "v.status", "v.psi", "v.ks_statistic",
        "v.reference_mean", "v.current_mean")


@query("load_reference_table")
def load_reference_table(spark, d):
    path = work_path(spark, "reference")
    parts(spark, d, "train").select(ORDER, *DRIFT).write.csv(path, header=True)
    return io.read_reference_csv(spark, path, io.sensor_schema(DRIFT, ORDER))


@query("stream_sensor_messages")
def stream_sensor_messages(spark, d):
    base = work_path(spark, "sensor-messages")
    stream = message_rows(event_stream(spark, d))
    jobs.drain(stream, f"{base}/checkpoint", jobs.parse_to(f"{base}/out"))
    good = spark.read.parquet(f"{base}/out").where((F.col("branch") == "good") & (F.col("topic") == C.SENSOR_TOPIC))
    return good.select("event_id", "topic", F.col("data")["UCWIT"].alias("UCWIT"), F.col("data")["UCAIT"].alias("UCAIT"))


@query("publish_messages")
def publish_messages(spark, d):
    return message_table(spark, d).select(
        "event_id", "topic", F.get_json_object("payload", "$.timestamp").alias("sent"),
        F.get_json_object("payload", "$.data.UCWIT").cast("double").alias("UCWIT"),
        F.get_json_object("payload", "$.data.UCAIT").cast("double").alias("UCAIT"),
        F.get_json_object("payload", "$.prediction.UCAOT").cast("double").alias("UCAOT"),
        F.get_json_object("payload", "$.severity").alias("severity"),
        F.get_json_object("payload", "$.status").alias("status"))


LOGGED = "event_id long, topic string, payload string, ts timestamp"


@query("message_log_batch")
def message_log_batch(spark, d):
    """All messages, published as two segments of a log, read back with the reason why some are dead."""
    path, table = work_path(spark, "message-log"), message_table(spark, d)
    message_log.publish(table.where("event_id % 2 = 0"), path, 0)
    message_log.publish(table.where("event_id % 2 = 1"), path, 1)
    return message_log.messages(message_log.read_log(spark, path), LOGGED).select("event_id", "topic", "segment", "reason")


@query("message_log_stream")
def message_log_stream(spark, d):
    """The event stream published batch by batch to a log; a second stream follows the log and parses what is good."""
    base = work_path(spark, "message-log-stream")
    jobs.drain(message_rows(event_stream(spark, d)), f"{base}/published", message_log.publish_to(f"{base}/log"))
    follow = message_log.messages(message_log.read_log(spark, f"{base}/log", stream=True), LOGGED)
    jobs.drain(follow, f"{base}/followed", jobs.to_folder(f"{base}/out"))
    good = messages.parse_messages(spark.read.parquet(f"{base}/out").where("reason IS NULL"))
    return good.where(F.col("topic") == C.SENSOR_TOPIC).select(
        "event_id", "topic", F.col("data")["UCWIT"].alias("UCWIT"), F.col("data")["UCAIT"].alias("UCAIT"))


def point_readings(spark, d) -> DataFrame:
    """Tall readings of the mapped points, as a field bus would deliver them."""
    items = [F.struct(F.lit(t).alias("object_type"), F.lit(i).alias("instance"), F.col(n).alias("value"))
             for n, t, i in C.POINT_MAP if n in S]
    return readings(spark, d).select(ORDER, F.inline(F.array(*items))).where("value is not null")


@query("points_read")
def points_read(spark, d):
    return messages.points_read(point_readings(spark, d), messages.point_map(spark), ORDER)


@query("points_write")
def points_write(spark, d):
    q = features.served_thermal_power(F.col("UCWF"), F.col("UCWIT"), mixing_model()["UCWOT"])
    pred = bounded(spark, d).select(ORDER, "AMBT", q.alias("Q_thermal"), *[e.alias(t) for t, e in mixing_model().items()])
    return messages.points_write(pred, messages.point_map(spark), ORDER, [*TARGETS, "Q_thermal", "AMBT"])


# --- projections, filters, predicates -----------------------------------------

@query("project_xy")
def project_xy(spark, d):
    df = bounded(spark, d)
    return df.select(ORDER, *[c for c in S if c not in TARGETS], *[F.col(t).alias(f"y_{t}") for t in TARGETS if t in S])


@query("classify_columns")
def classify_columns(spark, d):
    df = readings(spark, d)
    items = [F.struct(F.lit(c).alias("column"), F.lit(cleaning.column_class(c)).alias("kind"),
                      F.lit(cleaning.may_not_be_negative(c)).alias("non_negative"), F.col(c).alias("known")) for c in S]
    return df.agg(*[F.count(c).alias(c) for c in S]).select(F.inline(F.array(*items)))


@query("sentinel_to_null")
def sentinel_to_null(spark, d):
    return cleaning.sentinel_to_null(readings(spark, d), S)


@query("fix_negative_flows")
def fix_negative_flows(spark, d):
    return cleaning.fix_negative_flows(readings(spark, d), S)


@query("clip_physical")
def clip_physical(spark, d):
    return cleaning.clip_physical(readings(spark, d), S)


@query("clip_counts")
def clip_counts(spark, d):
    return cleaning.clip_counts(readings(spark, d), S)


@query("drop_sparse_columns")
def drop_sparse_columns(spark, d):
    return clean.drop_sparse_columns(bounded(spark, d), S)[0]


@query("drop_sparse_features_50")
def drop_sparse_features_50(spark, d):
    df = clean.drop_rows_without_target(bounded(spark, d), TARGETS)
    return clean.drop_sparse_columns(df, FEATURES, C.MAX_FEATURE_NULL_PCT / 100)[0]


@query("drop_null_rows")
def drop_null_rows(spark, d):
    return clean.drop_null_rows(bounded(spark, d).drop("UCAIH"), DENSE)


@query("drop_rows_all_targets_null")
def drop_rows_all_targets_null(spark, d):
    return clean.drop_rows_without_target(bounded(spark, d), TARGETS).select(ORDER, *TARGETS)


@query("physics_flags")
def physics_flags(spark, d):
    return cleaning.physics_flags(readings(spark, d)).groupBy("water_delta_T", "air_delta_T").agg(
        F.count(F.lit(1)).alias("rows"))


@query("default_inputs")
def default_inputs(spark, d):
    return cleaning.default_inputs(readings(spark, d).select(ORDER, *FEATURES))


@query("validate_ranges")
def validate_ranges(spark, d):
    return cleaning.validate_ranges(readings(spark, d)).select(
        ORDER, "valid", F.array_join("failed", ",").alias("failed"))


@query("leakage_check")
def leakage_check(spark, d):
    df = features.leak_free(bounded(spark, d))
    names = [c for c in df.columns if c not in (ORDER, UNIT)]
    row = rules.input_availability(df, FEATURES).groupBy("usable").agg(F.count(F.lit(1)).alias("rows"))
    clean_names = [c for c in names if c not in TARGETS]
    return row.withColumns({
        "leaking_in_frame": F.lit(",".join(rules.leaking_columns(names))),
        "leaking_in_features": F.lit(",".join(rules.leaking_columns(clean_names))),
        "missing_physics": F.lit(",".join(rules.missing_physics_inputs(clean_names)))})


@query("filter_results")
def filter_results(spark, d):
    return model_metrics(spark, d).where("dataset = 'test' and model = 'mixing' and target = 'UCAOT'")


# --- joins ----------------------------------------------------------------------

@query("join_pred_actual")
def join_pred_actual(spark, d):
    actual = bounded(spark, d).select(ORDER, *TARGETS)
    predicted = bounded(spark, d).select(ORDER, *[e.alias(t) for t, e in mixing_model().items()])
    return metrics.pair_up(actual, predicted, ORDER)


@query("join_model_comparison")
def join_model_comparison(spark, d):
    return rounded(metrics.compare_models(model_metrics(spark, d), "mixing", "inlet"))


def importance_by_target(spark, d) -> DataFrame:
    return importance.correlation_importance(bounded(spark, d), MODEL_INPUTS, TARGETS)


@query("join_importance_models")
def join_importance_models(spark, d):
    by_target = cut_lineage(importance_by_target(spark, d))      # a few lines, scanned once for all targets
    tables = {t: importance.importance_mean(by_target.where(F.col("target") == t)) for t in TARGETS}
    return rounded(importance.align_models(tables))


@query("join_reference_current")
def join_reference_current(spark, d):
    # UCAIH is monitored but emptied in the current part: it must be reported as ERROR.
    rows = parts(spark, d)
    ref, cur = rows.where("split = 'train'"), rows.where("split = 'val'").withColumn("UCAIH", F.lit(None).cast("double"))
    table = drift.feature_drift(ref, cur.drop("UCFS"), [*DRIFT, "UCAIH", "UCFS", "NOT_THERE"])
    return table.select("feature", "status", "current_mean", "reference_mean")


@query("join_point_map")
def join_point_map(spark, d):
    joined = point_readings(spark, d).join(F.broadcast(messages.point_map(spark)), ["object_type", "instance"])
    return joined.groupBy("name", "object_type", "instance").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("value"), 4).alias("mean"))


def with_regime(spark, d) -> DataFrame:
    return parts(spark, d).withColumn("regime", metrics.condition_band(F.col("UCTSP")))


@query("join_regime_scaler")
def join_regime_scaler(spark, d):
    rows = with_regime(spark, d)
    params = scale.fit_regime_scaler(rows.where("split = 'train'"), ["UCWIT", "AMBT"], "regime")
    out = scale.apply_regime_scaler(rows.select(ORDER, "regime", "UCWIT", "AMBT"), params, ["UCWIT", "AMBT"], "regime")
    return rounded(out, 6)


@query("join_bins")
def join_bins(spark, d):
    long = tagged(spark, d)
    edges = drift.small(drift.bin_edges(long.where("is_ref")))
    placed = long.where("value is not null").join(edges, "feature").withColumn("bin", drift.bin_of(F.col("value"), F.col("edges")))
    return placed.groupBy("feature", "is_ref", F.col("bin").cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


@query("semi_features")
def semi_features(spark, d):
    imp = importance_by_target(spark, d)
    wanted = importance.group_table(spark, C.FEATURE_GROUPS).select("feature").distinct()
    have = importance.present_features(imp, wanted).withColumn("present", F.lit(True))
    return have.unionByName(importance.absent_features(imp, wanted).withColumn("present", F.lit(False)))


# --- aggregations -----------------------------------------------------------------

@query("describe_stats")
def describe_stats(spark, d):
    return rounded(profile.describe(readings(spark, d), S))


@query("summary_extended")
def summary_extended(spark, d):
    return rounded(profile.summary_extended(readings(spark, d), S))


@query("basic_info")
def basic_info(spark, d):
    return profile.basic_info(readings(spark, d), S)


@query("quality_report")
def quality_report(spark, d):
    return profile.quality_report(readings(spark, d), S)


@query("duplicate_rows")
def duplicate_rows(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    return profile.duplicate_rows(line, line.columns)


@query("duplicate_rows_by_digest")
def duplicate_rows_by_digest(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    return profile.duplicate_rows_by_digest(lines, lines.columns)


@query("profile_from_daily_states")
def profile_from_daily_states(spark, d):
    """Profile merged from states of single days, and whether its estimates are within their bounds."""
    path = work_path(spark, "daily-states")
    rows = sensors(spark, d).withColumn("day", F.to_date("ts")).select("day", *S)
    sketches.keep(rows, S, "day", path)
    found = cut_lineage(sketches.profile_of(sketches.merged(spark.read.parquet(path))))
    long = to_long(rows, S, name="column").where("value is not null").join(drift.small(found.select("column", "q50")), "column")
    exact = long.groupBy("column").agg(F.count_distinct("value").alias("d"), F.avg((F.col("value") < F.col("q50")).cast("int")).alias("below"),
                                       F.avg((F.col("value") <= F.col("q50")).cast("int")).alias("up_to"))
    both = found.join(exact, "column", "left")
    near = F.abs(F.col("distinct_estimate") - F.col("d")) <= 0.07 * F.col("d")
    return rounded(both.select("column", "rows", "missing", "minimum", "maximum", "mean", near.alias("distinct_within_7_pct"),
                               ((F.col("below") <= 0.53) & (F.col("up_to") >= 0.47)).alias("median_within_3_pct")))


@query("constant_columns")
def constant_columns(spark, d):
    return profile.constant_columns(readings(spark, d).withColumn("FIXED", F.lit(7.0)), [*S, "FIXED"])


@query("quality_issues")
def quality_issues(spark, d):
    df = readings(spark, d).withColumn("MOSTLY0", F.when(F.col(ORDER) % 3 == 0, 1.0).otherwise(0.0))
    return profile.quality_issues(df, [*S, "MOSTLY0"])


@query("missing_summary")
def missing_summary(spark, d):
    return profile.missing_summary(readings(spark, d), S)


@query("variable_ranges")
def variable_ranges(spark, d):
    return profile.variable_ranges(readings(spark, d), S)


@query("correlation_matrix")
def correlation_matrix(spark, d):
    return rounded(profile.correlation_matrix(bounded(spark, d), S), 6)


@query("high_corr_pairs")
def high_corr_pairs(spark, d):
    return profile.high_corr_pairs(features.static_features(bounded(spark, d)), [*S, "delta_T_air", "mdot_water", "T_approach"])


@query("target_correlations")
def target_correlations(spark, d):
    return rounded(profile.target_correlations(bounded(spark, d), S, TARGETS), 6)


@query("top_target_correlations")
def top_target_correlations(spark, d):
    return rounded(profile.top_target_correlations(bounded(spark, d), S, TARGETS, 3), 6)


@query("outliers_iqr")
def outliers_iqr(spark, d):
    return profile.outliers_iqr(readings(spark, d), S)


@query("outliers_zscore")
def outliers_zscore(spark, d):
    return profile.outliers_zscore(readings(spark, d), S)


@query("boxplot_stats")
def boxplot_stats(spark, d):
    return profile.boxplot_stats(readings(spark, d), S)


@query("histogram_50")
def histogram_50(spark, d):
    return rounded(profile.histogram(readings(spark, d), S))


@query("profile_lineitem")
def profile_lineitem(spark, d):
    return rounded(profile.describe(spark.read.parquet(f"{d}/lineitem.parquet").select(*LINE), LINE))


@query("impute_stats")
def impute_stats(spark, d):
    df = cut_lineage(filled(spark, d))
    row = {"mean": clean.fit_means(df, DENSE), "median": clean.fit_medians(df, DENSE)}
    return rounded(spark.createDataFrame([(c, row["mean"][c], row["median"][c]) for c in DENSE],
                                         "column string, mean double, median double"))


@query("outlier_clip_fit_apply")
def outlier_clip_fit_apply(spark, d):
    df = bounded(spark, d)
    bounds = clean.fit_outlier_bounds(df, DENSE)
    return clean.clip_outliers(df.select(ORDER, *DENSE), bounds)


@query("outlier_clip_fit_train_apply_test")
def outlier_clip_fit_train_apply_test(spark, d):
    """Bounds of the training rows, used on the test rows."""
    bounds = clean.fit_outlier_bounds(parts(spark, d, "train"), DENSE)
    return clean.clip_outliers(parts(spark, d, "test").select(ORDER, *DENSE), bounds)


@query("outlier_clip_counts")
def outlier_clip_counts(spark, d):
    df = bounded(spark, d)
    return rounded(clean.outlier_clip_counts(df, clean.fit_outlier_bounds(df, DENSE)), 6)


def _scaler(method: str):
    def run(spark, d):
        return rounded(scale.fit_scaler(parts(spark, d, "train"), DENSE, method), 6)
    return run


for _m in scale.METHODS:
    QUERIES[f"scaler_{_m}"] = _scaler(_m)


@query("scaler_by_regime")
def scaler_by_regime(spark, d):
    train = with_regime(spark, d).where("split = 'train'")
    return rounded(scale.fit_regime_scaler(train, ["UCWIT", "UCAIT", "AMBT"], "regime", "robust"), 6)


@query("regression_metrics")
def regression_metrics(spark, d):
    return model_metrics(spark, d)


@query("residual_stats")
def residual_stats(spark, d):
    return rounded(metrics.residual_stats(pairs(spark, d), ["model", "target"]))


@query("metrics_by_condition")
def metrics_by_condition(spark, d):
    return metrics.metrics_by_condition(pairs(spark, d, ["UCTSP"]), metrics.condition_band(F.col("UCTSP")),
                                        ["model", "target"])


@query("metrics_by_tercile")
def metrics_by_tercile(spark, d):
    edges = quantiles.column_quantiles(bounded(spark, d), ["AMBT"], (0.0, 1 / 3, 2 / 3, 1.0))["AMBT"]
    return metrics.metrics_by_condition(pairs(spark, d, ["AMBT"]), metrics.tercile_band(F.col("AMBT"), edges),
                                        ["model", "target"])


@query("metrics_eps_mape")
def metrics_eps_mape(spark, d):
    table = metrics.metrics_shifted_mape(pairs(spark, d).where("model = 'mixing'"))
    overall = metrics.verdict(table)
    return rounded(table.withColumns({c: overall.select(c).scalar() for c in ("avg_r2", "verdict")}))


@query("cv_fold_metrics")
def cv_fold_metrics(spark, d):
    folds = split.assign_folds(bounded(spark, d).withColumns({f"{t}_pred": e for t, e in mixing_model().items()}), ORDER)
    scores = metrics.regression_metrics(metrics.pairs_long(folds.where("role = 'test'"), ["fold"]), ["fold", "target"])
    return rounded(metrics.fold_summary(scores))


@query("improvement_vs_baseline")
def improvement_vs_baseline(spark, d):
    return rounded(metrics.improvement_vs_baseline(model_metrics(spark, d).where("dataset = 'test'")))


@query("importance_mean")
def importance_mean(spark, d):
    return rounded(importance.importance_mean(importance_by_target(spark, d)))


@query("importance_groups")
def importance_groups(spark, d):
    df = features.static_features(bounded(spark, d))
    names = sorted({f for fs in C.FEATURE_GROUPS.values() for f in fs} & set(df.columns))
    imp = importance.correlation_importance(df, names, TARGETS)
    return rounded(importance.importance_groups(importance.importance_mean(imp),
                                                importance.group_table(spark, C.FEATURE_GROUPS)))


@query("importance_groups_by_name")
def importance_groups_by_name(spark, d):
    df = features.leak_free(bounded(spark, d))
    names = [f for f in features.LEAK_FREE if f in df.columns]
    imp = importance.correlation_importance(df, names, TARGETS)
    return rounded(importance.importance_groups(importance.importance_mean(imp),
                                                importance.group_table(spark, importance.groups_by_mark(names))))


@query("psi")
def psi(spark, d):
    long = tagged(spark, d)
    return rounded(drift.psi(long))


@query("ks_two_sample")
def ks_two_sample(spark, d):
    long = tagged(spark, d)
    return rounded(drift.ks_two_sample(long))


@query("ks_exact_by_hour")
def ks_exact_by_hour(spark, d):
    """Values of even against odd event numbers in each hour: many small samples, with their exact p-values."""
    long = spark.read.parquet(f"{d}/events.parquet").select(
        F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH").alias("feature"), "value",
        (F.col("event_id") % 2 == 0).alias("is_ref"))
    ks = quantiles.ks_distance(long.where("value is not null"), "feature", "value", F.col("is_ref"))
    return rounded(drift.with_best_p_value(ks).select(F.col("feature").alias("hour"), "n_ref", "n_cur", "ks", "p_value"), 6)


@query("feature_drift")
def feature_drift(spark, d):
    return drift_table(spark, d)


@query("drift_orders_by_priority")
def drift_orders_by_priority(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    long = orders.select(F.col("o_orderpriority").alias("feature"), F.col("o_totalprice").alias("value"),
                         (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).alias("is_ref"))
    both = drift.psi(long).join(drift.ks_two_sample(long), "feature")
    return rounded(both.select("feature", "n_ref", "n_cur", "psi", "ks"))


@query("prediction_drift")
def prediction_drift(spark, d):
    long = pairs(spark, d).where("model = 'mixing'")
    reference = metrics.regression_metrics(long.where("dataset = 'train'"), ["target"], 9)
    return drift.prediction_drift(long.where("dataset = 'val'"), reference)


@query("drift_summary")
def drift_summary(spark, d):
    return drift.drift_summary(drift_table(spark, d))


@query("latency_stats")
def latency_stats(spark, d):
    return rounded(metrics.latency_stats(events(spark, d), "value", ["event_type"]))


def _residual(kind: str):
    def run(spark, d):
        return magnitude(physics.residual_means(predictions(spark, d), (kind,), ("split",)), 6)
    return run


for _k in physics.RESIDUALS:
    QUERIES[f"physics_{_k}_residual"] = _residual(_k)


@query("physics_total")
def physics_total(spark, d):
    return magnitude(physics.total(predictions(spark, d), ("split",)), 4)


@query("target_ranges")
def target_ranges(spark, d):
    raw = metrics.target_ranges(readings(spark, d).withColumn("source", F.lit("raw")), "source")
    parted = metrics.target_ranges(parts(spark, d).withColumnRenamed("split", "source"), "source")
    total = readings(spark, d).count()
    return rounded(raw.unionByName(parted).withColumn("retention_pct", F.col("n") / F.lit(float(total)) * 100))


@query("prediction_agreement")
def prediction_agreement(spark, d):
    base = bounded(spark, d)
    a = base.select(ORDER, *[e.alias(t) for t, e in mixing_model().items()])
    # The second table stands for an exported model: the same air flow, other temperatures.
    b = base.select(ORDER, F.col("UCAIT").alias("UCAOT"), F.col("UCWIT").alias("UCWOT"), mixing_model()["UCAF"].alias("UCAF"))
    return rounded(metrics.prediction_agreement(a, b, ORDER))


# --- order-dependent operators -------------------------------------------------------

@query("row_index")
def row_index(spark, d):
    return blocks.row_index(readings(spark, d).select(ORDER, UNIT), ORDER, [UNIT])


@query("row_index_global")
def row_index_global(spark, d):
    """Positions along a key with wide gaps, as a microsecond clock has."""
    sparse = readings(spark, d).select((F.col(ORDER) * 1000003 + F.col(ORDER) % 7).alias("sparse_id"))
    return blocks.row_index(sparse, "sparse_id")


@query("ffill_limit")
def ffill_limit(spark, d):
    return clean.forward_fill(bounded(spark, d), ORDER, S, [UNIT])


@query("bfill_limit")
def bfill_limit(spark, d):
    return clean.fill_both_ways(bounded(spark, d), ORDER, S, [UNIT])


@query("bfill_only")
def bfill_only(spark, d):
    return clean.backward_fill(bounded(spark, d), ORDER, S, [UNIT])


@query("impute_forward_fill")
def impute_forward_fill(spark, d):
    df = cut_lineage(filled(spark, d))     # read twice: for the means and for the result
    return rounded(clean.fill_constants(df, clean.fit_means(df, DENSE)), 6)


@query("impute_mean")
def impute_mean(spark, d):
    df = bounded(spark, d).select(ORDER, *DENSE)
    return rounded(clean.fill_constants(df, clean.fit_means(df, DENSE)), 6)


@query("impute_median")
def impute_median(spark, d):
    df = bounded(spark, d).select(ORDER, *DENSE)
    return rounded(clean.fill_constants(df, clean.fit_medians(df, DENSE)), 6)


@query("impute_interpolate")
def impute_interpolate(spark, d):
    df = cut_lineage(clean.interpolate(bounded(spark, d).drop("UCAIH"), ORDER, DENSE, [UNIT]))
    return rounded(clean.fill_constants(df, clean.fit_means(df, DENSE)), 6)


@query("temporal_split")
def temporal_split(spark, d):
    return parts(spark, d).select(ORDER, "split")


@query("random_split_seeded")
def random_split_seeded(spark, d):
    base = readings(spark, d).select(ORDER)
    a = split.random_split(base, ORDER).withColumn("kind", F.lit("random"))
    b = split.holdout_split(base, ORDER).withColumn("kind", F.lit("holdout"))
    return a.unionByName(b).groupBy("kind", "split").agg(F.count(F.lit(1)).alias("rows"))


@query("time_series_folds")
def time_series_folds(spark, d):
    return split.assign_folds(readings(spark, d).select(ORDER), ORDER).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min(ORDER).alias("first_id"), F.max(ORDER).alias("last_id"))


@query("ecdf_difference")
def ecdf_difference(spark, d):
    rows = parts(spark, d, "val", "test")
    rows = rows.withColumn("is_ref", F.col("split") == "val")
    long = to_long(rows, ["UCFS", "UCWIT", "UCTSP"], keep=["is_ref"])
    return rounded(quantiles.ks_distance(long, "feature", "value", F.col("is_ref")), 6)


@query("make_sequences")
def make_sequences(spark, d):
    seq = blocks.sequences(readings(spark, d), ORDER, ["AMBT", "UCFS"], ["UCAF"], length=10, horizon=1, keys=[UNIT])
    total = F.aggregate("x", F.lit(0.0), lambda acc, row: acc + row[0] + row[1])
    return seq.select(UNIT, "seq_index", F.size("x").cast("bigint").alias("length"), "label_key", "y_UCAF",
                      F.col("x")[0][0].alias("first_ambt"), F.col("x")[9][1].alias("last_ucfs"),
                      F.round(total, 4).alias("total"))


@query("best_model_per_target")
def best_model_per_target(spark, d):
    return metrics.best_model_per_target(model_metrics(spark, d), ("dataset", "target"))


def indexed(spark, d, cols: Sequence[str]) -> DataFrame:
    return blocks.row_index(bounded(spark, d).select(ORDER, UNIT, *cols), ORDER, [UNIT])


@query("cycle_time")
def cycle_time(spark, d):
    return settled(features.cycle(indexed(spark, d, [])))


# --- sorts, limits, samples ------------------------------------------------------------

@query("top_features")
def top_features(spark, d):
    return rounded(importance.top_features(importance_by_target(spark, d), 5))


@query("top_features_per_target")
def top_features_per_target(spark, d):
    return rounded(importance.top_features_per_target(importance_by_target(spark, d), 3))


@query("sort_results")
def sort_results(spark, d):
    return model_metrics(spark, d).orderBy(F.desc_nulls_last("r2"), "model", "dataset", "target")


@query("head_missing_pattern")
def head_missing_pattern(spark, d):
    """The first 1000 rows: the smallest keys of each task, and only those are numbered."""
    head = readings(spark, d).drop(UNIT).orderBy(ORDER).limit(1000)
    index = (F.row_number().over(Window.orderBy(ORDER)) - 1).cast("bigint")
    return head.select(index.alias("time_index"), *[F.col(c).isNull().alias(c) for c in S])


def _sample(n: int):
    def run(spark, d):
        base = readings(spark, d).select(ORDER)
        got = split.sample_rows(base, ORDER, n)
        return got.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(ORDER).alias("distinct_rows"))
    return run


QUERIES["sample_series"] = _sample(5000)
QUERIES["sample_validation"] = _sample(100)


# --- set operations ---------------------------------------------------------------------

@query("union_history")
def union_history(spark, d):
    rows = parts(spark, d).select(ORDER, "split", "UCWIT", "UCFS")
    both = io.union_history(rows.where("split <> 'test'"), rows.where("split = 'test'").drop("UCFS"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count("UCFS").alias("with_fan"),
                                     F.round(F.avg("UCWIT"), 4).alias("mean_inlet"))


@query("union_importance")
def union_importance(spark, d):
    by_target = cut_lineage(importance_by_target(spark, d))
    out = None
    for t in TARGETS:
        one = by_target.where(F.col("target") == t)
        out = one if out is None else out.unionByName(one)
    return rounded(out, 6)


@query("except_columns")
def except_columns(spark, d):
    df = readings(spark, d)
    items = [F.struct(F.lit(c).alias("column"), F.lit(c in C.TARGETS).alias("is_target"),
                      F.lit(c in C.INPUT_SENSORS).alias("is_input"), F.col(c).alias("known")) for c in S]
    return df.agg(*[F.count(c).alias(c) for c in S]).select(F.inline(F.array(*items)))


@query("time_span")
def time_span(spark, d):
    e = events(spark, d).select(F.to_timestamp(F.col("ts").cast("string")).alias("ts"))
    return e.agg(text_ts(F.min("ts")).alias("first"), text_ts(F.max("ts")).alias("last"),
                 F.datediff(F.max("ts"), F.min("ts")).cast("bigint").alias("days"))


# --- features -----------------------------------------------------------------------------

@query("features_full")
def features_full(spark, d):
    df = features.cycle(features.static_features(indexed(spark, d, S)))
    return settled(df.select(ORDER, *[f for g in features.FULL_GROUPS.values() for f in g]))


def _group(name: str):
    def run(spark, d):
        df = features.static_features(bounded(spark, d))
        return settled(df.select(ORDER, *features.FULL_GROUPS[name]))
    return run


for _g in features.FULL_GROUPS:
    if _g != "temporal":
        QUERIES[f"feat_{_g}"] = _group(_g)


@query("feat_temporal")
def feat_temporal(spark, d):
    return settled(features.cycle(indexed(spark, d, [])).select(ORDER, *features.FULL_GROUPS["temporal"]))


@query("features_no_leakage")
def features_no_leakage(spark, d):
    df = features.cycle(features.leak_free(indexed(spark, d, FEATURES)))
    return settled(df.select(ORDER, *features.LEAK_FREE))


@query("features_serving")
def features_serving(spark, d):
    df = features.cycle(features.leak_free(indexed(spark, d, FEATURES), serving=True))
    # The online counter is read after its increment, the daily cycle before it.
    df = df.withColumn("time_index", F.col("time_index") + 1)
    return settled(df.select(ORDER, *features.LEAK_FREE))


@query("train_serve_skew")
def train_serve_skew(spark, d):
    base = features.leak_free(readings(spark, d)).select("UCWDP", F.col("P_pump_estimate").alias("train"),
                                                        F.when(F.col("UCWDP") == 0, (F.col("UCWF") + 1.0) * 0.01)
                                                        .otherwise(F.col("UCWF") * F.col("UCWDP") * 0.0001).alias("serve"))
    skew = ~F.col("train").eqNullSafe(F.col("serve"))
    return base.agg(F.count(F.lit(1)).alias("rows"), F.count_if(skew).alias("pump_differs"),
                    F.count(F.lit(1)).alias("index_differs"))


@query("thermal_power_api")
def thermal_power_api(spark, d):
    q = features.served_thermal_power(F.col("UCWF"), F.col("UCWIT"), mixing_model()["UCWOT"])
    return bounded(spark, d).select(ORDER, q.alias("Q_thermal"))


@query("eda_thermal")
def eda_thermal(spark, d):
    return features.quick_thermal(bounded(spark, d)).select(
        ORDER, "delta_T_water", "delta_T_air", "Q_water_calc", "Q_air_calc", "efficiency")


@query("scale_inverse_roundtrip")
def scale_inverse_roundtrip(spark, d):
    rows = parts(spark, d)
    params = scale.params_of(scale.fit_scaler(rows.where("split = 'train'"), DENSE))
    out = scale.invert_scaler(scale.apply_scaler(rows, params, "_scaled"), params, "_scaled", "_back")
    return rounded(out.select(ORDER, *[f"{c}_scaled" for c in DENSE], *[f"{c}_back" for c in DENSE]), 6)


@query("outlet_deltas")
def outlet_deltas(spark, d):
    m = mixing_model()
    return bounded(spark, d).select(ORDER, (m["UCAOT"] - F.col("UCAIT")).alias("air_delta"),
                                    (m["UCWOT"] - F.col("UCWIT")).alias("water_delta"))


# --- streaming ---------------------------------------------------------------------------

@query("stream_parse")
def stream_parse(spark, d):
    base = work_path(spark, "parse")
    jobs.drain(message_rows(event_stream(spark, d)), f"{base}/checkpoint", jobs.parse_to(f"{base}/out"))
    return spark.read.parquet(f"{base}/out").groupBy("topic", "branch").agg(F.count(F.lit(1)).alias("rows"))


@query("topic_route")
def topic_route(spark, d):
    return messages.route(message_table(spark, d), ROUTES).groupBy("topic", "pattern", "handler").agg(
        F.count(F.lit(1)).alias("rows"))


@query("topic_route_trie")
def topic_route_trie(spark, d):
    """Every customer, nation and the whole plant as patterns over one topic per kind, user and line of the events."""
    live = events(spark, d).select(F.concat_ws("/", F.lit("plant"), "event_type", F.col("user_id").cast("string"),
                                               (F.col("event_id") % 25).cast("string")).alias("topic"))
    customer, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation"))
    routes = customer.select(F.concat(F.lit("plant/+/"), "c_custkey", F.lit("/#")).alias("pattern"), F.lit("customer").alias("handler"))
    routes = routes.union(nation.select(F.concat(F.lit("plant/view/+/"), "n_nationkey"), F.lit("nation")))
    routes = routes.union(spark.createDataFrame([("plant/#", "audit"), ("plant/+", "none")], routes.schema))
    return topics.route_by_trie(live, routes).groupBy("pattern", "handler").agg(F.count(F.lit(1)).alias("rows"))


@query("stream_score")
def stream_score(spark, d):
    """Leak-free features, scaled, predicted and scaled back on every micro-batch; the power is of raw readings."""
    base = work_path(spark, "score")
    train = features.leak_free(parts(spark, d, "train"))
    params = scale.params_of(scale.fit_scaler(train, [*TRAIN_INPUTS, *TARGETS]))
    bundle = models.fit_per_target(scale.apply_scaler(train, params), TRAIN_INPUTS, TARGETS, models.linear)
    live = features.leak_free(cleaning.bound(sensor_view(event_stream(spark, d)), S))
    live = live.withColumns({"water_flow": F.col("UCWF"), "water_inlet": F.col("UCWIT")})
    scored = jobs.score(scale.apply_scaler(live, params), bundle, TRAIN_INPUTS)
    scored = scale.invert_scaler(scored, {t: params[t] for t in TARGETS}, "_pred", "_pred").withColumn(
        "Q_thermal", features.served_thermal_power(F.col("water_flow"), F.col("water_inlet"), F.col("UCWOT_pred")))
    jobs.drain(scored.select(ORDER, *[f"{t}_pred" for t in TARGETS], "Q_thermal"), f"{base}/checkpoint",
               jobs.to_folder(f"{base}/out"))
    return spark.read.parquet(f"{base}/out").drop("batch")


@query("stream_row_counter")
def stream_row_counter(spark, d):
    base = work_path(spark, "counter")
    live = sensor_view(event_stream(spark, d)).select(ORDER, UNIT)
    jobs.drain(live, f"{base}/checkpoint", jobs.count_rows_to(f"{base}/out", ORDER, UNIT))
    return spark.read.parquet(f"{base}/out/rows").drop("batch")


def window_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = parts(spark, d, "train")
    counts, edges = drift.counts_and_edges(to_long(rows, DRIFT).withColumn("is_ref", F.lit(True)))
    return edges, drift.small(drift.bins_of(counts, edges))


def live_long(e: DataFrame) -> DataFrame:
    rows = cleaning.bound(sensor_view(e), S)
    return to_long(rows, DRIFT, keep=["ts"])


@query("drift_by_window")
def drift_by_window(spark, d):
    edges, ref = window_inputs(spark, d)
    out = drift.drift_by_window(live_long(events(spark, d)), edges, ref)
    return rounded(out.withColumn("window_start", text_ts("window_start")))


@query("stream_drift_by_window")
def stream_drift_by_window(spark, d):
    base = work_path(spark, "window-drift")
    edges, ref = window_inputs(spark, d)
    for name, table in (("edges", edges), ("ref", ref)):
        table.write.parquet(f"{base}/{name}")
    out = jobs.windowed_drift(live_long(event_stream(spark, d)), spark.read.parquet(f"{base}/edges"),
                              spark.read.parquet(f"{base}/ref"))
    jobs.drain(out, f"{base}/checkpoint", jobs.to_folder(f"{base}/out"))
    back = spark.read.parquet(f"{base}/out").drop("batch")
    return rounded(back.withColumn("window_start", text_ts("window_start")))


@query("alerts_from_drift")
def alerts_from_drift(spark, d):
    return messages.alerts_from_drift(drift_table(spark, d), F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("retained_latest")
def retained_latest(spark, d):
    return messages.retained_latest(message_table(spark, d), tie="event_id").withColumn("ts", text_ts("ts"))


@query("stream_retained_latest")
def stream_retained_latest(spark, d):
    base = work_path(spark, "retained")
    live = jobs.latest_retained(message_rows(event_stream(spark, d)), tie="event_id")
    jobs.drain(live, f"{base}/checkpoint", jobs.to_folder(f"{base}/out"), mode="complete")
    # Complete mode: every batch holds the whole (one row per topic) state, the last one is current.
    last = spark.read.parquet(f"{base}/out")
    newest = Window.partitionBy("topic").orderBy(F.desc("batch"))
    return (last.withColumn("__r", F.row_number().over(newest)).where("__r = 1")
            .select("topic", "payload", text_ts("ts").alias("ts")))


@query("late_rows")
def late_rows(spark, d):
    """The events behind the watermark, by themselves: on-time rows come first, every 100th row afterwards."""
    base = work_path(spark, "late-rows")
    rows = events(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    late = F.col("event_id") % 100 == 0
    for name, part in (("on_time", rows.where(~late)), ("after", rows.where(late))):
        part.write.parquet(f"{base}/in/{name}")
        live = spark.readStream.schema("event_id bigint, ts timestamp").parquet(f"{base}/in/*")
        jobs.drain(live, f"{base}/checkpoint", jobs.split_late_to(f"{base}/out", "ts", "1 day"))
    return spark.read.parquet(f"{base}/out/rows").where("branch = 'late'").select("event_id", text_ts("ts").alias("ts"))


@query("late_data")
def late_data(spark, d):
    """On-time rows first, every 100th row afterwards: those behind the watermark must be dropped."""
    base = work_path(spark, "late")
    rows = events(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    late = F.col("event_id") % 100 == 0
    rows.where(~late).write.parquet(f"{base}/in/on_time")
    done = []
    for _ in range(2):
        live = spark.readStream.schema("event_id bigint, ts timestamp").parquet(f"{base}/in/*")
        query = jobs.drain(jobs.counts_by_window(live, "1 day"), f"{base}/checkpoint", jobs.to_folder(f"{base}/out"))
        done.append(jobs.dropped_late(query))
        if len(done) == 1:
            rows.where(late).write.parquet(f"{base}/in/late")
    emitted = spark.read.parquet(f"{base}/out").agg(F.sum("n").alias("rows_emitted"), F.count(F.lit(1)).alias("windows"))
    return emitted.withColumn("late_groups_dropped", F.lit(sum(done)).cast("bigint"))


# --- rules -----------------------------------------------------------------------------------

@query("kpi_levels")
def kpi_levels(spark, d):
    long = tagged(spark, d)
    lat = quantiles.grouped_quantiles(events(spark, d), [], "value", (0.5, 0.95))
    m = lat.select(F.inline(F.array(
        F.struct(F.lit("api_response_ms").alias("metric"), F.col("q")[0].alias("value")),
        F.struct(F.lit("inference_p95_ms").alias("metric"), F.col("q")[1].alias("value")))))
    worst = drift.psi(long).agg(F.max("psi").alias("value"))
    measured = m.unionByName(worst.select(F.lit("drift_psi").alias("metric"), "value"))
    return rounded(rules.kpi_levels(measured, rules.kpi_rules(spark)))


@query("operating_alerts")
def operating_alerts(spark, d):
    return rules.operating_alerts(readings(spark, d), ORDER)


@query("retrain_triggers")
def retrain_triggers(spark, d):
    rows = events(spark, d).agg(F.count(F.lit(1)).alias("samples"),
                                F.datediff(F.max("ts"), F.min("ts")).cast("bigint").alias("age_days"))
    return rules.retrain_triggers(drift_table(spark, d), model_metrics(spark, d).where("model = 'mixing'"), rows)


@query("model_acceptance")
def model_acceptance(spark, d):
    pair = metrics.compare_models(model_metrics(spark, d), "mixing", "inlet")
    return rounded(rules.model_acceptance(pair, F.lit(20.0)))


@query("retention_filter")
def retention_filter(spark, d):
    e = events(spark, d).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    limits = {"view": 7, "click": 14, "error": 21}
    return rules.retention_filter(e, F.col("event_type"), days=limits).select("event_id", "event_type")


@query("psi_band")
def psi_band(spark, d):
    long = tagged(spark, d, DENSE)
    table = rounded(drift.psi(long))
    return table.withColumns({"band": drift.psi_band(F.col("psi")), "documented": drift.psi_band(F.col("psi"), True)})


# --- models ------------------------------------------------------------------------------------

#: Inputs and the leak-free features made of them, but for the row position.
TRAIN_INPUTS = [*MODEL_INPUTS, *(f for f in features.LEAK_FREE if f not in ("time_index", "cycle_hour", "hour_sin", "hour_cos"))]


def training_rows(spark, d) -> DataFrame:
    """Bounded readings with leak-free features and the split label."""
    return features.leak_free(parts(spark, d))


def kept_rows(spark, d) -> DataFrame:
    """The training rows, made once: a filter on features of features would otherwise make each of them again and again."""
    return cut_lineage(training_rows(spark, d))


def scored_table(spark, d, estimator) -> DataFrame:
    rows = kept_rows(spark, d)
    bundle = models.fit_per_target(rows.where("split = 'train'"), TRAIN_INPUTS, TARGETS, estimator)
    return models.evaluate(rows, bundle, TRAIN_INPUTS, ["split"])


@query("fit_linear")
def fit_linear(spark, d):
    """Inputs and targets standardised; the fit standardises by itself, the scores are of the scaled targets."""
    rows = training_rows(spark, d)
    params = scale.params_of(scale.fit_scaler(rows.where("split = 'train'"), [*TRAIN_INPUTS, *TARGETS]))
    scaled = scale.apply_scaler(rows, params)
    bundle = models.fit_per_target(scaled.where("split = 'train'"), TRAIN_INPUTS, TARGETS, models.linear)
    return rounded(models.evaluate(scaled, bundle, TRAIN_INPUTS, ["split"]), 6)


@query("fit_ridge")
def fit_ridge(spark, d):
    return scored_table(spark, d, lambda t: models.linear(t, alpha=1.0))


@query("fit_random_forest")
def fit_random_forest(spark, d, trees: int = 100, depth: int = 15):
    """All targets at the stated size."""
    return scored_table(spark, d, lambda t: models.random_forest(t, trees=trees, depth=depth))


@query("fit_gbt")
def fit_gbt(spark, d, trees: int = 300, depth: int = 8, rate: float = 0.05):
    """All targets at the stated size."""
    return scored_table(spark, d, lambda t: models.boosted_trees(t, trees=trees, depth=depth, rate=rate))


@query("fit_gbt_early_stop")
def fit_gbt_early_stop(spark, d, trees: int = 300, depth: int = 8, rate: float = 0.05):
    rows = kept_rows(spark, d).withColumn("is_validation", F.col("split") == "val")
    bundle = models.fit_per_target(rows.where("split <> 'test'"), TRAIN_INPUTS, TARGETS,
                                   lambda t: models.boosted_trees(t, trees=trees, depth=depth, rate=rate, validation="is_validation"),
                                   extra=["is_validation"])
    used = F.create_map(*[F.lit(x) for t, m in bundle.items() for x in (t, m.n_trees)])
    return models.evaluate(rows, bundle, TRAIN_INPUTS, ["split"]).withColumn("trees", used[F.col("target")].cast("bigint"))


@query("predict_batch")
def predict_batch(spark, d):
    rows = training_rows(spark, d)
    params = scale.params_of(scale.fit_scaler(rows.where("split = 'train'"), [*TRAIN_INPUTS, *TARGETS]))
    scaled = scale.apply_scaler(rows, params)
    bundle = models.fit_per_target(scaled.where("split = 'train'"), TRAIN_INPUTS, TARGETS, models.linear)
    out = models.predict_all(scaled, bundle, TRAIN_INPUTS)
    return out.select(ORDER, *[(F.col(f"{t}_pred") * params[t][1] + params[t][0]).alias(t) for t in TARGETS])


@query("least_squares_residuals")
def least_squares_residuals(spark, d):
    """(target, rows, inputs whose product with the training residuals is not zero, and their mean): least squares leaves none."""
    train = training_rows(spark, d).where("split = 'train'")
    bundle = models.fit_per_target(train, MODEL_INPUTS, TARGETS, models.linear)
    scored = models.predict_all(train, bundle, MODEL_INPUTS)
    out = None
    for t in TARGETS:
        e, y = F.col(t) - F.col(f"{t}_pred"), F.col(t)
        zero = lambda x: (F.abs(F.sum(e * x)) > 1e-7 * F.sqrt(F.sum(y * y) * F.sum(x * x))).cast("int")
        one = scored.where(y.isNotNull()).agg(
            F.lit(t).alias("target"), F.count(F.lit(1)).alias("rows"), zero(F.lit(1.0)).cast("bigint").alias("mean_off"),
            sum((zero(F.col(f)) for f in MODEL_INPUTS), F.lit(0)).cast("bigint").alias("inputs_off"))
        out = one if out is None else out.unionByName(one)
    return out


@query("importance_long")
def importance_long(spark, d, trees: int = 100, depth: int = 15):
    rows = kept_rows(spark, d).where("split = 'train'")
    bundle = models.fit_per_target(rows, TRAIN_INPUTS, TARGETS, lambda t: models.random_forest(t, trees=trees, depth=depth))
    return models.tree_importance(bundle, TRAIN_INPUTS, spark)


@query("importance_mean_trees")
def importance_mean_trees(spark, d, trees: int = 100, depth: int = 15):
    """The mean over the targets of the models' importances; ``importance_mean`` has that of the correlations, as its oracle."""
    return importance.importance_mean(importance_long(spark, d, trees, depth))


@query("cv_temporal_refit")
def cv_temporal_refit(spark, d, k: int = 5, trees: int = 300, depth: int = 8, rate: float = 0.05):
    """New boosted trees per fold and target, which watch the fold's test rows; mean and deviation of their scores over the folds."""
    rows = cut_lineage(features.leak_free(bounded(spark, d)))
    make = lambda t: models.boosted_trees(t, trees=trees, depth=depth, rate=rate)
    return rounded(models.over_folds(models.refit_on_folds(rows, ORDER, TRAIN_INPUTS, TARGETS, make, k=k)))


@query("cv_temporal_frozen")
def cv_temporal_frozen(spark, d):
    train = predictions(spark, d).where("split = 'train'")
    folds = split.assign_folds(train, ORDER).where("role = 'test'")
    return metrics.regression_metrics(metrics.pairs_long(folds, ["fold"]), ["fold", "target"])


@query("compare_models")
def compare_models(spark, d, trees: int = 100, depth: int = 15):
    rows = kept_rows(spark, d)
    train = rows.where("split = 'train'")
    makers = {"linear": models.linear, "ridge": lambda t: models.linear(t, 1.0),
              "random_forest": lambda t: models.random_forest(t, trees=trees, depth=depth), "boosted_trees": models.boosted_trees}
    bundles = {n: models.fit_per_target(train, TRAIN_INPUTS, TARGETS, m) for n, m in makers.items()}
    return models.compare(rows, bundles, TRAIN_INPUTS)


@query("save_load_model")
def save_load_model(spark, d):
    """(target, rows, largest difference) of the predictions of the loaded and the fitted models."""
    rows = training_rows(spark, d)
    bundle = models.fit_per_target(rows.where("split = 'train'"), TRAIN_INPUTS, TARGETS, models.linear)
    path = work_path(spark, "bundle")
    models.save_bundle(bundle, path, spark, TRAIN_INPUTS)
    loaded, names = models.load_bundle(path, spark)
    fitted = models.predict_all(rows, bundle, names)
    both = models.predict_all(fitted.withColumnsRenamed({f"{t}_pred": f"{t}_fitted" for t in TARGETS}), loaded, names)
    return both.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.abs(F.col(f"{t}_pred") - F.col(f"{t}_fitted")).alias("gap")) for t in TARGETS]))
    ).groupBy("target").agg(F.count(F.lit(1)).alias("rows"), F.max("gap").alias("largest_gap"))


@query("score_pandas_udf")
def score_pandas_udf(spark, d):
    rows = parts(spark, d)
    a, b = models.linear_fit(rows.where("split = 'train'"), "UCAIT", "UCAOT")
    scored = rows.withColumn("UCAOT_pred", models.score_with(lambda f: a + b * f["UCAIT"], ["UCAIT"]))
    scored = scored.withColumn("UCAOT_pred", F.when(F.col("UCAIT").isNotNull(), F.col("UCAOT_pred")))
    return metrics.regression_metrics(metrics.pairs_long(scored, ["split"], ["UCAOT"]), ["split", "target"])


@query("pipeline_end_to_end")
def pipeline_end_to_end(spark, d):
    path = pipeline.prepare(sensors(spark, d).select(ORDER, UNIT, *S), S, ORDER, [UNIT], work_path(spark, "prepared"))
    back = spark.read.parquet(f"{path}/data")
    return rounded(back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.avg("Q_max_water").alias("mean_q"),
                                             F.avg("UCAOT").alias("mean_target")))


@query("flagship")
def flagship(spark, d):
    """Readings to bounded readings to leak-free features to one line per unit."""
    df = features.leak_free(bounded(spark, d))
    return rounded(df.groupBy(UNIT).agg(F.count(F.lit(1)).alias("rows"), F.avg("Q_max_water").alias("mean_q_max"),
                                        F.avg("P_total_estimate").alias("mean_power")))
