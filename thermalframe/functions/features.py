"""Thermodynamic features. Each group is added only where its inputs exist."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalframe import config as C
from thermalframe.functions.scalars import clip, ratio


def _add(df: DataFrame, *features: tuple[str, tuple[str, ...], Column]) -> DataFrame:
    have = set(df.columns)
    new = {name: expr for name, needs, expr in features if have.issuperset(needs)}
    return df.withColumns(new) if new else df


def c(name: str) -> Column:
    return F.col(name)


def temperature(df: DataFrame) -> DataFrame:
    return _add(
        df,
        ("delta_T_water", ("UCWIT", "UCWOT"), c("UCWIT") - c("UCWOT")),
        ("delta_T_air", ("UCAIT", "UCAOT"), c("UCAOT") - c("UCAIT")),
        ("T_approach", ("UCWIT", "UCAIT"), c("UCWIT") - c("UCAIT")),
        ("T_water_avg", ("UCWIT", "UCWOT"), (c("UCWIT") + c("UCWOT")) / 2.0),
        ("T_air_avg", ("UCAIT", "UCAOT"), (c("UCAIT") + c("UCAOT")) / 2.0),
    )


def _mdot_water() -> Column:
    return c("UCWF") * C.RHO_WATER / (C.LITRES_PER_M3 * C.SECONDS_PER_MINUTE)


def mass_flow(df: DataFrame) -> DataFrame:
    return _add(
        df,
        ("mdot_water", ("UCWF",), _mdot_water()),
        ("mdot_air", ("UCAF",), c("UCAF") * C.RHO_AIR / C.SECONDS_PER_HOUR),
    )


def thermal_power(df: DataFrame) -> DataFrame:
    df = _add(
        df,
        ("Q_water", ("mdot_water", "delta_T_water"), c("mdot_water") * C.CP_WATER * c("delta_T_water") * C.W_TO_KW),
        ("Q_air", ("mdot_air", "delta_T_air"), c("mdot_air") * C.CP_AIR * c("delta_T_air") * C.W_TO_KW),
    )
    both = ("Q_water", "Q_air")
    df = _add(
        df,
        ("Q_avg", both, (F.abs(c("Q_water")) + F.abs(c("Q_air"))) / 2.0),
        ("Q_imbalance", both, c("Q_water") - c("Q_air")),
    )
    return _add(df, ("Q_imbalance_pct", ("Q_avg", "Q_imbalance"),
                     100.0 * c("Q_imbalance") / (F.abs(c("Q_avg")) + C.EPS)))


def efficiency(df: DataFrame) -> DataFrame:
    return _add(
        df,
        ("efficiency_HX", ("Q_water", "Q_air"),
         clip(F.abs(c("Q_air")) / (F.abs(c("Q_water")) + C.EPS), 0.0, 1.0)),
        ("effectiveness", ("delta_T_air", "UCWIT", "UCAIT"),
         clip(F.abs(c("delta_T_air")) / (F.abs(c("UCWIT") - c("UCAIT")) + C.EPS), 0.0, 1.0)),
    )


def ntu(df: DataFrame) -> DataFrame:
    return _add(df, ("NTU", ("effectiveness",),
                     clip(-F.log(1.0 - clip(c("effectiveness"), 0.0, 0.999) + 1e-6), 0.0, 10.0)))


def dimensionless(df: DataFrame) -> DataFrame:
    cw, ca = c("mdot_water") * C.CP_WATER, c("mdot_air") * C.CP_AIR if "mdot_air" in df.columns else F.lit(None)
    low = F.when(cw < ca, cw).when(ca.isNotNull() & cw.isNotNull(), ca)
    high = F.when(cw < ca, ca).when(ca.isNotNull() & cw.isNotNull(), cw)
    return _add(
        df,
        ("C_ratio", ("mdot_water", "mdot_air"), clip(low / (high + C.EPS), 0.0, 1.0)),
        ("Re_air_estimate", ("UCAF",), F.pow(c("UCAF") + 1.0, F.lit(0.8))),
    )


def ratios(df: DataFrame) -> DataFrame:
    df = _add(
        df,
        ("flow_ratio", ("UCAF", "UCWF"), ratio(c("UCAF") + 1.0, c("UCWF") + 1.0)),
        ("delta_T_ratio", ("delta_T_air", "delta_T_water"),
         (F.abs(c("delta_T_air")) + 0.1) / (F.abs(c("delta_T_water")) + 0.1)),
        ("setpoint_error", ("UCTSP", "UCAOT"), c("UCTSP") - c("UCAOT")),
    )
    return _add(df, ("setpoint_error_abs", ("setpoint_error",), F.abs(c("setpoint_error"))))


def power(df: DataFrame) -> DataFrame:
    df = _add(
        df,
        ("P_fan_estimate", ("UCAF",), F.pow(c("UCAF") + 1.0, F.lit(1.5)) * 0.001),
        ("P_pump_estimate", ("UCWF",), (c("UCWF") + 1.0) * 0.01),
    )
    df = _add(df, ("P_total_estimate", ("P_fan_estimate", "P_pump_estimate"),
                   c("P_fan_estimate") + c("P_pump_estimate")))
    return _add(df, ("COP_estimate", ("Q_avg", "P_total_estimate"),
                     clip(F.abs(c("Q_avg")) / (c("P_total_estimate") + C.EPS), 0.0, 20.0)))


def cycle(df: DataFrame, index: str = "time_index") -> DataFrame:
    """Daily cycle from the row position (one reading per minute)."""
    df = df.withColumn("cycle_hour", (c(index) % C.MINUTES_PER_DAY) / 60.0)
    angle = F.lit(2 * math.pi) * c("cycle_hour") / 24.0
    return df.withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)})


def interactions(df: DataFrame) -> DataFrame:
    return _add(
        df,
        ("T_water_x_flow", ("UCWIT", "UCWF"), c("UCWIT") * c("UCWF")),
        ("T_air_x_flow", ("UCAIT", "UCAF"), c("UCAIT") * c("UCAF")),
        ("humidity_x_temp", ("UCAIH", "UCAIT"), c("UCAIH") * c("UCAIT")),
        ("ambient_x_inlet", ("AMBT", "UCAIT"), c("AMBT") * c("UCAIT")),
    )


FULL_GROUPS = {
    "temperature": ("delta_T_water", "delta_T_air", "T_approach", "T_water_avg", "T_air_avg"),
    "mass_flow": ("mdot_water", "mdot_air"),
    "thermal_power": ("Q_water", "Q_air", "Q_avg", "Q_imbalance", "Q_imbalance_pct"),
    "efficiency": ("efficiency_HX", "effectiveness"),
    "ntu": ("NTU",),
    "dimensionless": ("C_ratio", "Re_air_estimate"),
    "ratios": ("flow_ratio", "delta_T_ratio", "setpoint_error", "setpoint_error_abs"),
    "power": ("P_fan_estimate", "P_pump_estimate", "P_total_estimate", "COP_estimate"),
    "temporal": ("time_index", "cycle_hour", "hour_sin", "hour_cos"),
    "interactions": ("T_water_x_flow", "T_air_x_flow", "humidity_x_temp", "ambient_x_inlet"),
}


def static_features(df: DataFrame) -> DataFrame:
    """All features of the full set that do not depend on the row position."""
    for group in (temperature, mass_flow, thermal_power, efficiency, ntu, dimensionless, ratios, power, interactions):
        df = group(df)
    return df


def leak_free(df: DataFrame, serving: bool = False) -> DataFrame:
    """Features that use input sensors only (no target), without the row position ones.

    ``serving`` switches the pump formula on the *value* of the pressure reading
    (the online rule) instead of on the presence of its column.
    """
    df = _add(
        df,
        ("T_approach", ("UCWIT", "UCAIT"), c("UCWIT") - c("UCAIT")),
        ("T_water_ambient_diff", ("UCWIT", "AMBT"), c("UCWIT") - c("AMBT")),
        ("T_air_ambient_diff", ("UCAIT", "AMBT"), c("UCAIT") - c("AMBT")),
        ("setpoint_inlet_diff", ("UCTSP", "UCAIT"), c("UCTSP") - c("UCAIT")),
        ("setpoint_ambient_diff", ("UCTSP", "AMBT"), c("UCTSP") - c("AMBT")),
        ("mdot_water", ("UCWF",), _mdot_water()),
        ("P_fan_estimate", ("UCFS",), F.pow(F.abs(c("UCFS")) + 1.0, F.lit(1.5)) * 0.001),
        ("T_water_x_flow", ("UCWIT", "UCWF"), c("UCWIT") * c("UCWF")),
        ("ambient_x_inlet", ("AMBT", "UCAIT"), c("AMBT") * c("UCAIT")),
        ("setpoint_x_flow", ("UCTSP", "UCWF"), c("UCTSP") * c("UCWF")),
        ("T_water_x_pressure", ("UCWIT", "UCWDP"), c("UCWIT") * c("UCWDP")),
    )
    simple = (c("UCWF") + 1.0) * 0.01
    if "UCWDP" in df.columns:
        pump = c("UCWF") * c("UCWDP") * 0.0001
        if serving:
            pump = F.when(c("UCWDP") != 0, pump).when(c("UCWDP") == 0, simple)
    else:
        pump = simple
    df = _add(
        df,
        ("P_pump_estimate", ("UCWF",), pump),
        ("C_water", ("mdot_water", "UCWIT"), c("mdot_water") * C.CP_WATER * C.W_TO_KW),
    )
    return _add(
        df,
        ("P_total_estimate", ("P_fan_estimate", "P_pump_estimate"), c("P_fan_estimate") + c("P_pump_estimate")),
        ("Q_max_water", ("C_water", "T_approach"), c("C_water") * F.abs(c("T_approach"))),
    )


LEAK_FREE = (
    "T_approach", "T_water_ambient_diff", "T_air_ambient_diff", "setpoint_inlet_diff", "setpoint_ambient_diff",
    "mdot_water", "C_water", "Q_max_water", "P_fan_estimate", "P_pump_estimate", "P_total_estimate",
    "time_index", "cycle_hour", "hour_sin", "hour_cos",
    "T_water_x_flow", "ambient_x_inlet", "setpoint_x_flow", "T_water_x_pressure",
)


def quick_thermal(df: DataFrame) -> DataFrame:
    """Exploration estimates with unconverted flows."""
    df = _add(
        df,
        ("delta_T_water", ("UCWIT", "UCWOT"), c("UCWIT") - c("UCWOT")),
        ("delta_T_air", ("UCAIT", "UCAOT"), c("UCAOT") - c("UCAIT")),
    )
    df = _add(
        df,
        ("Q_water_calc", ("UCWF", "delta_T_water"), c("UCWF") * C.CP_WATER * c("delta_T_water") / 1000.0),
        ("Q_air_calc", ("UCAF", "delta_T_air"), c("UCAF") * C.CP_AIR * c("delta_T_air") / 1000.0),
    )
    divisor = c("Q_water_calc") + 1e-6 if "Q_water_calc" in df.columns else F.lit(None)
    return _add(df, ("efficiency", ("Q_water_calc", "Q_air_calc"),
                     c("Q_air_calc") / F.when(divisor != 0, divisor)))


def served_thermal_power(water_flow: Column, inlet: Column, predicted_outlet: Column) -> Column:
    """Thermal power in kW from a predicted water outlet temperature."""
    return water_flow * 1.0 / 60.0 * 4.186 * (inlet - predicted_outlet)
