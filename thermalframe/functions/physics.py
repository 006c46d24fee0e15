"""Per-row physics residuals of predictions, and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalframe import config as C
from thermalframe.functions.scalars import relu


def _powers() -> tuple[Column, Column]:
    mdot_w = F.col("UCWF") * C.RHO_WATER / (C.LITRES_PER_M3 * C.SECONDS_PER_MINUTE)
    mdot_a = F.col("UCAF") * C.RHO_AIR / C.SECONDS_PER_HOUR
    return (mdot_w * C.CP_WATER * (F.col("UCWIT") - F.col("UCWOT_pred")),
            mdot_a * C.CP_AIR * (F.col("UCAOT_pred") - F.col("UCAIT")))


def energy() -> Column:
    """Squared relative difference of water-side and air-side power."""
    qw, qa = _powers()
    w, a = qw / C.Q_CHARACTERISTIC, qa / C.Q_CHARACTERISTIC
    rel = F.abs(w - a) / ((F.abs(w) + F.abs(a)) / 2.0 + C.RESIDUAL_EPS)
    return rel * rel


def efficiency() -> Column:
    """Squared violation of the plausible range of air-side over water-side power."""
    qw, qa = _powers()
    e = F.abs(qa) / (F.abs(qw) + C.RESIDUAL_EPS)
    low, high = C.EFFICIENCY_RANGE
    under, over = relu(low - e), relu(e - high)
    return under * under + over * over


def monotonicity() -> Column:
    """Water that leaves warmer than it entered, air above the water inlet, air cooled too far."""
    water = relu(-((F.col("UCWIT") - F.col("UCWOT_pred")) / C.T_CHARACTERISTIC))
    ceiling = relu((F.col("UCAOT_pred") - F.col("UCWIT")) / C.T_CHARACTERISTIC)
    air = relu(-((F.col("UCAOT_pred") - F.col("UCAIT")) / C.T_CHARACTERISTIC) - 0.1)
    return water * water + 0.5 * (ceiling * ceiling) + 0.3 * (air * air)


def _outside(c: Column) -> Column:
    low, high = C.PREDICTED_TEMPERATURE_RANGE
    return relu((low - c) / C.T_CHARACTERISTIC) + relu((c - high) / C.T_CHARACTERISTIC)


def limits() -> Column:
    """Squared violation of the temperature range and of non-negative flow."""
    air, water = _outside(F.col("UCAOT_pred")), _outside(F.col("UCWOT_pred"))
    flow = relu(-F.col("UCAF_pred") / 1000.0)
    return 0.1 * (air * air) + 0.1 * (water * water) + 0.05 * (flow * flow)


RESIDUALS = {"energy": energy, "efficiency": efficiency, "monotonicity": monotonicity, "limits": limits}


def residual_means(df: DataFrame, names=tuple(RESIDUALS), by: tuple[str, ...] = ()) -> DataFrame:
    """Mean residual per kind over the rows where all its inputs are known; one pass."""
    return df.groupBy(*by).agg(*[F.avg(RESIDUALS[n]()).alias(n) for n in names])


def total(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Data error plus the weighted residuals."""
    errors = []
    for t in C.TARGETS:
        e = F.col(f"{t}_pred") - F.col(t)
        errors.append(e * e)
    mse = F.avg((errors[0] + errors[1] + errors[2]) / 3.0).alias("data")
    table = df.groupBy(*by).agg(mse, *[F.avg(RESIDUALS[n]()).alias(n) for n in RESIDUALS])
    weighted = F.col("data")
    for n, w in C.RESIDUAL_WEIGHTS.items():
        weighted = weighted + w * F.col(n)
    return table.withColumn("total", weighted)
