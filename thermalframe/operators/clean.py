"""Cleaning steps that need statistics or row order. Fitted statistics are plain dicts and tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalframe import config as C
from thermalframe.functions.cleaning import bound, physics_flags
from thermalframe.functions.scalars import clip, null_share
from thermalframe.operators.blocks import neighbours, row_index
from thermalframe.operators.quantiles import column_quantiles, settled
from thermalframe.session import cut_lineage


def null_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """One small row to the driver, whatever the size of the table."""
    return df.agg(*[null_share(c).alias(c) for c in columns]).first().asDict()


def drop_sparse_columns(df: DataFrame, columns: Sequence[str],
                        max_share: float = C.MAX_NULL_SHARE) -> tuple[DataFrame, list[str]]:
    """Drop columns whose share of missing values is strictly above the limit; returns the kept names."""
    shares = null_shares(df, columns)
    kept = [c for c in columns if (shares[c] or 0.0) <= max_share]
    return df.drop(*[c for c in columns if c not in kept]), kept


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(columns))


def drop_rows_without_target(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return df.dropna("all", subset=[t for t in targets if t in df.columns])


def _keep(df: DataFrame, new: dict[str, Column], names: Sequence[str]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in names])


def forward_fill(df: DataFrame, order: str, columns: Sequence[str], keys: Sequence[str] = (),
                 limit: int = C.FILL_LIMIT, width: int | None = None) -> DataFrame:
    """Carry the last value forward over at most ``limit`` rows."""
    near = neighbours(df, order, columns, keys, width)
    new = {c: F.when(F.col(f"{c}__pd") <= limit, F.col(f"{c}__pv")) for c in columns}
    return _keep(near, new, df.columns)


def backward_fill(df: DataFrame, order: str, columns: Sequence[str], keys: Sequence[str] = (),
                  limit: int = C.FILL_LIMIT, width: int | None = None) -> DataFrame:
    near = neighbours(df, order, columns, keys, width)
    new = {c: F.when(F.col(f"{c}__nd") <= limit, F.col(f"{c}__nv")) for c in columns}
    return _keep(near, new, df.columns)


def fill_both_ways(df: DataFrame, order: str, columns: Sequence[str], keys: Sequence[str] = (),
                   limit: int = C.FILL_LIMIT, width: int | None = None, position: str | None = None) -> DataFrame:
    """Forward, then backward on the result; ``position`` names a column for the row's place in its series.

    A row left empty by the forward step has no known value within ``limit``
    before it, so the next filled row after it is a known one: both steps read
    the same neighbours and cost one shuffle together.
    """
    near = neighbours(df, order, columns, keys, width, position)
    new = {c: F.coalesce(F.when(F.col(f"{c}__pd") <= limit, F.col(f"{c}__pv")),
                         F.when(F.col(f"{c}__nd") <= limit, F.col(f"{c}__nv"))) for c in columns}
    return _keep(near, new, [*df.columns, *([position] if position else [])])


def interpolate(df: DataFrame, order: str, columns: Sequence[str], keys: Sequence[str] = (),
                limit: int = C.INTERPOLATE_LIMIT, width: int | None = None) -> DataFrame:
    """Linear by row position, at most ``limit`` rows from a known value; edges repeat the nearest value."""
    near = neighbours(df, order, columns, keys, width)
    new = {}
    for c in columns:
        pv, pd, nv, nd = (F.col(f"{c}__{s}") for s in ("pv", "pd", "nv", "nd"))
        between = pv + (nv - pv) / (pd + nd) * pd
        new[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                  .when(pv.isNotNull() & nv.isNotNull() & ((pd <= limit) | (nd <= limit)), between)
                  .when(nv.isNull() & (pd <= limit), pv)
                  .when(pv.isNull() & (nd <= limit), nv))
    return _keep(near, new, df.columns)


def fit_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in column_quantiles(df, columns, (0.5,)).items()}


def fill_constants(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    known = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None and c in df.columns}
    return df.withColumns(known) if known else df


def fit_outlier_bounds(df: DataFrame, columns: Sequence[str],
                       factor: float = C.OUTLIER_IQR_FACTOR) -> dict[str, tuple[float, float]]:
    out = {}
    for c, (q1, q3) in column_quantiles(df, columns, (0.25, 0.75)).items():
        if q1 is not None:
            out[c] = (settled(q1 - factor * (q3 - q1)), settled(q3 + factor * (q3 - q1)))
    return out


def clip_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    cols = {c: clip(F.col(c), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns}
    return df.withColumns(cols) if cols else df


def outlier_clip_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, lower, upper, clipped)."""
    row = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in bounds.items()])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"),
                 F.col(c).alias("clipped")) for c, (lo, hi) in bounds.items()])))


@dataclass
class CleaningStats:
    """What fitting learned; reused unchanged on new data."""

    columns: list[str]
    strategy: str = "forward_fill"
    fill: dict[str, float | None] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, i, self.strategy, self.fill.get(c), *(self.bounds.get(c) or (None, None)))
                for i, c in enumerate(self.columns)]
        return spark.createDataFrame(
            rows, "column string, ordinal int, strategy string, fill double, lower double, upper double")

    @classmethod
    def from_table(cls, table: DataFrame) -> CleaningStats:
        rows = sorted(table.collect(), key=lambda r: r["ordinal"])   # one row per column
        return cls([r["column"] for r in rows], rows[0]["strategy"], {r["column"]: r["fill"] for r in rows},
                   {r["column"]: (r["lower"], r["upper"]) for r in rows if r["lower"] is not None})

    def as_dict(self) -> dict:
        return asdict(self)


def _filled(df: DataFrame, strategy: str, order: str, columns: Sequence[str], keys: Sequence[str],
            width: int | None, position: str | None = None) -> DataFrame:
    if strategy == "forward_fill":
        return fill_both_ways(df, order, columns, keys, width=width, position=position)
    if position:
        df = row_index(df, order, keys, position, width)
    if strategy == "interpolate":
        return interpolate(df, order, columns, keys, width=width)
    if strategy in ("mean", "median"):
        return df
    raise ValueError(f"unknown imputation strategy: {strategy}")


def fit_clean(df: DataFrame, columns: Sequence[str], order: str, keys: Sequence[str] = (),
              strategy: str = "forward_fill", width: int | None = None,
              position: str | None = None) -> tuple[DataFrame, CleaningStats]:
    """Fit and apply all cleaning steps; ``position`` names a column for the row's place in its series.

    The filled table is cut off once (shared folder): means, quartiles and the
    result are all read from it, so the ordered fill runs once.
    """
    bounded, kept = drop_sparse_columns(bound(df, columns), columns)
    filled = cut_lineage(_filled(bounded, strategy, order, kept, keys, width, position))
    fill = fit_medians(filled, kept) if strategy == "median" else fit_means(filled, kept)
    complete = fill_constants(filled, fill)
    bounds = fit_outlier_bounds(complete, kept)
    stats = CleaningStats(kept, strategy, fill, bounds)
    return _finish(complete, stats), stats


def apply_clean(df: DataFrame, columns: Sequence[str], order: str, stats: CleaningStats,
                keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Clean new data with fitted statistics: same columns, same fill values, same bounds."""
    bounded = bound(df, columns).drop(*[c for c in columns if c not in stats.columns])
    filled = _filled(bounded, stats.strategy, order, stats.columns, keys, width)
    return _finish(fill_constants(filled, stats.fill), stats)


def _finish(df: DataFrame, stats: CleaningStats) -> DataFrame:
    """Clip, flag and drop rows that still miss a value.

    A column with a known fill value has no missing value left, so only columns
    without one are tested: a filter on all of them would be pushed through every
    step above and multiply its expressions.
    """
    flagged = physics_flags(clip_outliers(df, stats.bounds))
    unfilled = [c for c in stats.columns if stats.fill.get(c) is None]
    return drop_null_rows(flagged, unfilled) if unfilled else flagged
