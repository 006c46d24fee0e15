"""End to end: clean, derive, split, scale, persist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from thermalframe import config as C
from thermalframe.functions import features
from thermalframe.operators import clean, scale, split
from thermalframe.sources import io


def prepare(df: DataFrame, columns: Sequence[str], order: str, keys: Sequence[str], path: str,
            leak_free: bool = True, method: str = "standard") -> str:
    """Write the prepared data set to ``path``: scaled rows by split, scaler parameters, cleaning statistics.

    Jobs: one for the shares of missing values, one that writes the filled
    table, two for fill values and outlier bounds, two for the split cuts, one
    for the scaler, one final write.
    """
    spark = df.sparkSession
    indexed, stats = clean.fit_clean(df, columns, order, keys, position="time_index")
    table = features.leak_free(indexed) if leak_free else features.static_features(indexed)
    table = features.cycle(table).drop("water_delta_T", "air_delta_T")
    table = split.temporal_split(table, order, index=indexed)
    numeric = [c for c in table.columns if c not in (order, "split", *keys)]
    params = scale.fit_scaler(table.where("split = 'train'"), numeric, method)
    scaled = scale.apply_scaler(table, scale.params_of(params))
    targets = [t for t in C.TARGETS if t in stats.columns]
    io.write_dataset(scaled, path, params, split.split_manifest(table, len(numeric) - len(targets), len(targets)))
    stats.to_table(spark).write.mode("overwrite").parquet(f"{path}/cleaning")
    return path
