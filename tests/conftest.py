import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "scripts"))

from thermalframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", "tests", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                      spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Two units, one of them holding most rows, with gaps of every length and ids that skip values."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    n = 600
    pdf = pd.DataFrame({
        "id": np.sort(rng.choice(3 * n, n, replace=False)) - 200,
        "unit": np.where(np.arange(n) % 10 == 0, "small", "hot"),
        "a": rng.normal(10, 3, n), "b": rng.integers(0, 5, n).astype(float)})
    pdf.loc[rng.random(n) < 0.3, "a"] = np.nan
    pdf.loc[100:140, "a"] = np.nan
    pdf.loc[:7, "a"] = np.nan
    pdf.loc[n - 9:, "a"] = np.nan
    pdf.loc[rng.random(n) < 0.7, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    from thermalframe.functions.scalars import nan_to_null
    return nan_to_null(df).repartition(5), pdf
