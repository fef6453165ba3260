import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", 4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


def synthetic(ticker: str, seed: int, n: int = 420) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    dates = pd.bdate_range("2019-01-01", periods=n)
    close = 50 * np.exp(np.cumsum(rng.normal(0.0005, 0.011, n)))
    high = close * (1 + np.abs(rng.normal(0, 0.004, n)))
    low = close * (1 - np.abs(rng.normal(0, 0.004, n)))
    return pd.DataFrame(
        {
            "date": dates.date,
            "open": close * (1 + rng.uniform(-0.001, 0.001, n)),
            "high": high,
            "low": low,
            "close": close,
            "volume": rng.integers(1_000_000, 5_000_000, n).astype(float),
            "ticker": ticker,
        }
    )


@pytest.fixture(scope="session")
def pdf():
    return pd.concat([synthetic("AAA", 1), synthetic("BBB", 2), synthetic("CCC", 3, 30)], ignore_index=True)


@pytest.fixture(scope="session")
def panel(spark, pdf):
    return spark.createDataFrame(pdf).cache()
