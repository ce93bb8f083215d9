import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tidegrid.session import local_session

    return local_session("tests")


T0 = datetime(2024, 1, 1)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


@pytest.fixture
def series(spark):
    """Rows (key k, minutes, values...) as a frame with a zone-less time."""

    def make(rows, columns="value double"):
        data = [(r[0], at(r[1]), *r[2:]) for r in rows]
        return spark.createDataFrame(data, f"k string, ts timestamp_ntz, {columns}")

    return make


@pytest.fixture
def one(series):
    """A single series from a list of values at a fixed step."""

    def make(values, step=1.0, columns="value double"):
        return series([("a", i * step, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], columns)

    return make


def values(df, col, by="ts"):
    return [r[col] for r in df.orderBy(by).collect()]
