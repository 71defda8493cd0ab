import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from noonward import constants as K  # noqa: E402
from noonward.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def hourly(spark):
    """Rows (plant, day, hour, target, one weather value, its forecast) as an hourly table."""

    def make(rows):
        weather, ahead = K.IRRADIANCE[0], K.IRRADIANCE[0] + K.FORECAST_SUFFIX
        schema = (
            "plant_id string, Year int, Month int, Day int, Hour int, "
            f"date date, dt timestamp_ntz, capacity_factor double, {weather} double, {ahead} double"
        )
        out = [
            (p, d.year, d.month, d.day, h, d, datetime(d.year, d.month, d.day, h), t, w, f) for p, d, h, t, w, f in rows
        ]
        return spark.createDataFrame(out, schema)

    return make
