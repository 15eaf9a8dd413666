import os
import sys
from datetime import date, datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.config import Params  # noqa: E402
from tidemark.session import local_session  # noqa: E402
from tidemark.sources.landing import LANDING_SCHEMA  # noqa: E402
from tidemark.store import Store  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def params():
    return Params(
        window_start=datetime(2025, 1, 1),
        window_end=datetime(2025, 6, 15, 12),
        build_as_of=datetime(2025, 6, 15, 12),
        vintage_first=date(2025, 1, 31),
    )


@pytest.fixture
def store(spark, tmp_path):
    return Store.at(spark, str(tmp_path / "store"))


@pytest.fixture(scope="session")
def landing_rows(spark):
    """Landing rows from partial dicts; what is not named is null."""

    def make(*rows):
        names = LANDING_SCHEMA.fieldNames()
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LANDING_SCHEMA)

    return make


@pytest.fixture(scope="session")
def ntz(spark):
    """Frame from rows with ISO texts cast to zone-less timestamps."""

    def make(rows, schema, stamps):
        df = spark.createDataFrame(rows, schema)
        for c in stamps:
            df = df.withColumn(c, df[c].cast("timestamp_ntz"))
        return df

    return make
