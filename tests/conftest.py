import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortlab.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=8, name="cohortlab-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def prepared(spark):
    """Encoded and split cohort of the smallest data."""
    from cohortlab.plans import catalog

    return catalog.prepared(spark, SMALL)


def predictions(spark, rows, experiment="e", model="m"):
    """Predictions table from (y, p, yhat) rows."""
    data = [(experiment, model, i, y, float(p), yhat) for i, (y, p, yhat) in enumerate(rows)]
    return spark.createDataFrame(
        data, "experiment string, model string, row_id bigint, y int, p double, yhat int"
    )
