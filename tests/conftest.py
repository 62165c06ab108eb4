import os

import pytest

from loomary.session import local_session

DATA = os.environ.get("LOOMARY_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores=4, partitions=2, memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


def frame(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)
