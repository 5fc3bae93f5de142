import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lexprep.session import build_session

    s = build_session("local[4]", shuffle_partitions=8)
    # tests own no cluster: a local checkpoint folder, set only because unset
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexprep-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tmpdir_factory_path():
    return tempfile.mkdtemp(prefix="lexprep-test-")


def one_col(spark, values, name="t", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")
