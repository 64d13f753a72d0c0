import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from smogline.session import get_spark
    s = get_spark("local[4]", app="smogline-tests", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="smogline-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def readings(spark):
    from smogline.sources.adapter import readings_events
    return readings_events(spark, SF001)
