import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapeloom.operators import ordering  # noqa: E402
from tapeloom.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """Small chunks and uncoalesced partitions, so that chunk and partition borders are everywhere."""
    ordering.CHUNK_ROWS = 16
    spark = session("tests", "local[8]", 5)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    # Results must not depend on the zone of the session.
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    yield spark
    spark.stop()
