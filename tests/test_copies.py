"""Questions against their SQL twins on a tape whose prints repeat, as on larger copies of the tables."""

import duckdb
import pytest
from compare_sql import compare

EVENTS = "/root/testdata/sf0.01/events.parquet"


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """The events twice, the second time under other ids: every instant ties and every print has a copy."""
    folder = str(tmp_path_factory.mktemp("copied"))
    duckdb.sql(f"COPY (SELECT event_id + i * 10000000 AS event_id, * EXCLUDE (event_id, i) FROM '{EVENTS}', range(2) t(i)) TO '{folder}/events.parquet'")
    return folder


@pytest.mark.parametrize("name", ["cleaning_audit", "prepared_audit", "streamed_audit"])
def test_audits_of_repeated_prints(spark, copied, name):
    assert compare(spark, copied, name).startswith("ok")
