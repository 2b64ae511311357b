"""Every query against its DuckDB twin at the smallest size."""
import pytest

import __spark_entry__ as entry
from lograil.plans import analysis, comparison, detection, registry
from lograil.session import durable
from tests.oracle_check import compare, connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(FOLDER)


@pytest.fixture(scope="module", autouse=True)
def shared_detector(spark):
    """Queries on top of the detector share one stored run of it; its own queries run it themselves."""
    patch, stored = pytest.MonkeyPatch(), {}

    def found(session, folder):
        if folder not in stored:
            stored[folder] = durable(detection.found(session, folder))
        return stored[folder]
    for module in (analysis, comparison):
        patch.setattr(module, "found", found)
    yield
    patch.undo()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    count, problem = compare(spark, FOLDER, entry.queries()[name], entry.oracle_sql().get(name), duck)
    assert problem is None and count > 0
