import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from check import session

    s = session("local[4]")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture()
def obj(spark):
    """Entries rows from nested Python values: ``obj({("d", "1"): {...}})``."""
    from fixtures import entries_frame

    return lambda objects: entries_frame(spark, objects)
