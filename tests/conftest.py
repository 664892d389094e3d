import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from streamjobs.session import build_session

    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
                            spark__driver__memory="8g", spark__default__parallelism=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
