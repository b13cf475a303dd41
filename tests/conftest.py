import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from idlespan.session import local_session

    session = local_session("tests", memory="8g")
    session.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    yield session
    session.stop()
