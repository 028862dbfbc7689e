import pytest

from geofold.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
