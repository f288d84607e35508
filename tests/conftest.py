import pytest

from ledgerlake.session import make_session


@pytest.fixture(scope="session")
def spark():
    s = make_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"})
    yield s
    s.stop()
