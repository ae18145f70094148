import pytest

from reviewmill import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "6g", "spark.driver.host": "127.0.0.1",
           "spark.driver.bindAddress": "127.0.0.1", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
