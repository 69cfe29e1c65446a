import pytest

from collatio.session import build_session

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "collatio-tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "2", "spark.sql.codegen.wholeStage": "false", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
