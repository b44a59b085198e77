import pytest

from quarrion.session import session, share_package


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    share_package(s)
    yield s
    s.stop()


@pytest.fixture
def people(spark):
    rows = [(25, "Alice", "Paris", 10.5), (30, "Bob", "Lyon", 20.5), (35, "Carol", "Paris", 30.5), (40, "Dave", "Lyon", 40.5), (45, "Eve", "Paris", 50.5)]
    return spark.createDataFrame(rows, "age bigint, name string, city string, price double")


@pytest.fixture
def engine(spark, people):
    from quarrion import Engine

    return Engine(spark).register("people", people)
