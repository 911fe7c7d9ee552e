import pytest

from gneiss.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folders = {k: str(tmp_path_factory.mktemp(k.split(".")[-2])) for k in ("spark.sql.warehouse.dir", "spark.checkpoint.dir")}
    session = local_session("tests", 4, folders)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
