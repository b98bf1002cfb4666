import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session

    session = get_session("tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return str(DATA / "sf0.001")


@pytest.fixture
def engine(spark, tmp_path):
    from tessera.engine import Engine

    return Engine(spark, str(tmp_path / "db"))
