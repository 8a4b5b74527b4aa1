import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE), str(HERE.parent)]
# Workers import the clients that test modules define.
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE), os.environ.get("PYTHONPATH", "")])

from askgrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8)
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Values of a function of a string column over the given inputs."""

    def run(function, inputs):
        rows = [(i, x) for i, x in enumerate(inputs)]
        df = spark.createDataFrame(rows, "i INT, x STRING")
        return [r[0] for r in df.orderBy("i").select(function(df["x"])).collect()]

    return run
