import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillon.runtime import session

    return session("tests", "8", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
