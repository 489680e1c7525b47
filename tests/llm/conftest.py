import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from quillon.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(cores="4")


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    def make(rows):
        """rows: (doc_id, text) pairs, or texts."""
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA)

    return make
