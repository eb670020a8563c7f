import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tillgrid.llm.registry import ship  # noqa: E402
from tillgrid.session import local_session  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use within.
CLASHES = ("id", "doc", "key", "row", "rank", "cell", "digest", "body", "salt", "s", "a", "b", "score", "kept", "mix_slot", "gone_id", "at", "n")


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    ship(session)
    return session


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or whole tuples, with columns whose names clash."""
    from pyspark.sql import functions as F

    def docs(rows, clash=True):
        full = [(*r, *("en", "s", 1)[len(r) - 2 :]) if len(r) < 5 else r for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df

    return docs
