import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from seqloom.session import local_session

    s = local_session(4, 4, "4g", f"file://{tmp_path_factory.mktemp('work')}")
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df, *cols):
    """Rows as sorted tuples of the named columns (all, in order, by default)."""
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
