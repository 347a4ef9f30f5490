import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from wattle.session import build_session

    s = build_session("local[4]", app_name="wattle-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    # Tests bring their own checkpoint folder only when the session has none.
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wattle-test-ckpt-"))
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted plain tuples of the chosen columns (None sorts first)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()),
                  key=lambda t: tuple((v is not None, v) for v in t))
