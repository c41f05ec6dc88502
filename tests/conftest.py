import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalograph import build_session, names as N  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def quads(spark):
    """Build quads from short tuples: (s, p, o) with IRIs for names holding '/', or (s, p, o, kind, dt)."""
    def make(*rows, store="st0001"):
        out = []
        for s, p, o, *rest in rows:
            kind = rest[0] if rest else ("iri" if o.startswith("http") else "literal")
            dt = rest[1] if len(rest) > 1 else None
            out.append((store, s, p if p.startswith("http") else N.v(p), o, kind, dt, N.GRAPH))
        return spark.createDataFrame(out, N.QUAD_SCHEMA)
    return make


def img(i):
    return f"{N.MEDIA_NS}Image/{i}"
