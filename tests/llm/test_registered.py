"""The registered queries against their SQL twins, and the entry without the subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

from catalograph.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect


@pytest.mark.parametrize("key", list(ORACLES))
def test_query_matches_sql(spark, sf, key):
    ok, message, rows, _ = compare(spark, connect(sf), sf, QUERIES[key], ORACLES[key])
    assert ok, message


def test_one_query_an_operator():
    assert sorted(k.split("_")[0] for k in QUERIES) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])


def test_entry_imports_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    ignore = lambda d, names: [n for n in names if n in ("llm", "__pycache__")]
    import shutil

    shutil.copytree(root / "catalograph", tmp_path / "catalograph", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
