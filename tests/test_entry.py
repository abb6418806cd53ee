"""The driver's entry: works with and without the training-data subpackage."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "loomvec"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "loomvec"
    package.mkdir()
    for child in (ROOT / "loomvec").iterdir():
        if child.name not in ("llm", "__pycache__"):
            (package / child.name).symlink_to(child)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1') for n in q) and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-B", "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for file in (ROOT / "loomvec").rglob("*.py"):
        if "llm" not in file.parts:
            text = file.read_text()
            assert "loomvec.llm" not in text and "from ..llm" not in text, file


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_plans_are_lean(spark):
    """Assignment is one projection over a pruned scan: no exchange but the packing of the centroids."""
    from loomvec.operators.assign import assign
    from loomvec.plans import catalog

    plan = assign(catalog._embeddings(spark, "/root/testdata/sf0.001"), catalog._start(spark, "/root/testdata/sf0.001"), strategy="arrow")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
