from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 80"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.parametrize("gone", [["tidewright/llm", "tests/llm"], ["tidewright/llm", "tests/llm", "corpus_pipeline.py"]])
def test_engine_without_training_operators(tmp_path, gone):
    """A copy of the repository without these files still has all its other queries."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", *[os.path.basename(x) for x in gone], "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'product_signals' in q and set(o) <= set(q) and 'pipeline' not in q and not any(n[:2] == 'op' and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.columns[0] == "target_product_id"
