"""The library without the training-data operators, and without the pipeline made of them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_entry_imports_without_the_llm_folder(tmp_path, pipeline_stays):
    shutil.copytree(os.path.join(ROOT, "seqloom"), tmp_path / "seqloom",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline_stays else [])):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q; " \
           "assert not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
