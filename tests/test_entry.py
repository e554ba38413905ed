"""The driver's contract: names, the flagship query, and life without the training-data folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "cost_usd" in df.columns


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_without_the_training_data_folders(tmp_path, left):
    """With the pipeline's file left in place too, and with another copy of it on the path."""
    for name in ("__spark_entry__.py", "tallyspark", *left):
        src = ROOT / name
        if src.exists():
            (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "tallyspark" / "llm", ignore_errors=True)
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "elsewhere" / "corpus_pipeline.py").write_text("import tallyspark.llm\n")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"
    path = {"PYTHONPATH": str(tmp_path / "elsewhere")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | path)
    n, training = out.stdout.split()[-2:]
    assert int(n) > 100 and training == "False"
