"""Sessions with and without a shared folder, and the layout of the tests."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PLAIN = """
from newsgrid.session import build_session, cut, drop_cut, scratch_dir
spark = build_session(master="local[1]", **{"spark.ui.enabled": "false"})
assert spark.conf.get("spark.checkpoint.dir", None) is None
kept = cut(spark.range(3))
assert kept.count() == 3 and scratch_dir(spark) == scratch_dir(spark)
files = kept.inputFiles()
assert all(scratch_dir(spark) in f for f in files)
drop_cut(kept)
spark.stop()
"""


def test_cut_without_a_set_folder(tmp_path):
    """Spark's defaults are left out, so nothing names a folder."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    done = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_base_names_of_tests_are_unique():
    names = Counter(p.name for p in (ROOT / "tests").rglob("test_*.py"))
    assert [n for n, k in names.items() if k > 1] == []
