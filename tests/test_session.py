"""Folders of intermediate tables, in an application whose configuration names none."""

import os
import subprocess
import sys
import textwrap

from ontoloom.plans.session import delete_path, run_folder, settle, shared_path

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _local(path):
    return path.removeprefix("file://")


def test_tables_of_a_run_go_with_it(spark):
    with run_folder(spark):
        path = settle(spark.range(3), "inside")._ontoloom_path
        with run_folder(spark):
            inner = settle(spark.range(3), "inner")._ontoloom_path
        assert os.path.exists(_local(path)) and not os.path.exists(_local(inner))
    assert not os.path.exists(_local(path))


def test_delete_path(spark):
    path = shared_path(spark, "gone")
    spark.range(2).write.parquet(path)
    delete_path(spark, path)
    assert not os.path.exists(_local(path))


def test_without_any_setting(tmp_path):
    """No configuration file and no spark.checkpoint.dir: closures work, and the process leaves no table behind."""
    code = """
        import tempfile
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        from ontoloom.operators.closure import closure
        from ontoloom.plans.session import settle, shared_root
        rows = closure(spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")).collect()
        assert len(rows) == 3, rows
        settle(spark.range(1), "kept")
        print("ROOT", shared_root(spark))
        spark.stop()
    """
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": REPO, "TMPDIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    root = next(line.split()[1] for line in run.stdout.splitlines() if line.startswith("ROOT"))
    assert not os.path.exists(_local(root))


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys()"
    run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": REPO}, cwd=REPO, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-3000:]
