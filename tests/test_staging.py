"""The shared folder in sessions of their own."""

import subprocess
import sys
from pathlib import Path

CODE = """
import os
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("{master}").config("spark.ui.enabled", "false"){more}.getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from millrace.staging import shared_folder, staged
print("SET", spark.conf.get("spark.checkpoint.dir", None))
print("GOT", shared_folder(spark))
print("ROWS", staged(spark.range(5), "t").count(), shared_folder(spark) == shared_folder(spark))
"""


def ran(master="local[1]", more=""):
    repo = str(Path(__file__).resolve().parents[1])
    code = CODE.format(master=master, more=more)
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=repo, env={**__import__("os").environ, "PYTHONPATH": repo, "SPARK_CONF_DIR": "/nowhere"}).stdout


def test_without_the_setting():
    """A local session gets a temporary folder without a setting being changed; it goes when Python ends."""
    out = ran()
    where = next(line for line in out.splitlines() if line.startswith("GOT")).removeprefix("GOT file://")
    assert "SET None" in out and "ROWS 5 True" in out and "millrace-core-" in where and not Path(where).exists()


def test_the_setting_counts(tmp_path):
    out = ran(more=f'.config("spark.checkpoint.dir", "file://{tmp_path}")')
    assert f"GOT file://{tmp_path}" in out and "ROWS 5 True" in out


def test_staged_tables_go_with_their_block(spark):
    from millrace import staging
    from millrace.plans.registry import QUERIES

    where = Path(staging.shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    before = {p.name for p in where.iterdir()} if where.exists() else set()
    with staging.temporary(spark):
        rows = QUERIES["default_rank_order"](spark, "/root/testdata/sf0.001").collect()
        assert rows and {p.name for p in where.iterdir()} > before
    assert {p.name for p in where.iterdir()} == before
