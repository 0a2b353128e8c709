"""Tables and streams work where no checkpoint folder is set."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

STREAM = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", sys.argv[1]).getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from siltline.plans import registry
registry_rows = registry.QUERIES["stream_comment_dedup"](spark, "/root/testdata/sf0.001").count()
assert registry_rows > 0 and spark.sparkContext.getCheckpointDir().startswith("file:" + sys.argv[1])
"""


def run_without_folder(code, tmp_path):
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf")}  # no defaults of the machine
    got = subprocess.run([sys.executable, "-c", code, str(tmp_path)], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]


def test_streams_without_a_checkpoint_folder(tmp_path):
    run_without_folder(STREAM, tmp_path)
