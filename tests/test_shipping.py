"""Workers get what they run from the driver: they need not find the package themselves."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {ROOT!r})
from pagefacts.sources.nodes import extract_nodes
from pagefacts.functions.digests import semantic_json
pages = spark.createDataFrame([(1, "<p class='a b'>x<p>y")], "page_id long, html string")
print(extract_nodes(pages).count(), spark.createDataFrame([('{{"b":1}}',)], "t string").select(semantic_json("t").text).first()[0])
"""


def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert said.stdout.split() == ["2", '{"b":1}'], said.stderr[-3000:]
