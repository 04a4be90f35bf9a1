"""Tasks need no copy of the package: functions are sent by value."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from kpiframe.llm import quality, simhash, toxicity
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, toxic int")
assert quality.quality_rules(docs).count() == 3
assert {{r.component_id for r in simhash.near_duplicates(docs).collect()}} == {{1, 3}}
assert toxicity.score_toxicity(docs, labels).count() == 3
"""


def test_runs_where_the_workers_cannot_import_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, check=True)
