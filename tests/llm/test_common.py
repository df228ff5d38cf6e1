"""Tables between steps: none is left when the application ends, and none is written to a machine's own folder on a cluster."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from kartoteka.llm import _common as C

RUN = """
import sys
from pyspark.sql import SparkSession
from kartoteka.llm import _common as C
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
assert C.written(s.range(5), "some").count() == 5
import os
assert [x for x in os.listdir(sys.argv[1]) if x.startswith("some-")]
s.stop()
"""


def test_tables_go_though_the_session_is_stopped(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], check=True, cwd=repo, env={**__import__("os").environ, "PYTHONPATH": repo}, timeout=300)
    assert not [x for x in tmp_path.iterdir() if x.name.startswith("some-")]


def test_no_local_folder_on_a_cluster():
    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, *none: conf.get(k.replace(".", "_"), *none)), sparkContext=SimpleNamespace(master=master))

    local = "file:/home/x/spark-warehouse"
    assert C.shared_folder(session("local[2]", spark_sql_warehouse_dir=local)) == local
    assert C.shared_folder(session("yarn", spark_sql_warehouse_dir=local, spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    assert C.shared_folder(session("yarn", spark_sql_warehouse_dir="hdfs://a/w")) == "hdfs://a/w"
    with pytest.raises(ValueError, match="share"):
        C.shared_folder(session("spark://x:7077", spark_sql_warehouse_dir=local))
