"""Executors that don't see the folder of the repository."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import random, sys
from pathlib import Path
from pyspark.sql import SparkSession
repo, top = sys.argv[1:]
conf = {"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"file://{top}/shared", "spark.executor.memory": "512m"}
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
sys.path.insert(0, repo)
import __spark_entry__, corpus_pipeline
rng = random.Random(3)
text = lambda: ". ".join(" ".join(f"v{rng.randrange(90)}" for _ in range(12)) for _ in range(12)) + "."
spark.createDataFrame([(i, text()) for i in range(12)], "doc_id long, text string").write.parquet(f"{top}/documents.parquet")
spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
docs = spark.read.parquet(f"{top}/documents.parquet")
print("stage", corpus_pipeline.quality_classifier(spark, docs, top).count())
print("pipeline", len({r["doc_id"] for r in __spark_entry__.queries()["pipeline"](spark, top).collect()}))
print("sent", [x.startswith("lexgrove-") for x in spark.sparkContext._python_includes])
"""


def test_pipeline_where_executors_lack_the_repository(tmp_path):
    """The first stage in Python fails there unless the package is sent; it is sent once."""
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "script.py").write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_WORKER_DIR": str(tmp_path / "work"), "OMP_NUM_THREADS": "1"}
    done = subprocess.run([sys.executable, tmp_path / "script.py", REPO, tmp_path], env=env, cwd=tmp_path / "elsewhere", capture_output=True, text=True, timeout=300)
    assert done.stdout.split("\n")[:3] == ["stage 12", "pipeline 12", "sent [True]"], done.stderr[-2000:]
