"""Queries run where only the driver has the package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
lost = spark.range(1).mapInPandas(lambda batches: (b.assign(id=__import__("importlib.util").util.find_spec("skein") is None) for b in batches), "id boolean").first()[0]
assert lost, "workers see the package"
import skein.llm.queries as q
for name, run in q.QUERIES.items():
    print(name, run(spark, sys.argv[2]).count(), flush=True)
"""


def test_workers_without_the_package(spark, tmp_path):
    words = "the of and to stone river cloud paper light trash scum lose".split()
    docs = [(i, " ".join(words[(i * j + j) % 12] for j in range(20 + i)), "en", f"s{i % 2}", 1) for i in range(30)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pages = [(i, f"http://cheap-pills{i}.example.org/a", f"<html><body><article><p>{docs[i][1]}</p></article></body></html>") for i in range(10)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", SCRIPT, repo, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert run.returncode == 0, run.stderr[-2000:]
    assert len(run.stdout.split()) >= 26
