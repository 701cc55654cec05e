import os
import subprocess
import sys
import time

from hotspan.session import CLEANUP, stage_table

SCRIPT = """
import os
from pyspark.sql import SparkSession
from hotspan.session import stage_path, stage_table
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
a, b = (stage_table(spark.range(5), n) for n in "ab")
assert a.union(b).count() == 10
assert os.path.dirname(os.path.dirname(stage_path(spark, "x"))) == os.path.dirname(os.path.dirname(stage_path(spark, "y")))
assert sum(n.startswith("hotspan-") for n in os.listdir({folder!r})) == 1
"""


def test_nothing_stays_of_a_run(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(folder=str(tmp_path))], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [n for n in os.listdir(tmp_path) if n.startswith("hotspan-")] == []


def test_shuffles_of_a_written_table_are_dropped(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {n for n in blocks.getAllBlocks().mkString(" ").split() if n.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(CLEANUP)
    counted = spark.range(10_000).repartition(4, "id").selectExpr("id % 100 AS k").groupBy("k").count()
    kept = counted.collect()  # keeps the driver's references to its shuffles
    of_collect = shuffles() - before
    assert of_collect
    written = stage_table(counted, "counted")
    ends = time.time() + 20
    while (left := shuffles() - before - of_collect) and time.time() < ends:
        time.sleep(0.2)
    assert not left
    assert sorted(written.collect()) == sorted(kept) == sorted(counted.collect())
    assert spark.conf.get(CLEANUP) == setting
