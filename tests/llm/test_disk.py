import time
from pathlib import Path

from pyspark.sql import functions as F

from quillspan.llm.common import saved


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {p for d in disks.localDirsString() for p in Path(d).glob("*/shuffle_*.data")}

    before = shuffles()
    out = saved(spark.range(1000).withColumn("g", F.col("id") % 7).groupBy("g").count())
    assert sorted(r["count"] for r in out.collect()) == [142, *[143] * 6]
    for _ in range(40):  # files are removed in the background
        if not shuffles() - before:
            break
        time.sleep(0.25)
    assert not shuffles() - before
