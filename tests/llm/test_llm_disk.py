"""What the operators leave on the executors' disks."""

import glob
import time

from pyspark.sql import functions as F

from ragmill.llm import _spark as S


def test_shuffle_files_go_when_a_table_is_written(spark):
    files = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True))
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    said, out = spark.conf.get(name), S.written(df, "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(name) == said  # the session's setting is as it was
    assert out.count() == 100
