"""Tables in the folder that the cluster shares, to cut lineage in loops."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession):
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            shared = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
            spark.conf.set("spark.checkpoint.dir", shared)
        self.spark, self.root, self.number = spark, f"{shared.rstrip('/')}/textloom-{uuid.uuid4().hex}", itertools.count()
        atexit.register(self.clear)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{next(self.number)}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended
            pass


def by_size(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with the row of ``groups`` that has their key; ``size`` tells how many rows hold it.

    The keys that more than 1/``share`` of the rows hold are fewer than ``share``:
    theirs are broadcast, so that no task gets all rows of such a key. Both
    inputs are read twice and should be written tables, of keys and numbers rather than texts.
    """
    least = max(100, (groups.agg(F.sum(size)).first()[0] or 0) // share)
    hot = F.broadcast(groups.filter(F.col(size) > least))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.filter(F.col(size) <= least).hint("merge"), key)
    return cold.unionByName(rows.join(hot, key))
