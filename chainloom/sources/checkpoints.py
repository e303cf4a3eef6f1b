"""Cutting lineage in a folder that every executor can read.

The cluster names the folder in ``spark.checkpoint.dir``; only where that is
unset on one machine (tests, notebooks) a temporary folder is taken, a cluster
without it is refused.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []
_STORED: set = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors can read")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="chainloom-"))
    return _FALLBACK[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager, reliable checkpoint; keeps the partitioning of ``df``."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark) + "/checkpoints")
    return df.checkpoint(eager=True)


class Stored:
    """A table written to the shared folder, with its path for removal.

    Joins over it shuffle: the size of a compressed file says little about the
    memory a broadcast would take.  Where a side is known to be small, the join
    says so itself, after counting it.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/stored-{uuid.uuid4().hex}"
        _STORED.add(self)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path).hint("merge")

    def drop(self) -> None:
        _STORED.discard(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def drop_all() -> None:
    """Removes the tables of this application; also runs when the driver ends.
    DataFrames over them cannot be computed afterwards."""
    for kept in list(_STORED):
        try:
            if kept.spark.sparkContext._jsc is not None:
                kept.drop()
        except Exception:  # the session is gone; the cluster's own clean-up has to do
            _STORED.discard(kept)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet (typed, compressed, with statistics) and read again."""
    return Stored(df).df
