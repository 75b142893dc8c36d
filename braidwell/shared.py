"""The folder that driver and executors share, named by the cluster in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. On one machine, where none is named (tests), a fresh one is set; on a cluster a
    folder of the driver's machine would be no shared one, so there it has to be named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="braidwell-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its files have fewer splits than that: one small file is otherwise one
    task, whatever is computed from its texts. Tables of many splits, so all large ones, stay as they are. Filters
    and column pruning still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


_saved: dict[str, SparkSession] = {}


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read as a scan: what several steps read is computed once, and a lost
    executor doesn't lose it. Saved tables last as long as the process, since results read them lazily."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _saved[path] = spark
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _at_exit() -> None:
    for path, spark in _saved.items():
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        elif path.startswith("file:"):  # the session ended before the process
            shutil.rmtree(urlparse(path).path, ignore_errors=True)
