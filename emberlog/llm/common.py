"""What the corpus operators share: table access, written intermediates and word rules."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in the syntax that Java, Python and RE2 share: no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary
    folder is made, set as the session's checkpoint folder, and removed at exit; on
    a cluster that would not be shared, and is an error.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="emberlog-")
        atexit.register(shutil.rmtree, given, True)
        spark.sparkContext.setCheckpointDir(given)
        given = spark.sparkContext.getCheckpointDir()
    return given.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """Where this application writes its intermediates."""
    return f"{shared_dir(spark)}/emberlog-{spark.sparkContext.applicationId}"


#: Rows of one number that may go to every executor.
BROADCAST_ROWS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """Written rows of one number, to be broadcast if they are no more than BROADCAST_ROWS (8 MB)."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of results that are written and no longer referred to.

    It does so when the driver's garbage collector meets them, which by itself may
    be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, what: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage as ``checkpoint()`` does, and survives lost executors, but
    in compressed columns, and a join planned on it knows its size.  The files lie
    in a folder of the application's own, to be removed once it has ended: results
    that were not read yet need them.
    """
    path = f"{application_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if free:
        release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
