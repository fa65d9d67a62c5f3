"""Session helpers: durable scratch space, lineage cuts and table readers."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hint only when a count shows it has at most this many narrow rows.
BROADCAST_ROWS = 200_000


def scratch(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset and the master is local
    (tests) a folder of this machine is used; elsewhere RuntimeError is raised.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestar-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder and drops its lineage; it survives lost executors."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Deletes the files of frames that cut() made. Nothing may read them again, not even lazily.

    Shuffle files go with them: Spark deletes those of plans that nothing refers to any more, but only when
    the driver happens to collect its garbage, and a driver with little to do holds those of many rounds.
    """
    for df in frames:
        context = df.sparkSession.sparkContext
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        gc.collect()
        frames[0].sparkSession.sparkContext._jvm.System.gc()


def together(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt so that a task has all rows of equal keys, for functions that run over a task's rows.

    Dealt by a hash of the keys, not by the keys: Spark leaves a repartition out where the rows seem to lie
    by these keys already, and may then read a side of a union or join as it was written.
    """
    return rows.repartition(F.xxhash64(*keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
