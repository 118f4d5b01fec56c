"""Cutting the lineage of iterative plans through the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set a session on one machine gets a new
    temporary folder; on a cluster its executors would not share one, so that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: survives lost executors, unlike a local one."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_to_table(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written as Parquet to the shared folder and reread, and a function that deletes the table.

    Columns make it a fraction of a checkpoint's size. What is not deleted by its user goes when
    the program ends.
    """
    spark = df.sparkSession
    path = f"{_checkpoint_folder(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)

    def drop() -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    atexit.register(drop)
    return spark.read.parquet(path), drop
