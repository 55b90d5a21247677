"""Tables that survive a lost executor: written to the shared checkpoint folder and read again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH, _OWN = "spark.utterlode.scratch", "spark.utterlode.folder"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``); a temporary one only where that is unset and driver and
    executors are one process, as in tests. Elsewhere each executor would write to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_SCRATCH, None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='utterlode-')}"
        spark.conf.set(_SCRATCH, folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This session's part of the shared folder; it is removed when the driver ends."""
    folder = spark.conf.get(_OWN, None)
    if not folder:
        folder = f"{shared_folder(spark)}/utterlode/{uuid.uuid4().hex}"
        spark.conf.set(_OWN, folder)
        path, files = _files(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet and read back: later plans start from the files and never recompute it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._utterlode_path = path
    return back


def discard(df: DataFrame) -> None:
    """Remove the files of a ``saved`` table that nothing reads any more."""
    if path := getattr(df, "_utterlode_path", None):
        where, files = _files(df.sparkSession, path)
        files.delete(where, True)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of plans that nothing refers to any more, which else wait for the driver's heap to fill."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Remove all tables that this session saved; results that still read them are lost."""
    if folder := spark.conf.get(_OWN, None):
        path, files = _files(spark, folder)
        files.delete(path, True)
        spark.conf.unset(_OWN)
