"""Intermediate tables, written once to the folder that driver and tasks share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: the one that the cluster names in spark.checkpoint.dir, else, where driver and tasks
    are one process (as in tests), one of our own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir()


_folders: dict[str, SparkSession] = {}


def _delete(folder: str) -> None:
    spark = _folders.pop(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clean() -> None:
    for folder in list(_folders):
        try:
            _delete(folder)
        except Exception:  # noqa: BLE001  the session has ended, or the folder has gone
            continue


atexit.register(_clean)


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the cluster's shared folder; it goes with drop_folder(), or when the driver's Python ends."""
    folder = f"{shared_folder(spark)}/corpusloom-{uuid.uuid4().hex}"
    _folders[folder] = spark
    return folder


def drop_folder(folder: str) -> None:
    _delete(folder)


def saved(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the cluster's shared folder and read again: it cuts the lineage and survives lost
    executors. The folder goes with forget(), or when the driver's Python ends."""
    spark = df.sparkSession
    folder = new_folder(spark)
    df.write.option("compression", "zstd").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.saved_in = folder
    return out


def forget(df: DataFrame) -> None:
    """Deletes the folder of what saved() gave; nothing may read it any more."""
    _delete(df.saved_in)
