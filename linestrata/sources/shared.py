"""Folders that driver and executors share, for results that are read again."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; on one machine, where it may be unset, a folder inside the warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


_made: list[str] = []


def new_folder(spark: SparkSession, name: str = "") -> str:
    """The path of a folder that isn't there yet; it is deleted by ``drop_folders``, or else when the program ends."""
    if not _made:
        atexit.register(_at_exit)
    _made.append(f"{shared_folder(spark)}/linestrata-{name}{uuid.uuid4().hex}")
    return _made[-1]


def drop_folders(spark: SparkSession, *paths: str) -> None:
    """Delete these folders, or all that were made; frames that read them can't be used any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths or tuple(_made):
        if path in _made:
            _made.remove(path)
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(conf).delete(there, True)


def made_folders() -> list[str]:
    return list(_made)


def _at_exit() -> None:
    if SparkContext._active_spark_context is not None:
        drop_folders(SparkSession.active())
