"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a local session has none, a temporary one. On a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cliploom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def mounted_dir(spark: SparkSession) -> str:
    """The same as a path for programs that know no stores but folders."""
    folder = shared_dir(spark)
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"{folder} is no folder that can be opened; files can be written into mounted folders only")
    return folder.removeprefix("file://").removeprefix("file:")


_written: list[tuple[DataFrame, str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage. It is emptied when the program ends."""
    path = f"{shared_dir(df.sparkSession)}/cliploom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written.append((out, path))
    return out


def release() -> None:
    """Empty all tables that :func:`cut` wrote. DataFrames that read them can't be used any more."""
    while _written:
        table, path = _written.pop()
        try:
            table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)
        except Exception:  # the session has ended: the folder goes with the cluster's clean-up
            _written.clear()


atexit.register(release)
