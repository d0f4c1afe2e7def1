"""Tables and folders that driver and executors share, below spark.checkpoint.dir; they go when the program ends."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tracelake-")
        sc.setCheckpointDir(named)
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        return sc.getCheckpointDir()
    return named


def fixed(df: DataFrame) -> DataFrame:
    """df as a written table: what it holds is computed once, whatever is read from it later."""
    spark = df.sparkSession
    path = f"{_root(spark)}/fixed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def folder(spark: SparkSession, name: str = "files") -> str:
    """A new folder for files that aren't tables; it has to be on a file system that all machines mount."""
    made = os.path.join(_root(spark).removeprefix("file:").replace("///", "/"), f"{name}-{uuid.uuid4().hex}")
    if "://" in made:
        raise ValueError(f"{made}: files are written to mounted folders only")
    os.makedirs(made, exist_ok=True)
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made
