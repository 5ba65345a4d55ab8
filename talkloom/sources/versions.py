"""Folders that the whole cluster shares, and tables that are replaced version by version.

A versioned table is a folder with one folder for each version, named by its number, and a file CURRENT that names the
version to read. A version is written whole before CURRENT is replaced by one rename, so readers see the old version
or the new one, never a part; a version that is written twice, as a replayed batch does, is replaced as a whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which must be set to a folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir, when the session is built, to a folder that the whole cluster shares")
    return f"{found.rstrip('/')}/talkloom-{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, through Spark's own access to it."""
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def current(spark: SparkSession, path: str) -> int:
    """The version to read; -1 before the first one."""
    fs, at = _fs(spark, f"{path}/CURRENT")
    return int(spark.read.text(f"{path}/CURRENT").first()[0]) if fs.exists(at) else -1


def read(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame | None:
    """Table `name` of the current version, or of the one asked for; None before the first one."""
    version = current(spark, path) if version is None else version
    return spark.read.parquet(f"{path}/{version}/{name}") if version >= 0 else None


def write(df: DataFrame, path: str, version: int, name: str) -> DataFrame:
    """Puts a table into a version that nobody reads yet; returns it as read back."""
    df.write.mode("overwrite").parquet(f"{path}/{version}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{version}/{name}")


def publish(spark: SparkSession, path: str, version: int, keep: int = 3) -> None:
    """Makes a version the current one, and deletes those before the last `keep`, which slow readers may still read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, fresh = _fs(spark, f"{path}/CURRENT-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(str(version).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(at), options)
    names = [x.getPath().getName() for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path))]
    for old in sorted(int(n) for n in names if n.isdigit() and int(n) < version)[: -keep or None]:
        delete(spark, f"{path}/{old}")
