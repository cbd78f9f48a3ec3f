"""Sinks: Parquet, CSV, JSON reports, stored steps and replacement of stored tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from gapline.sources.versions import find_version, fingerprint, read_version, write_version


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """Reports and codebooks, one object per line."""
    df.write.mode("overwrite").json(path)
    return path


def write_column_list(spark: SparkSession, columns: Sequence[str], path: str, ordered: bool = True) -> str:
    """Names as one JSON array, in order or sorted."""
    names = list(columns) if ordered else sorted(columns)
    spark.createDataFrame([(json.dumps(names),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def materialize(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """A stored step: read the version that the same plan on the same files has stored here, else write one and read it.

    The manifest of a version carries the fingerprint of the plan (inputs, settings and operators) and of its input files
    (path, length, time), so a changed input or another plan under the same path is never answered from an old step.  The
    written table cuts the lineage and survives lost executors.
    """
    made = make()
    mark = fingerprint(made)
    version = None if force else find_version(spark, path, mark)
    if version is None:
        version = write_version(spark, made, path, mark)
    return read_version(spark, path, version)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of stored steps."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def replace_parquet(spark: SparkSession, df: DataFrame, path: str) -> str:
    """Write beside the target, move the old table aside, move the new one in, then delete the old one.

    For tables that other programs read as a plain folder.  A table is complete whenever it is there, and a failure puts
    the old one back, but between the two renames a reader may find none; `versions.write_version` has no such moment.
    """
    path = path.rstrip("/")
    mark = uuid.uuid4().hex
    new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    write_parquet(df, new)
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(to_path(path))
    if had and not fs.rename(to_path(path), to_path(old)):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(to_path(new), to_path(path)):
        if had:
            fs.rename(to_path(old), to_path(path))
        raise OSError(f"could not replace {path}")
    if had:
        fs.delete(to_path(old), True)
    return path
