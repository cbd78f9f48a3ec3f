"""Tables stored in buckets of their keys, so that joins and groups on these keys read them without an exchange."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Files of a bucket, so that a key with many rows is written by several tasks.
FILES_PER_BUCKET = 4


def _table_name(path: str) -> str:
    return "layout_" + hashlib.sha256(path.encode()).hexdigest()[:32]


def _quoted(names: Sequence[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "`" for n in names)


def _layout_path(path: str) -> str:
    return f"{path.rstrip('/')}.layout"


def write_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 512, files: int = FILES_PER_BUCKET) -> DataFrame:
    """Store a table below `path` in buckets by the hash of its keys and read it back as such.

    Rows move once: a task writes a share of one bucket, so a bucket has at most `files` files, however many rows its
    keys own.  Tables that are to be joined take the same keys, in one order, and the same number of buckets.  Rows with
    null keys share a bucket.  A key that holds much of all rows makes one large bucket, which one task joins: for such
    joins read the files as plain Parquet, and adaptive execution splits the key behind an exchange.
    """
    spark, keys, path = df.sparkSession, list(keys), path.rstrip("/")
    if not keys or buckets < 1 or files < 1:
        raise ValueError("buckets need keys and positive numbers")
    bucket = F.pmod(F.hash(*keys), F.lit(buckets))
    share = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(files))
    rows = df.repartition(buckets * files, bucket, share) if files > 1 else df.repartition(buckets, *keys)
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    # beside the data, so that other sessions can read the buckets as such
    layout = json.dumps({"keys": keys, "buckets": buckets, "schema": df.schema.jsonValue()})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.mode("overwrite").text(_layout_path(path))
    return spark.table(name)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """A table stored by `write_buckets`, also by another session.

    With one key, a filter on a list of its values reads the buckets of these values alone.
    """
    from pyspark.sql.types import StructType

    path = path.rstrip("/")
    layout = json.loads(spark.read.text(_layout_path(path)).first()["value"])
    fields = StructType.fromJson(layout["schema"]).fields
    columns = ", ".join(f"{_quoted([f.name])} {f.dataType.simpleString()}" for f in fields)
    keys, name = _quoted(layout["keys"]), _table_name(path)
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{where}'")
    return spark.table(name)
