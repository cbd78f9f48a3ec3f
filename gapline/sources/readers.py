"""Tolerant readers: declared types, wanted columns, optional files, several parts."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from gapline.functions.clock import LABEL_FORMATS, lenient_timestamp, second_timestamp
from gapline.operators.columns import present


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_csv(
    spark: SparkSession, path, wanted: Sequence[str] | None = None, schema: StructType | str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """CSV with a header.  Without a schema all columns are text; wanted columns that are absent are skipped.

    `rows` keeps the first rows only (a preview).
    """
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    if wanted is not None:
        df = df.select(*[F.col(f"`{c}`") for c in present(df, wanted)])
    return df.limit(rows) if rows is not None else df


def read_parquet(spark: SparkSession, path, wanted: Sequence[str] | None = None) -> DataFrame:
    """Parquet; only wanted columns that exist reach the scan."""
    df = spark.read.parquet(path)
    return df if wanted is None else df.select(*[F.col(f"`{c}`") for c in present(df, wanted)])


def parquet_columns(spark: SparkSession, path) -> list[str]:
    """Column names from the file footers."""
    return spark.read.parquet(path).columns


def read_optional(spark: SparkSession, path: str | None, schema: StructType | str, fmt: str = "csv") -> DataFrame:
    """The table, or an empty one with the schema when there is no such file."""
    empty = spark.createDataFrame([], schema)
    if not path:
        return empty
    try:
        if fmt == "parquet":
            return spark.read.parquet(path)
        return spark.read.option("header", True).schema(empty.schema).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise


def read_parts(
    spark: SparkSession, paths: Sequence[str], needed: Sequence[str], times: Sequence[str] = ()
) -> DataFrame:
    """CSV and Parquet parts as one table; every part must have the needed columns, times are parsed leniently."""
    if not paths:
        raise ValueError("no parts given")
    parts = []
    for path in paths:
        kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
        if kind not in ("csv", "parquet"):
            raise ValueError(f"unsupported part: {path}")
        part = read_csv(spark, path) if kind == "csv" else spark.read.parquet(path)
        require(part, needed)
        types = dict(part.dtypes)
        parts.append(
            part.withColumns({c: lenient_timestamp(c) for c in times if not types[c].startswith("timestamp")})
        )
    types = {f.name: f.dataType for p in parts for f in p.schema.fields if not isinstance(f.dataType, StringType)}
    union = None
    for part in parts:
        part = part.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
                             for c in part.columns])
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return union


def read_timeline(spark: SparkSession, path: str, entity: str = "hashed_mother_id", ts: str = "event_time_abs") -> DataFrame:
    """Stored timeline: text ids, times cut to seconds, rows without a time dropped."""
    df = require(spark.read.parquet(path), [entity, ts])
    is_text = dict(df.dtypes)[ts] == "string"
    rows = df.withColumn(entity, F.col(entity).cast("string")).withColumn(ts, second_timestamp(ts, is_text))
    return rows.filter(F.col(ts).isNotNull())


def read_keep_list(spark: SparkSession, path: str, column: str = "hashed_mother_id") -> DataFrame:
    """Distinct trimmed ids of a CSV: the named column, else the first one."""
    df = read_csv(spark, path)
    name = column if column in df.columns else df.columns[0]
    return df.select(F.trim(F.col(f"`{name}`").cast("string")).alias(column)).filter(F.col(column) != "").distinct()


def read_column_list(spark: SparkSession, path: str) -> list[str]:
    """A JSON array of names."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def strict_label_times(df: DataFrame, text: str, out: str, formats: Sequence[str] = LABEL_FORMATS, shown: int = 5) -> DataFrame:
    """Parse with one of the formats; any other non-null value is an error that lists a few of them."""
    options = [F.try_to_timestamp(F.col(text), F.lit(f)).cast("timestamp_ntz") for f in formats]
    rows = df.withColumn(out, F.coalesce(*options))
    bad = rows.filter(F.col(out).isNull() & F.col(text).isNotNull()).select(text).limit(shown).collect()
    if bad:
        raise ValueError(f"{text}: no accepted format {tuple(formats)} for {[r[0] for r in bad]}")
    return rows
