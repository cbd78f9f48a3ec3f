"""Shared helpers: reading tables, storing steps in the shared folder, ASCII word splitting."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gapline.session import shared_folder

#: Batches handed to Python stay small, also for long texts.
ARROW_ROWS = 256
#: Rows of a batch that holds a few numbers each.
NARROW_ROWS = 50_000
ASCII_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch carries to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


@contextmanager
def narrow_rows(spark: SparkSession, rows: int = NARROW_ROWS):
    """Larger Arrow batches for what runs inside: rows of a few numbers, not texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def free_shuffles(spark: SparkSession):
    """What runs inside deletes its shuffle files at its end, for steps that are stored and never run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Steps:
    """Numbered Parquet steps in one new folder below the cluster's checkpoint folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, shared_folder(spark), 0

    def store(self, df: DataFrame) -> DataFrame:
        """Write, then read back: lineage ends here and a lost executor costs its own tasks only."""
        self.n += 1
        path = f"{self.folder}/step{self.n}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, stored: DataFrame) -> None:
        """Delete a stored step that nothing reads any more."""
        for file in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
            if self.folder.rsplit("/", 1)[-1] in file:
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, a null as the empty text."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def add_struct(df: DataFrame, text: str, name: str, fields: str, compute: Callable[..., list[list]], earlier: str | None = None) -> DataFrame:
    """Add one struct column that `compute` makes from the texts of a batch: one list per field.

    The other columns pass through untouched, in the batches as they come: no shuffle, one batch in memory.  `earlier`
    names a struct column that `compute` gets as well (a list of dicts) and that the new column replaces.
    """
    kind = T.StructType.fromDDL(fields)
    columns = [c for c in df.columns if c != earlier]
    spark_type = T.StructType([*[df.schema[c] for c in columns], T.StructField(name, kind, False)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in kind]
        names = [f.name for f in kind]
        for batch in batches:
            texts = text_bytes(batch.column(text))
            made = compute(texts, batch.column(earlier).to_pylist()) if earlier else compute(texts)
            parts = [pa.array(values, t) for values, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.StructArray.from_arrays(parts, names)], [*columns, name]
            )

    return df.mapInArrow(run, spark_type)


def typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns in this order with these types."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
