"""Versioned tables: data folders, one manifest per version, the newest manifest is the table.

A version is published by renaming a complete manifest to the next free number, which fails if another writer took it
(`FileContext.rename` without overwriting: one step of the name node on HDFS, checked and renamed on a local disk); the
writer then takes the number after it.  A reader that lists the manifests always finds a whole version, during a write as
well as after a writer that died.  Stores without a rename need a table format instead.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = re.compile(r"manifest-(\d{12})\.json")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(df: DataFrame) -> str:
    """sha256 of the whole plan and of path, length and modification time of every input file."""
    spark = df.sparkSession
    digest = hashlib.sha256(f"{df._jdf.queryExecution().analyzed().canonicalized().toString()}\n{df.semanticHash()}\n".encode())
    names = sorted(df.inputFiles())
    for folder in sorted({n.rsplit("/", 1)[0] for n in names}):
        known = set(names)
        states = [(s.getPath().toUri().getRawPath(), s.getLen(), s.getModificationTime()) for s in _files(spark, folder).listStatus(_path(spark, folder))]
        ends = {re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", n) for n in known}
        for state in sorted(s for s in states if s[0] in ends):
            digest.update(repr(state).encode())
    return digest.hexdigest()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions, oldest first."""
    files = _files(spark, path)
    if not files.exists(_path(spark, path)):
        return []
    found = (MANIFEST.fullmatch(s.getPath().getName()) for s in files.listStatus(_path(spark, path)))
    return sorted(int(m.group(1)) for m in found if m)


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    stream = _files(spark, path).open(_path(spark, f"{path}/manifest-{version:012d}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, entry: dict, version: int) -> int:
    """Give the entry the first free number from `version` on."""
    waiting = f"{path}/.waiting-{uuid.uuid4().hex}"
    stream = _files(spark, path).create(_path(spark, waiting), False)
    stream.write(bytearray(json.dumps(entry).encode()))
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_files(spark, path).getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    while True:
        try:
            context.rename(_path(spark, waiting), _path(spark, f"{path}/manifest-{version:012d}.json"), options)
            return version
        except Exception as error:  # the number is taken
            if "FileAlreadyExists" not in str(error):
                raise
            version += 1


def write_version(spark: SparkSession, df: DataFrame, path: str, mark: str | None = None) -> int:
    """Store the table as a new version of `path` and publish it; its number comes back.  `df` may read an older one."""
    path = path.rstrip("/")
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    return _publish(spark, path, {"data": data, "fingerprint": mark}, max(versions(spark, path), default=0) + 1)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the table, the newest one by default."""
    path = path.rstrip("/")
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{path} has no version {'' if version is None else version}".rstrip())
    return spark.read.parquet(f"{path}/{manifest(spark, path, known[-1] if version is None else version)['data']}")


def find_version(spark: SparkSession, path: str, mark: str) -> int | None:
    """The newest version with this fingerprint."""
    for version in reversed(versions(spark, path.rstrip("/"))):
        if manifest(spark, path.rstrip("/"), version)["fingerprint"] == mark:
            return version
    return None


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest versions: their manifests first, then their data.  Readers of those must have ended."""
    path = path.rstrip("/")
    files = _files(spark, path)
    for version in versions(spark, path)[: -keep or None]:
        data = manifest(spark, path, version)["data"]
        files.delete(_path(spark, f"{path}/manifest-{version:012d}.json"), False)
        files.delete(_path(spark, f"{path}/{data}"), True)
