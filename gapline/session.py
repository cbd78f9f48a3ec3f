"""Session settings the operators rely on."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where the split costs a later shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: Shuffled MB that one task gets at most, where there are partitions enough.  Window stages sort up to 104
#: times what they read (7.0 MB read, 726 MB sorted in `lookback_features`), so Spark's 64 MB would be 6.7 GB of a task.
TASK_MB = 12


def _mb(text: str) -> float:
    """MB of a size setting; without a unit it counts bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", text.strip().lower()).groups()
    power = {"": 0, "b": 0, "k": 1, "m": 2, "g": 3, "t": 4}[unit[:1]]
    return int(number) * 1024.0**power / 1024**2


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings (all of them may change in a live session); smaller tasks than ours stay."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if _mb(spark.conf.get(advisory)) > TASK_MB:
        spark.conf.set(advisory, f"{TASK_MB}m")
    return spark


def local_session(app: str = "gapline", cpus: str | None = None) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.default.parallelism", str(cpus))
        # keep all cores busy on small shuffles
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        # no call-site capture for every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder.

    The folder is the setting `spark.checkpoint.dir`.  Where it is unset, a run on one machine gets a temporary folder;
    on a cluster that is an error, as executors would not see each other's files.
    """
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/gapline-{uuid.uuid4().hex}"
