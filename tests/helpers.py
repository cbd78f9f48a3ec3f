"""Small fixtures and plain-Python versions of the rules, used as references."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
HOUR = 3_600_000_000


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(microseconds=round(seconds * 1e6))


def us(t: dt.datetime) -> int:
    return round((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)


def times(spark, rows, schema):
    """A table from rows; TIMESTAMP columns become naive."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def hot_rows(n: int = 600, seed: int = 1, spread: float = 400.0):
    """(id, seconds): entity 0 owns about half of all rows."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        entity = 0 if rng.random() < 0.5 else rng.randint(1, 9)
        out.append((entity, round(rng.random() * spread, 3) + k * 1e-6))
    return out


def window_reference(samples, grid, width, least=3, closed=False):
    """Statistics of g - w < t <= g by direct evaluation; samples are (seconds, value)."""
    out = {}
    for i, g in enumerate(grid):
        inside = sorted((t, float(np.float32(v))) for t, v in samples
                        if t <= g and (t >= g - width if closed else t > g - width))
        if not inside:
            continue
        t, v = np.array([x[0] for x in inside]), np.array([x[1] for x in inside])
        row = {"n": len(v), "last": v[-1], "min": v.min(), "max": v.max()}
        if len(v) >= max(2, least):
            tc = t - t.mean()
            row.update(
                mean=v.mean(), std=v.std(), median=float(np.median(v)), delta=v[-1] - v[0], delta_t=t[-1] - t[0],
                slope_linfit=float((tc * (v - v.mean())).sum() / (tc * tc).sum()),
            )
        out[i] = row
    return out
