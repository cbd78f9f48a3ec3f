"""Bucketed tables: same rows, joins and groups without an exchange, lists of keys that read few buckets."""

import re

import pytest
from pyspark.sql import functions as F

from gapline.sources.layout import read_buckets, write_buckets


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def rows(spark):
    # entity 0 owns half of all rows; some have no entity
    e = F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 40)
    return spark.range(4000).select(
        e.cast("long").alias("entity"), (F.col("id") % 3).cast("int").alias("episode"), F.col("id").alias("a b"),
        F.array("id").alias("list"),
    )


def test_join_on_entity_and_episode_without_exchange(spark, rows, tmp_path, no_broadcast):
    keys = ["entity", "episode"]
    bounds = rows.groupBy(*keys).agg(F.max("a b").alias("top"))
    left = write_buckets(rows, f"{tmp_path}/rows", keys, 6)
    right = write_buckets(bounds, f"{tmp_path}/bounds", keys, 6)
    joined = left.join(right, keys)
    assert "Exchange" not in plan_of(joined)
    assert "Exchange" not in plan_of(joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    assert "Exchange" in plan_of(rows.join(bounds, keys))
    want = rows.join(bounds, keys)
    assert sorted(map(tuple, joined.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert left.filter("entity IS NULL").count() == rows.filter("entity IS NULL").count() > 0


def test_key_list_reads_its_buckets_only(spark, rows, tmp_path):
    path = f"{tmp_path}/rows"
    write_buckets(rows, path, ["entity"], 16, files=3)
    table = read_buckets(spark, path)
    kept = table.filter(F.col("entity").isin(3, 5))
    found = re.search(r"SelectedBucketsCount: (\d+) out of 16", plan_of(kept.groupBy("entity").count()))
    assert found and int(found.group(1)) <= 2
    assert kept.count() == rows.filter("entity IN (3, 5)").count()
    per_bucket = {}
    for f in table.inputFiles():
        bucket = re.search(r"_(\d{5})\.c", f).group(1)
        per_bucket[bucket] = per_bucket.get(bucket, 0) + 1
    assert max(per_bucket.values()) == 3  # the hot bucket is shared out


def test_rewrite_and_empty_table(spark, rows, tmp_path):
    path = f"{tmp_path}/rows"
    write_buckets(rows, path, ["entity"], 4)
    write_buckets(rows.select("entity", F.lit("x").alias("new")).limit(0), path, ["entity"], 8)
    again = read_buckets(spark, path)
    assert again.columns == ["entity", "new"] and again.count() == 0
    with pytest.raises(ValueError):
        write_buckets(rows, path, [])
