"""Source and sink queries: tables go out and come back through the readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.session import shared_folder
from gapline.sources import layout, readers, versions, writers
from gapline.suite.registry import query, table


@query("S01 S02 S03 S15 P47", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def csv_round_trip(spark, d):
    """CSV out and back; wanted columns that exist are read, with declared types."""
    path = writers.write_csv(table(spark, d, "orders"), f"{shared_folder(spark)}/orders.csv")
    schema = (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate STRING, "
        "o_orderpriority STRING"
    )
    return readers.read_csv(spark, path, ["o_orderkey", "o_custkey", "o_totalprice", "not_there"], schema)


@query("S04", "SELECT CAST(least(100, count(*)) AS BIGINT) AS n_rows, CAST(least(100, count(*)) AS BIGINT) AS n_whole FROM orders")
def csv_preview(spark, d):
    """The preview reader keeps n rows of a file, as text; each of them is a whole row of the table."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = writers.write_csv(rows, f"{shared_folder(spark)}/orders.csv")
    preview = readers.read_csv(spark, path, rows=100)
    whole = preview.join(rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]).distinct().withColumn("known", F.lit(1)), rows.columns, "left")
    return whole.agg(F.count(F.lit(1)).alias("n_rows"), F.count("known").alias("n_whole"))


@query("S05 S18", "SELECT o_orderkey, CAST(NULL AS INT) AS label FROM orders")
def optional_source(spark, d):
    """A missing label file joins as an empty table with its columns."""
    labels = readers.read_optional(spark, f"{shared_folder(spark)}/none.csv", "o_orderkey BIGINT, label INT")
    kept = f"{shared_folder(spark)}/labels.parquet"
    labels = spark.read.parquet(writers.write_parquet(labels, kept))
    return table(spark, d, "orders").select("o_orderkey").join(labels, "o_orderkey", "left")


@query("S06 S07 S08 S09", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_suppkey = 7 AND l_linenumber = 3")
def parquet_pruned(spark, d):
    """Wanted columns and a key predicate reach the scan."""
    path = f"{d}/lineitem.parquet"
    wanted = [c for c in ("l_orderkey", "l_quantity", "l_suppkey", "l_linenumber", "absent")
              if c in readers.parquet_columns(spark, path)]
    rows = readers.read_parquet(spark, path, wanted).filter("l_suppkey = 7 AND l_linenumber = 3")
    return rows.select("l_orderkey", "l_quantity")


@query("S10 U01 P09", """SELECT event_id, ts, user_id, value FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END, user_id, NULL FROM events WHERE event_id % 2 = 1""")
def multi_part_scan(spark, d):
    """A Parquet and a CSV part of the same table; unreadable times become null, missing columns too."""
    rows = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    base = shared_folder(spark)
    one = writers.write_parquet(rows.filter("event_id % 2 = 0").drop("event_type"), f"{base}/a.parquet")
    text = F.when(F.col("event_type") == "error", "soon").otherwise(F.col("ts").cast("string"))
    other = rows.filter("event_id % 2 = 1").select("event_id", text.alias("ts"), "user_id")
    two = writers.write_csv(other, f"{base}/b.csv")
    return readers.read_parts(spark, [one, two], ["event_id", "ts", "user_id"], ["ts"])


@query("S11 P06 P10", """SELECT event_id, CAST(user_id AS VARCHAR) AS hashed_mother_id,
  date_trunc('second', ts) AS event_time_abs FROM events WHERE event_type <> 'error'""")
def timeline_load(spark, d):
    rows = table(spark, d, "events")
    text = F.when(F.col("event_type") == "error", "unknown").otherwise(F.col("ts").cast("string"))
    stored = rows.select("event_id", F.col("user_id").alias("hashed_mother_id"), text.alias("event_time_abs"))
    path = writers.write_parquet(stored, f"{shared_folder(spark)}/timeline.parquet")
    return readers.read_timeline(spark, path)


@query("S12 J09", """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def keep_list_file(spark, d):
    """Ids padded with blanks in a CSV of another column name."""
    ids = table(spark, d, "customer").select(
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit(" "), F.col("c_custkey"), F.lit(" "))).otherwise(" ").alias("id")
    )
    path = writers.write_csv(ids, f"{shared_folder(spark)}/keep.csv")
    kept = readers.read_keep_list(spark, path).select(F.col("hashed_mother_id").cast("long").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(kept, "o_custkey", "left_semi").drop("o_custkey")


@query("S13", "SELECT l_quantity, l_tax FROM lineitem")
def column_list_file(spark, d):
    """A stored JSON list of names drives the next read."""
    path = writers.write_column_list(spark, ["l_tax", "l_quantity"], f"{shared_folder(spark)}/columns", ordered=False)
    return readers.read_parquet(spark, f"{d}/lineitem.parquet", readers.read_column_list(spark, path))


@query("S14 S16 S17", """SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey""")
def stored_step(spark, d):
    """A step is made once, read from its files the second time, and can be replaced as a folder or as a new version."""
    base = shared_folder(spark)

    def make():
        return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))

    first = writers.materialize(spark, f"{base}/step.parquet", make)
    again = writers.materialize(spark, f"{base}/step.parquet", make)
    assert first.inputFiles() == again.inputFiles()
    plain = spark.read.parquet(writers.replace_parquet(spark, again, f"{base}/final.parquet"))
    versions.write_version(spark, plain.filter("l_suppkey < 0"), f"{base}/table")
    versions.write_version(spark, versions.read_version(spark, f"{base}/table").unionByName(plain), f"{base}/table")
    return versions.read_version(spark, f"{base}/table")


@query("S09 S14 J09", """SELECT o.o_custkey, c.c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE c.c_custkey IN (SELECT user_id FROM events) GROUP BY o.o_custkey, c.c_mktsegment""")
def bucketed_tables(spark, d):
    """Tables stored in buckets of the customer: two joins and a group on it without an exchange."""
    base = shared_folder(spark)
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    kept = table(spark, d, "events").select(F.col("user_id").alias("o_custkey")).distinct()
    stored = [layout.write_buckets(t, f"{base}/{n}", ["o_custkey"], 16) for n, t in (("orders", orders), ("customers", customers), ("kept", kept))]
    rows = stored[0].join(layout.read_buckets(spark, f"{base}/customers"), "o_custkey").join(stored[2], "o_custkey", "left_semi")
    return rows.groupBy("o_custkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("S19 S20", """SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment""")
def json_report(spark, d):
    report = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    path = writers.write_json(report, f"{shared_folder(spark)}/report")
    return spark.read.schema("segment STRING, n BIGINT").json(path)
