"""Row-wise clean-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.functions import clock, scalar
from gapline.operators import reshape
from gapline.sources.readers import strict_label_times
from gapline.suite.registry import query, table
from gapline.suite.timeline import events

RANGES = {"view": (5, 150), "click": (10, 90), "purchase": (0.5, 60)}


@query("P16 P03", """SELECT event_id, event_type AS signal, CASE
  WHEN event_type = 'view' THEN CASE WHEN value BETWEEN 5 AND 150 THEN value END
  WHEN event_type = 'click' THEN CASE WHEN value BETWEEN 10 AND 90 THEN value END
  WHEN event_type = 'purchase' THEN CASE WHEN value BETWEEN 0.5 AND 60 THEN value END
  ELSE value END AS value FROM events""")
def plausibility_mask(spark, d):
    rows = events(spark, d).select("event_id", F.col("event_type").alias("signal"), "value")
    return reshape.mask_implausible_long(rows, RANGES)


@query("P17", """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 500 AS sys, l_quantity * 2 AS dia, l_suppkey % 90 AS pulse FROM lineitem),
x AS (SELECT *, dia + (sys - dia) / 3 AS m, CASE WHEN sys <> 0 THEN pulse / sys END AS s, sys - dia AS p FROM r)
SELECT l_orderkey, l_linenumber, round(CASE WHEN m BETWEEN 40 AND 170 THEN m END, 6) AS map,
  round(CASE WHEN s BETWEEN 0.2 AND 3.5 THEN s END, 6) AS si, round(CASE WHEN p BETWEEN 10 AND 150 THEN p END, 6) AS pp FROM x""")
def derived_signals(spark, d):
    from gapline.config import DERIVED_PLAUSIBLE as bounds

    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 500).alias("sys"), (F.col("l_quantity") * 2).alias("dia"),
        (F.col("l_suppkey") % 90).alias("pulse"),
    )
    return rows.select(
        "l_orderkey", "l_linenumber",
        F.round(scalar.within(scalar.mean_pressure("sys", "dia"), bounds["MAP"]), 6).alias("map"),
        F.round(scalar.within(scalar.shock_index("pulse", "sys"), bounds["SI"]), 6).alias("si"),
        F.round(scalar.within(scalar.pulse_pressure("sys", "dia"), bounds["PP"]), 6).alias("pp"),
    )


@query("P14", """SELECT p_partkey, CASE WHEN upper(p_name) LIKE '%RING%' THEN 'RINGS'
  WHEN upper(p_name) LIKE '%RED%' AND upper(p_name) LIKE '%GEAR%' THEN 'RED_GEAR'
  WHEN upper(p_name) LIKE '%WIDGET%' OR upper(p_name) LIKE '%GIZMO%' THEN 'SMALL_PARTS' END AS kind FROM part
WHERE upper(p_name) LIKE '%RING%' OR (upper(p_name) LIKE '%RED%' AND upper(p_name) LIKE '%GEAR%')
  OR upper(p_name) LIKE '%WIDGET%' OR upper(p_name) LIKE '%GIZMO%'""")
def drug_classifier(spark, d):
    rules = (("RINGS", (("RING",),)), ("RED_GEAR", (("RED", "GEAR"),)), ("SMALL_PARTS", (("WIDGET",), ("GIZMO",))))
    rows = table(spark, d, "part").select("p_partkey", scalar.first_match("p_name", rules).alias("kind"))
    return rows.filter("kind IS NOT NULL")


@query("P15", """SELECT doc_id, CAST(contains(lower(text), 'license') OR contains(lower(text), 'elle') AS INT) AS dose,
  CAST(contains(lower(text), 'plasma') OR contains(lower(text), 'the ') AS INT) AS product FROM documents
WHERE contains(lower(text), 'license') OR contains(lower(text), 'elle') OR contains(lower(text), 'plasma') OR contains(lower(text), 'the ')""")
def transfusion_flags(spark, d):
    """Word flags over whole texts; rows with neither are dropped."""
    rows = table(spark, d, "documents").select(
        "doc_id", scalar.contains_any("text", ("license", "elle")).alias("dose"),
        scalar.contains_any("text", ("plasma", "the ")).alias("product"),
    )
    return rows.filter("dose = 1 OR product = 1")


_TEXT = """CASE l_linenumber % 7 WHEN 0 THEN CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_linenumber * 9 AS VARCHAR)
  WHEN 1 THEN CAST(l_suppkey % 30 AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':30'
  WHEN 2 THEN CAST(l_suppkey AS VARCHAR) WHEN 3 THEN CAST(l_suppkey % 60 AS VARCHAR) || ':13,5'
  WHEN 4 THEN 'x' || CAST(l_suppkey AS VARCHAR) WHEN 5 THEN '' ELSE '1:2:3:4' END"""


@query("P21", f"""WITH t AS (SELECT l_orderkey, l_linenumber, {_TEXT} AS txt FROM lineitem),
s AS (SELECT *, str_split(replace(trim(txt), ',', '.'), ':') AS p FROM t),
n AS (SELECT *, len(p) AS k, TRY_CAST(p[1] AS DOUBLE) AS a, TRY_CAST(p[2] AS DOUBLE) AS b, TRY_CAST(p[3] AS DOUBLE) AS c FROM s)
SELECT DISTINCT txt, round(CASE WHEN k = 3 THEN a * 60 + b + c / 60 WHEN k = 2 AND a >= 24 AND b < 60 THEN a + b / 60
  WHEN k = 2 THEN a * 60 + b WHEN k = 1 THEN a END, 6) AS minutes FROM n""")
def duration_minutes(spark, d):
    rows = table(spark, d, "lineitem").select(F.expr(_TEXT.replace("VARCHAR", "STRING")).alias("txt"))
    return rows.select("txt", F.round(scalar.duration_minutes("txt"), 6).alias("minutes")).distinct()


@query("P26 P13", r"""SELECT DISTINCT p_brand, p_type, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(
  upper(trim('  ' || p_brand || ' - ' || p_type || '%% (' || p_name || ')')), '[^0-9A-Za-z_+]+', '_', 'g'), '_+', '_', 'g'), '_'), 1, 80), ''),
  'unknown') AS safe FROM part""")
def safe_name(spark, d):
    raw = F.concat(F.lit("  "), "p_brand", F.lit(" - "), "p_type", F.lit("%% ("), "p_name", F.lit(")"))
    rows = table(spark, d, "part").select("p_brand", "p_type", scalar.safe_name(F.upper(raw)).alias("safe"))
    return rows.distinct()


@query("P12 P13", """SELECT event_id, CASE event_type WHEN 'view' THEN 'sistol' WHEN 'click' THEN 'diastol' ELSE event_type END AS name
FROM events WHERE event_type IN ('view', 'click', 'error')""")
def rename_values(spark, d):
    """Dictionary names with passthrough, then the wanted ones."""
    rows = events(spark, d).select(
        "event_id", scalar.translate("event_type", {"view": "sistol", "click": "diastol"}).alias("name")
    )
    return rows.filter(F.col("name").isin("sistol", "diastol", "error"))


@query("P10 P11", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.01
  AND coalesce(CASE WHEN l_linestatus = 'F' THEN l_linenumber % 2 END, 0) = 0""")
def quality_filter(spark, d):
    """Missing values go, flagged rows go, a missing flag counts as unflagged."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("value"),
        F.when(F.col("l_linestatus") == "F", F.col("l_linenumber") % 2).alias("flag"),
    )
    rows = rows.dropna(subset=["value"]).filter(F.coalesce("flag", F.lit(0)) == 0)
    return rows.select("l_orderkey", "l_linenumber")


@query("P03 P04", """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS good,
  CASE l_linenumber % 4 WHEN 0 THEN CAST(l_tax AS VARCHAR) WHEN 1 THEN 'nan' WHEN 2 THEN 'n/a' ELSE ' 7 ' END AS mixed FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(good AS DOUBLE) AS strict, CASE WHEN mixed <> 'nan' THEN TRY_CAST(trim(mixed) AS DOUBLE) END AS lenient FROM t""")
def numeric_casts(spark, d):
    n = F.col("l_linenumber") % 4
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("good"),
        F.when(n == 0, F.col("l_tax").cast("string")).when(n == 1, "nan").when(n == 2, "n/a").otherwise(" 7 ").alias("mixed"),
    )
    return rows.select(
        "l_orderkey", "l_linenumber", scalar.strict_double("good").alias("strict"),
        scalar.lenient_double("mixed").alias("lenient"),
    )


@query("P05 P06 P07 P08 P09", """SELECT event_id, ts AS main, date_trunc('second', ts) AS second,
  CASE WHEN event_type <> 'view' THEN ts END AS exact, ts AS label,
  CASE WHEN event_type <> 'click' THEN ts END AS lenient FROM events""")
def timestamp_parsing(spark, d):
    """One text per format and reader."""
    kind, iso = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows = events(spark, d).select(
        "event_id", F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("main"), iso.alias("iso"),
        F.when(kind == "view", F.replace(iso, F.lit(" "), F.lit("T"))).otherwise(iso).alias("gated"),
        F.when(kind == "click", "today").otherwise(iso).alias("mixed"),
    )
    rows = strict_label_times(rows, "iso", "label")
    return rows.select(
        "event_id", clock.strict_timestamp("main").alias("main"), clock.second_timestamp("iso").alias("second"),
        clock.two_format_timestamp("gated").alias("exact"), "label", clock.lenient_timestamp("mixed").alias("lenient"),
    )


@query("P23 P46", """WITH t AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN ' Female' WHEN 'O' THEN 'm'
  ELSE CASE o_orderkey % 3 WHEN 0 THEN 'נקבה' WHEN 1 THEN 'זכר ' ELSE '?' END END AS g,
  CASE o_orderkey % 3 WHEN 0 THEN 'כן' WHEN 1 THEN 'לא' ELSE 'אולי' END AS yn FROM orders)
SELECT o_orderkey, CASE WHEN lower(trim(g)) LIKE 'f%' OR g LIKE '%נקבה%' THEN 0.0::DOUBLE WHEN lower(trim(g)) LIKE 'm%' OR g LIKE '%זכר%' THEN 1.0::DOUBLE END AS gender,
  CASE yn WHEN 'כן' THEN 1 WHEN 'לא' THEN 0 END AS y FROM t""")
def token_codes(spark, d):
    """Gender texts and yes/no tokens to numbers."""
    from gapline.config import NO_TOKEN, YES_TOKEN

    k = F.col("o_orderkey") % 3
    other = F.when(k == 0, "נקבה").when(k == 1, "זכר ").otherwise("?")
    gender = F.when(F.col("o_orderstatus") == "F", " Female").when(F.col("o_orderstatus") == "O", "m").otherwise(other)
    token = F.when(k == 0, "כן").when(k == 1, "לא").otherwise("אולי")
    rows = table(spark, d, "orders").select("o_orderkey", gender.alias("g"), token.alias("yn"))
    return rows.select(
        "o_orderkey", scalar.gender_code("g").alias("gender"), scalar.yes_no("yn", YES_TOKEN, NO_TOKEN).alias("y")
    )


@query("P42 P43 P44", """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_tax / l_discount AS FLOAT) END AS DOUBLE) AS ratio,
  CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS price FROM lineitem""")
def matrix_projection(spark, d):
    """Infinite ratios become null, cells have float precision."""
    from gapline.operators.matrix import project_matrix

    zero = F.col("l_discount") == 0
    ratio = F.when(zero, F.lit(float("inf"))).otherwise(F.try_divide("l_tax", "l_discount"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"), F.col("l_extendedprice").alias("price"))
    out = project_matrix(rows, ["ratio", "price"], ["l_orderkey", "l_linenumber"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("ratio", "price")})
