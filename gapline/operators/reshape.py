"""Long and wide shapes of a timeline, deduplication and near-duplicate collapse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gapline.functions.clock import cell, from_micros, micros, second_us
from gapline.functions.scalar import nan_to_null, safe_name
from gapline.operators.blocks import block_rank, gap_cells, measured_slice, running_sum, sampled_block


def pivot_last(
    df: DataFrame, keys: Sequence[str], name: str, value: str, seq: str, values: Sequence[str] | None = None
) -> DataFrame:
    """Wide rows per key; of several values of one cell the last in `seq` order stays (null included).

    The declared `values` become columns; without them all names go into one map column `cells`, and no name reaches
    the driver.
    """
    cells = _declared(df, name, values).groupBy(*keys, name).agg(F.max_by(value, F.col(seq)).alias("_v"))
    return _spread(cells, keys, name, values)


def pivot_first(
    df: DataFrame, keys: Sequence[str], name: str, value: str, seq: str, values: Sequence[str] | None = None
) -> DataFrame:
    """Wide rows per key; the first non-null value of a cell in `seq` order stays.  Columns as in `pivot_last`."""
    order = F.when(F.col(value).isNotNull(), F.col(seq))
    cells = _declared(df, name, values).groupBy(*keys, name).agg(F.min_by(value, order).alias("_v"))
    return _spread(cells, keys, name, values)


def pivot_flags(df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str] | None = None) -> DataFrame:
    """Wide 0/1 columns: 1 where the key has a row with that name; without declared values a map `cells` of ones."""
    rows = _declared(df, name, values)
    if values is None:
        return _spread(rows.select(*keys, name).distinct().withColumn("_v", F.lit(1)), keys, name, None)
    return rows.groupBy(*keys).agg(*[F.max((F.col(name) == n).cast("int")).alias(n) for n in values])


def _declared(df: DataFrame, name: str, values: Sequence[str] | None) -> DataFrame:
    return df.filter(F.col(name).isNotNull() if values is None else F.col(name).isin(list(values)))


def _spread(cells: DataFrame, keys: Sequence[str], name: str, names: Sequence[str] | None) -> DataFrame:
    if names is None:
        return cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, "_v"))).alias("cells"))
    return cells.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == n, F.col("_v"))).alias(n) for n in names])


def assert_distinct_names(df: DataFrame, name: str) -> DataFrame:
    """The table itself, or an error with two source names that become the same column name."""
    safe = df.select(F.col(name).alias("_raw"), safe_name(name).alias("_safe"))
    bad = safe.groupBy("_safe").agg(F.min("_raw").alias("one"), F.max("_raw").alias("other")).filter("one <> other").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['one']!r} and {bad[0]['other']!r} both become the column {bad[0]['_safe']!r}")
    return df


def outer_merge(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of wide tables with unique keys, done as one union and one aggregation."""
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in keys]
    return union.groupBy(*keys).agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in rest])


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "signal", value: str = "value") -> DataFrame:
    """Wide to long; null and NaN cells are dropped."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias(name), nan_to_null(F.col(f"`{c}`").cast("double")).alias(value)) for c in columns]
    )
    kept = F.filter(pairs, lambda p: p[value].isNotNull())
    return df.select(*keys, F.explode(kept).alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")


def melt_times(
    df: DataFrame, keys: Sequence[str], prefixes: Sequence[str] = ("blood_dose_", "blood_product_"),
    parse=None, out: str = "dose_time",
) -> DataFrame:
    """Time columns found by prefix (any case) to distinct (key, time) rows; blank or unreadable ones are dropped."""
    from gapline.functions.clock import two_format_timestamp

    parse = parse or two_format_timestamp
    columns = [c for p in prefixes for c in df.columns if c.lower().startswith(p)]
    if not columns:
        empty = df.select(*keys, F.lit(None).cast("timestamp_ntz").alias(out))
        return empty.filter(F.lit(False))
    texts = F.array(*[F.col(f"`{c}`").cast("string") for c in columns])
    rows = df.select(*keys, F.explode(texts).alias("_text"))
    rows = rows.filter(~F.lower(F.trim("_text")).isin("", "nan", "nat", "none"))
    return rows.select(*keys, parse("_text").alias(out)).filter(F.col(out).isNotNull()).distinct()


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in the order: one aggregation, which sorts by key as it keeps whole rows."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def ensure_columns(df: DataFrame, columns: Sequence[str], default: Column | None = None) -> DataFrame:
    """Add the columns that are missing (null doubles unless a default is given)."""
    missing = [c for c in columns if c not in df.columns]
    value = F.lit(None).cast("double") if default is None else default
    return df.withColumns({c: value for c in missing}) if missing else df


def rename(df: DataFrame, names: Mapping[str, str], any_case: bool = False) -> DataFrame:
    if any_case:
        lower = {k.lower(): v for k, v in names.items()}
        names = {c: lower[c.lower()] for c in df.columns if c.lower() in lower}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def mask_implausible(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Wide form: values outside their closed range become null."""
    from gapline.functions.scalar import within

    return df.withColumns({c: within(f"`{c}`", b) for c, b in bounds.items() if c in df.columns})


def mask_implausible_long(
    df: DataFrame, bounds: Mapping[str, tuple[float, float]], signal: str = "signal", value: str = "value"
) -> DataFrame:
    """Long form: the same, by signal name; signals without a range keep their values."""
    ok = F.lit(True)
    for name, (low, high) in bounds.items():
        ok = F.when(F.col(signal) == name, F.col(value).between(float(low), float(high))).otherwise(ok)
    return df.withColumn(value, F.when(ok, F.col(value)))


def classify_columns(df: DataFrame, keys: Sequence[str], vitals: Sequence[str]) -> tuple[list, list, list]:
    """(vitals, labs, drugs) of a wide timeline: a drug column holds only 0 and 1 and is not empty.

    One aggregation over all remaining columns; only two numbers per column reach the driver.
    """
    shown = [c for c in vitals if c in df.columns]
    rest = [c for c in df.columns if c not in set(keys) | set(shown)]
    if not rest:
        return shown, [], []
    seen = df.agg(
        *[F.min(F.col(f"`{c}`").cast("double").isin(0.0, 1.0)).alias(f"f{i}") for i, c in enumerate(rest)]
    ).first()
    drugs = [c for i, c in enumerate(rest) if seen[i] is True]
    return shown, sorted(c for c in rest if c not in drugs), sorted(drugs)


def order_columns(df: DataFrame, keys: Sequence[str], vitals: Sequence[str]) -> DataFrame:
    shown, labs, drugs = classify_columns(df, keys, vitals)
    return df.select(*[c for c in keys if c in df.columns], *[F.col(f"`{c}`") for c in shown + labs + drugs])


def collapse_near_duplicates(
    df: DataFrame, keys: Sequence[str], ts: str, last: Sequence[str] = (), largest: Sequence[str] = (),
    first: Sequence[str] = (), seq: str | None = None, gap_us: int = second_us,
) -> DataFrame:
    """Rows closer than the gap (chained) become one: earliest time, last non-null, first non-null or largest value.

    Rows shrink to their time cells before clusters are formed, so no cluster is
    gathered as rows.
    """
    keys = list(keys)
    rows = df.filter(F.col(ts).isNotNull()).withColumn("_us", micros(ts)).withColumn("_cell", cell("_us", gap_us))
    order = F.struct("_us", seq) if seq else F.struct("_us")

    def at(col: str) -> Column:
        return F.when(F.col(f"`{col}`").isNotNull(), order)

    small = rows.groupBy(*keys, "_cell").agg(
        F.min("_us").alias("_us"),
        *[F.max(F.when(F.col(f"`{c}`").isNotNull(), F.struct(order.alias("o"), F.col(f"`{c}`").alias("v")))).alias(f"l_{c}")
          for c in last],
        *[F.min(F.when(F.col(f"`{c}`").isNotNull(), F.struct(order.alias("o"), F.col(f"`{c}`").alias("v")))).alias(f"f_{c}")
          for c in first],
        *[F.max(f"`{c}`").alias(f"m_{c}") for c in largest],
    )
    clusters = gap_cells(df, keys, ts, gap_us, at_equal=True).select(*keys, "_cell", "idx")
    merged = small.join(clusters, [*keys, "_cell"])
    return (
        merged.groupBy(*keys, "idx")
        .agg(
            from_micros(F.min("_us")).alias(ts),
            *[F.min(f"f_{c}")["v"].alias(c) for c in first],
            *[F.max(f"l_{c}")["v"].alias(c) for c in last],
            *[F.max(f"m_{c}").alias(c) for c in largest],
        )
        .drop("idx")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table itself, or an error naming one duplicated key."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"keys {list(keys)} are not unique, for example {bad[0].asDict()}")
    return df


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Left join on a right side with unique keys."""
    return left.join(assert_unique(right, keys) if check else right, list(keys), "left")


def semi_join(df: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(kept.select(*keys).distinct(), list(keys), "left_semi")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def sorted_positions(df: DataFrame, keys: Sequence[str], ts: str, seq: str, out: str = "position") -> DataFrame:
    """Rows numbered in stable (key, time, input) order over the whole table, without one global sort.

    Rows before an entity are summed over ranges of entities; inside an entity rows are ranked in time slices.  Null
    keys and times come first.
    """
    entity = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))
    rows = df.withColumn("_us", micros(ts)).withColumn("_entity", entity)
    per = rows.groupBy("_entity", *keys).agg(F.count(F.lit(1)).alias("_rows"))
    upto = running_sum(sampled_block(per, keys[0]), [], "_block", list(keys), {"_upto": "_rows"})
    upto = upto.select("_entity", (F.col("_upto") - F.col("_rows")).alias("_first"))
    width = measured_slice(rows, ["_entity"], "_us")
    slices = rows.withColumn("_block", F.coalesce(cell("_us", width), F.lit(-(1 << 60))))
    ranked = block_rank(slices, ["_entity"], "_block", ["_us", seq], "_inside")
    return ranked.join(upto, "_entity").withColumn(out, F.col("_inside") + F.col("_first")).drop(
        "_us", "_block", "_entity", "_inside", "_first"
    )


def sort_rows(df: DataFrame, keys: Sequence[str], ts: str, seq: str | None = None) -> DataFrame:
    """Stable (key, time) order for a sink; ranges of the order go to different tasks."""
    return df.orderBy(*keys, ts, *([seq] if seq else []))
