"""Regular snapshot grids and window statistics on them.

Samples are reduced to *panes* (the stretch between two grid points) by one
aggregation with map-side combine; every window then combines a few panes.  A task
holds the panes of an (episode, signal): at most twice the grid length, whatever the
number of samples.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapline.functions.clock import cell, ceil_cell, from_micros, micros

STATS = ("last", "min", "max", "mean", "std", "median", "slope_linfit", "delta", "delta_t")


# ---------------------------------------------------------------- grids
def closed_grid(bounds: DataFrame, keys: Sequence[str], start_us: str, end_us: str, step_us: int) -> DataFrame:
    """Grid points from start to end, both ends allowed: keys, `i`, `snapshot_us`."""
    last = cell(F.col(end_us) - F.col(start_us), step_us)
    grid = bounds.select(*keys, start_us, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    return grid.select(*keys, "i", (F.col(start_us) + F.col("i") * step_us).alias("snapshot_us"))


def open_grid(bounds: DataFrame, keys: Sequence[str], start_us: str, end_us: str, step_us: int) -> DataFrame:
    """Grid points from start up to but without the end."""
    last = ceil_cell(F.col(end_us) - F.col(start_us), step_us) - 1
    grid = bounds.withColumn("_last", last).filter(F.col("_last") >= 0)
    grid = grid.select(*keys, start_us, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("i"))
    return grid.select(*keys, "i", (F.col(start_us) + F.col("i") * step_us).alias("snapshot_us"))


def last_open_point(start_us: str, end_us: str, step_us: int) -> Column:
    return ceil_cell(F.col(end_us) - F.col(start_us), step_us) - 1


# ---------------------------------------------------------------- panes
def pane_code(offset_us, step_us: int) -> Column:
    """2*i for a sample exactly on grid point i, 2*i - 1 for one between points i-1 and i."""
    offset = F.col(offset_us) if isinstance(offset_us, str) else offset_us
    i = ceil_cell(offset, step_us)
    return F.when(offset == i * step_us, 2 * i).otherwise(2 * i - 1)


def _number(value: str, as_float: bool) -> Column:
    """A sample value; by default with the precision of a float."""
    return F.col(value).cast("float").cast("double") if as_float else F.col(value).cast("double")


def _point(code) -> Column:
    """Grid point at or after a pane code."""
    return cell(code + 1, 2)


def _reach(code, width: int, closed: bool) -> Column:
    """Last grid point whose window holds the pane; a closed window also takes its left edge."""
    return cell(code + (2 * width if closed else 2 * width - 1), 2)


#: Windows of more steps are merged from running results.  Measured on 800,000 panes: repeating a pane takes 3.9 s at 16
#: steps and 7.3 s at 96, merging 7.5 s and 6.5 s.
WIDE_STEPS = 64
#: What a part of a window carries: counts, sums of values and times, extremes, first and last sample.
_MOMENTS = ("n", "d", "dd", "x", "xx", "xd", "min", "max", "fv", "fs", "lv", "ls")


def _part(scope: str, first, last, values: Mapping[str, str], j0: Column | None = None) -> Column:
    """A running result and the grid points it belongs to."""
    fields = [F.lit(scope).alias("scope"), F.col(first).cast("long").alias("from"), F.col(last).cast("long").alias("to")]
    fields.append((j0 if j0 is not None else F.lit(0)).cast("long").alias("j0"))
    return F.struct(*fields, *[(F.col(values[t]) if t in values else F.lit(None)).cast("long" if t in ("fs", "ls") else "double").alias(t) for t in _MOMENTS])


def _running(panes: DataFrame, group: Sequence[str], scope: str, width: int, closed: bool, step_s: float) -> tuple[DataFrame, list[Column]]:
    """Panes with running results inside blocks of `width` steps, forwards and backwards, and the two parts they give."""
    at = f"_{scope}_b"
    panes = panes.withColumn(at, cell("_c", 2 * width))
    first_point = F.col(at) * width
    off = (F.col("_j") - first_point) * F.lit(step_s)
    source = {
        "n": F.col("_n"), "d": F.col("_d"), "dd": F.col("_dd"), "x": F.col("_su") + F.col("_n") * off,
        "xx": F.col("_suu") + 2 * off * F.col("_su") + F.col("_n") * off * off, "xd": F.col("_ud") + off * F.col("_d"),
    }
    parts = []
    for ahead in (True, False):
        tag = f"_{scope}_{'a' if ahead else 'z'}"
        w = Window.partitionBy(*group, at).orderBy(F.col("_c") if ahead else F.desc("_c"))
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        values = {t: F.sum(x).over(run) for t, x in source.items()}
        values |= {"min": F.min("_min").over(run), "max": F.max("_max").over(run)}
        # the end where the run begins keeps its sample, the other end is the pane's own
        begin = ("fv", "fs") if ahead else ("lv", "ls")
        values |= {t: F.first(f"_{t}").over(run) for t in begin}
        next_code = F.lead("_c").over(w)
        if ahead:  # up to the point before the next pane, inside the block
            values["from"], values["to"] = F.col("_j"), F.coalesce(_point(next_code), first_point + width) - 1
        else:  # windows of the next block whose first pane this is
            values["from"] = F.coalesce(_reach(next_code, width, closed) + 1, first_point + width)
            values["to"] = F.least(_reach(F.col("_c"), width, closed), first_point + (2 * width - 1))
        panes = panes.select("*", *[x.alias(f"{tag}_{t}") for t, x in values.items()])
        low = F.greatest(F.col(f"{tag}_from"), first_point) if ahead else F.greatest(F.col(f"{tag}_from"), first_point + width)
        high = F.least(F.col(f"{tag}_to"), first_point + (width - 1), F.col("_last")) if ahead else F.least(F.col(f"{tag}_to"), F.col("_last"))
        panes = panes.withColumns({f"{tag}_from": low, f"{tag}_to": high})
        own = {t: f"{tag}_{t}" if t in values else f"_{t}" for t in _MOMENTS}
        parts.append(_part(scope, f"{tag}_from", f"{tag}_to", own, first_point))
    return panes, parts


def _repeated(panes: DataFrame, group: Sequence[str], step_us: int, windows: Mapping[str, int], closed: bool, history: bool):
    """Moments of a pane, once for every grid point that sees it; per scope the condition that its window does."""
    whole = Window.partitionBy(*group)
    panes = panes.withColumn("_ref", F.avg("_m").over(whole)).withColumn("_j", _point(F.col("_c")))
    reaches = {scope: _reach(F.col("_c"), width, closed) for scope, width in windows.items()}
    to = F.greatest(F.lit(-1), *reaches.values())
    if history:
        following = _point(F.lead("_c").over(whole.orderBy("_c")))
        panes = panes.withColumn("_until", F.coalesce(following - 1, F.col("_last")))
        to = F.greatest(to, F.col("_until"))
    panes = panes.withColumns({f"_r_{scope}": reach for scope, reach in reaches.items()})
    panes = panes.withColumn("_to", F.least(to, F.col("_last"))).filter(F.col("_j") <= F.col("_to"))
    panes = panes.withColumn("i", F.explode(F.sequence("_j", "_to")))
    # time of a sample relative to the grid point, value relative to the reference
    back = (F.col("i") - F.col("_j")) * F.lit(step_us / 1e6)
    dev = F.col("_m") - F.col("_ref")
    panes = panes.select(
        *group, "i", "_ref", "_n", "_min", "_max", "_fv", "_lv", "_fs", "_ls",
        *[f"_r_{scope}" for scope in windows], *(["_until"] if history else []),
        (F.col("_n") * dev).alias("_d"),
        (F.col("_m2") + F.col("_n") * dev * dev).alias("_dd"),
        (F.col("_su") - F.col("_n") * back).alias("_x"),
        (F.col("_suu") - 2 * back * F.col("_su") + F.col("_n") * back * back).alias("_xx"),
        (F.col("_cuv") + F.col("_su") * dev - back * F.col("_n") * dev).alias("_xd"),
    )
    return panes, {scope: F.col("i") <= F.col(f"_r_{scope}") for scope in windows}, F.col("i") <= F.col("_until") if history else None


def _merged(panes: DataFrame, group: Sequence[str], step_us: int, windows: Mapping[str, int], closed: bool, history: bool):
    """Moments of at most two running results per window, once for every grid point.

    For a window of w steps time is cut into blocks of w steps.  The window ends in one block and starts in the block
    before, so it is the running result of its last pane from the block's start, and that of its first pane to its
    block's end.  Sums never run beyond a block and nothing is subtracted; extremes merge in the same way.
    """
    step_s = step_us / 1e6
    # one exchange for all scans and for the merge
    panes = panes.repartition(*group)
    timeline = Window.partitionBy(*group).orderBy("_c")
    whole = timeline.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    panes = panes.withColumn("_ref", F.avg("_m").over(whole)).withColumn("_j", _point(F.col("_c")))
    parts = []
    if history:
        until = F.least(F.coalesce(_point(F.lead("_c").over(timeline)) - 1, F.col("_last")), F.col("_last"))
        panes = panes.withColumn("_until", until)
        parts.append(_part("history", "_j", "_until", {"lv": "_lv", "ls": "_ls"}))
    dev = F.col("_m") - F.col("_ref")
    panes = panes.withColumns({"_d": F.col("_n") * dev, "_dd": F.col("_m2") + F.col("_n") * dev * dev, "_ud": F.col("_cuv") + F.col("_su") * dev})
    for scope, width in windows.items():
        panes, found = _running(panes, group, scope, width, closed, step_s)
        parts += found
    panes = panes.select(*group, "_ref", F.explode(F.array(*parts)).alias("_p")).where("_p.from <= _p.to")
    panes = panes.select(*group, "_ref", "_p.*").select("*", F.explode(F.sequence("from", "to")).alias("i"))
    # time relative to the grid point
    back = (F.col("i") - F.col("j0")) * F.lit(step_s)
    panes = panes.select(
        *group, "i", "_ref", "scope", *[F.col(t).alias(f"_{t}") for t in ("n", "d", "dd", "min", "max", "fv", "fs", "lv", "ls")],
        (F.col("x") - F.col("n") * back).alias("_x"), (F.col("xx") - 2 * back * F.col("x") + F.col("n") * back * back).alias("_xx"),
        (F.col("xd") - back * F.col("d")).alias("_xd"),
    )
    return panes, {scope: F.col("scope") == scope for scope in windows}, F.col("scope") == "history"


def grid_windows(
    samples: DataFrame,
    keys: Sequence[str],
    step_us: int,
    windows: Mapping[str, int],
    signal: str = "signal",
    offset_us: str = "offset_us",
    value: str = "value",
    last_point: str = "last_point",
    closed: bool = False,
    history: bool = False,
    medians: bool = True,
    min_samples: int = 3,
    slope_per: float = 1.0,
    seq: str | None = None,
    as_float: bool = True,
    points: DataFrame | None = None,
) -> DataFrame:
    """Window statistics per (keys, signal, grid point).

    `samples` carry the distance from the grid origin in microseconds and the index of
    the last grid point.  `windows` maps a scope name to its width in steps: a sample
    counts when  g - w < t <= g  (`closed`: g - w <= t <= g).  Output columns are
    `{scope}_{stat}`, plus `{scope}_n`, `{scope}_first`, `{scope}_first_offset_us`.
    With `history`, every grid point from the first sample on appears, with
    `history_last` and `history_offset_us` (the newest sample of all time).
    Otherwise only points with a non-empty window appear.

    Panes move once, to the task of their (keys, signal), where windows are formed without
    another shuffle: windows of up to `WIDE_STEPS` steps by repeating a pane for the points
    that see it, wider ones by merging two running results, so that the work of an output
    row does not grow with the number of steps.  With `points` (keys, `i`) only these grid
    points are formed.
    """
    keys = list(keys)
    group = [*keys, signal]
    rows = (
        samples.filter(F.col(value).isNotNull() & (F.col(offset_us) >= 0))
        .select(*group, F.col(offset_us).alias("_s"), _number(value, as_float).alias("_v"),
                F.col(last_point).alias("_last"), *([seq] if seq else []))
        .withColumn("_c", pane_code("_s", step_us))
        .withColumn("_u", (F.col("_s") - _point(F.col("_c")) * step_us) / F.lit(1e6))
    )
    order = F.struct("_s", seq) if seq else F.col("_s")
    n = F.count(F.lit(1)).cast("double")
    panes = rows.groupBy(*group, "_c").agg(
        n.alias("_n"),
        F.avg("_v").alias("_m"),
        (F.var_pop("_v") * n).alias("_m2"),
        (F.covar_pop("_u", "_v") * n).alias("_cuv"),
        F.sum("_u").alias("_su"),
        F.sum(F.col("_u") * F.col("_u")).alias("_suu"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.min_by("_v", order).alias("_fv"),
        F.max_by("_v", order).alias("_lv"),
        F.min("_s").alias("_fs"),
        F.max("_s").alias("_ls"),
        F.max("_last").alias("_last"),
    )
    form = _merged if windows and max(windows.values()) > WIDE_STEPS else _repeated
    panes, seen, newest = form(panes, group, step_us, windows, closed, history)
    if points is not None:
        panes = panes.join(points.select(*keys, "i"), [*keys, "i"], "left_semi")
    aggs = [F.max("_ref").alias("_ref")]
    for scope in windows:

        def own(col: str, here=seen[scope]) -> Column:
            return F.when(here, F.col(col))

        aggs += [F.sum(own(f"_{t}")).alias(f"_{scope}_{t}") for t in ("n", "d", "dd", "x", "xx", "xd")]
        aggs += [
            F.min(own("_min")).alias(f"_{scope}_min"), F.max(own("_max")).alias(f"_{scope}_max"),
            F.min_by(own("_fv"), own("_fs")).alias(f"_{scope}_fv"), F.max_by(own("_lv"), own("_ls")).alias(f"_{scope}_lv"),
            F.min(own("_fs")).alias(f"_{scope}_fs"), F.max(own("_ls")).alias(f"_{scope}_ls"),
        ]
    if history:
        aggs += [
            F.max(F.when(newest, F.col("_lv"))).alias("history_last"),
            F.max(F.when(newest, F.col("_ls"))).alias("history_offset_us"),
        ]
    rows = panes.groupBy(*group, "i").agg(*aggs)
    out = [*group, "i"]
    if history:
        out += ["history_last", "history_offset_us"]
    least = F.lit(float(max(2, min_samples)))
    for scope in windows:
        t = {name: F.col(f"_{scope}_{name}") for name in
             ("n", "d", "dd", "x", "xx", "xd", "min", "max", "fv", "lv", "fs", "ls")}
        enough = t["n"] >= least
        spread = t["xx"] - t["x"] * t["x"] / t["n"]
        slope = (t["xd"] - t["x"] * t["d"] / t["n"]) / spread
        variance = F.greatest(t["dd"] / t["n"] - (t["d"] / t["n"]) * (t["d"] / t["n"]), F.lit(0.0))
        out += [
            F.coalesce(t["n"], F.lit(0.0)).cast("long").alias(f"{scope}_n"),
            t["lv"].alias(f"{scope}_last"),
            t["min"].alias(f"{scope}_min"),
            t["max"].alias(f"{scope}_max"),
            F.when(enough, F.col("_ref") + t["d"] / t["n"]).alias(f"{scope}_mean"),
            F.when(enough, F.sqrt(variance)).alias(f"{scope}_std"),
            F.when(enough & (t["ls"] > t["fs"]), slope * F.lit(slope_per)).alias(f"{scope}_slope_linfit"),
            F.when(enough, t["lv"] - t["fv"]).alias(f"{scope}_delta"),
            F.when(enough, (t["ls"] - t["fs"]) / F.lit(1e6)).alias(f"{scope}_delta_t"),
            t["fv"].alias(f"{scope}_first"),
            t["fs"].alias(f"{scope}_first_offset_us"),
        ]
    result = rows.select(*out)
    if windows and medians:
        med = window_medians(
            samples, keys, step_us, windows, signal, offset_us, value, last_point, closed, min_samples, as_float
        )
        result = result.join(med, [*group, "i"], "left")
    return result


def _tagged(points: Column, scope: str) -> Column:
    return F.transform(points, lambda i: F.struct(F.lit(scope).alias("scope"), i.alias("i")))


def _points(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def window_medians(
    samples: DataFrame, keys: Sequence[str], step_us: int, windows: Mapping[str, int], signal: str = "signal",
    offset_us: str = "offset_us", value: str = "value", last_point: str = "last_point", closed: bool = False,
    min_samples: int = 3, as_float: bool = True,
) -> DataFrame:
    """Exact medians per window: keys, signal, `i`, `{scope}_median`.

    Samples are first counted per (pane, float value).  The counts move to blocks of as
    many grid points as the widest window has steps, so each goes to two or three
    blocks.  Inside the block, values without enough others around them are left out, and
    windows sort their distinct values (sort and spill, no per-window state in memory).  With masked signals the distinct float
    values of a window are bounded by the plausible range.
    """
    group = [*keys, signal]
    span = max(windows.values())
    code = F.col("_c")
    rows = (
        samples.filter(F.col(value).isNotNull() & (F.col(offset_us) >= 0))
        .select(*group, F.col(offset_us).alias("_s"), _number(value, as_float).alias("_v"),
                F.col(last_point).alias("_last"))
        .withColumn("_c", pane_code("_s", step_us))
        .groupBy(*group, "_c", "_v")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_last").alias("_last"))
    )
    furthest = F.least(_reach(code, span, closed), F.col("_last"))
    blocks = _points(cell(_point(code), span), F.when(_point(code) <= furthest, cell(furthest, span)).otherwise(-1))
    rows = rows.withColumn("_block", F.explode(blocks)).repartition(*group, "_block")
    begin = F.greatest(_point(code), F.col("_block") * span)
    end = F.least(F.col("_last"), F.col("_block") * span + (span - 1))
    least = max(2, min_samples)
    by_code = Window.partitionBy(*group, "_block").orderBy("_c")
    none = F.array().cast("array<struct<scope:string,i:bigint>>")
    targets = []
    for scope, width in windows.items():
        # values with too few others around them are in no window that has a median
        around = F.sum("_n").over(by_code.rangeBetween(-2 * width, 2 * width))
        rows = rows.withColumn(f"_near_{scope}", around)
        own = _tagged(_points(begin, F.least(_reach(code, width, closed), end)), scope)
        targets.append(F.when(F.col(f"_near_{scope}") >= least, own).otherwise(none))
    rows = rows.select(*group, "_block", F.explode(F.concat(*targets)).alias("_w"), "_v", "_n").select(
        *group, "_block", "_w.scope", "_w.i", "_v", "_n"
    )
    one = [*group, "_block", "i", "scope"]
    run = Window.partitionBy(*one).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("_n").over(run)).withColumn(
        "_all", F.sum("_n").over(Window.partitionBy(*one))
    )
    low = F.floor((F.col("_all") + 1) / 2)
    high = F.floor((F.col("_all") + 2) / 2)

    def holds(rank: Column) -> Column:
        return (F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto"))

    def middle(scope: str) -> Column:
        here = F.col("scope") == scope
        at_low = F.max(F.when(here & holds(low), F.col("_v")))
        at_high = F.max(F.when(here & holds(high), F.col("_v")))
        return ((at_low + at_high) / 2).alias(f"{scope}_median")

    picked = rows.filter((F.col("_all") >= least) & (holds(low) | holds(high)))
    return picked.groupBy(*group, "_block", "i").agg(*[middle(scope) for scope in windows]).drop("_block")


def grid_last(
    samples: DataFrame, keys: Sequence[str], step_us: int, signal: str = "signal", offset_us: str = "offset_us",
    value: str = "value", last_point: str = "last_point", seq: str | None = None, as_float: bool = True,
) -> DataFrame:
    """Newest sample at or before every grid point, without a limit on its age.

    Output: keys, signal, `i`, `last_value`, `last_offset_us`; points before the first
    sample do not appear.  Samples are reduced to one per pane first.
    """
    keys = list(keys)
    group = [*keys, signal]
    v = _number(value, as_float)
    order = F.struct("_s", seq) if seq else F.col("_s")
    panes = (
        samples.filter(F.col(value).isNotNull() & (F.col(offset_us) >= 0))
        .select(*group, F.col(offset_us).alias("_s"), v.alias("_v"), F.col(last_point).alias("_last"),
                *([seq] if seq else []))
        .withColumn("_i", ceil_cell("_s", step_us))
        .groupBy(*group, "_i")
        .agg(F.max_by("_v", order).alias("_v"), F.max("_s").alias("_s"), F.max("_last").alias("_last"))
    )
    following = F.lead("_i").over(Window.partitionBy(*group).orderBy("_i"))
    panes = panes.withColumn("_to", F.least(F.coalesce(following - 1, F.col("_last")), F.col("_last")))
    return panes.filter(F.col("_i") <= F.col("_to")).select(
        *group, F.explode(F.sequence("_i", "_to")).alias("i"), F.col("_v").alias("last_value"),
        F.col("_s").alias("last_offset_us"),
    )


def baseline(
    samples: DataFrame, keys: Sequence[str], window_us: int, signal: str = "signal", offset_us: str = "offset_us",
    value: str = "value", seq: str | None = None,
) -> DataFrame:
    """Mean of the first stretch after the origin; without a value there, the first value later on."""
    rows = samples.filter(F.col(value).isNotNull() & (F.col(offset_us) >= 0))
    early = F.avg(F.when(F.col(offset_us) <= window_us, F.col(value).cast("double")))
    order = F.struct(offset_us, seq) if seq else F.col(offset_us)
    return rows.groupBy(*keys, signal).agg(
        F.coalesce(early, F.min_by(F.col(value).cast("double"), order)).alias("baseline")
    )


def spread_signals(
    long: DataFrame, grid: DataFrame, keys: Sequence[str], signals: Sequence[str], columns: Mapping[str, str],
    name, signal: str = "signal",
) -> DataFrame:
    """One row per grid point with a column per (signal, statistic); absent ones are null.

    `columns` maps a statistic to its column in `long`; `name(signal, statistic)` gives
    the output column.  Grid rows and results meet in one aggregation.
    """
    keys = list(keys)
    kept = list(dict.fromkeys(columns.values()))
    entry = F.struct(F.col(signal), F.struct(*kept))
    found = long.select(*keys, "i", entry.alias("_e"))
    empty = grid.select(*keys, "i", F.lit(None).cast(found.schema["_e"].dataType).alias("_e"))
    # at most one entry per signal
    wide = found.unionByName(empty).groupBy(*keys, "i").agg(F.map_from_entries(F.collect_list("_e")).alias("_m"))
    cells = [
        F.element_at("_m", F.lit(s))[col].alias(name(s, stat)) for s in signals for stat, col in columns.items()
    ]
    return wide.select(*keys, "i", *cells)


def snapshot_time(start_us: str, step_us: int) -> Column:
    return from_micros(F.col(start_us) + F.col("i") * step_us)


def offsets(rows: DataFrame, ts: str, start_us: str, end_us: str, step_us: int) -> DataFrame:
    """Add the distance to the grid origin and the last grid point of the closed grid."""
    return rows.withColumn("offset_us", micros(ts) - F.col(start_us)).withColumn(
        "last_point", cell(F.col(end_us) - F.col(start_us), step_us)
    )
