"""Column planning by name; only schemas are handled here, never rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

from gapline.config import ColumnSettings


def has_any(name: str, parts: Sequence[str]) -> bool:
    low = name.lower()
    return any(p.lower() in low for p in parts)


def is_realtime(name: str, settings: ColumnSettings = ColumnSettings()) -> bool:
    return has_any(name, settings.realtime_patterns)


def keep_only(columns: Sequence[str], settings: ColumnSettings = ColumnSettings()) -> list[str]:
    """Static names stay; realtime names stay if one of the wanted parts occurs.  Nothing left means no filter."""
    if not settings.keep_only:
        return list(columns)
    kept = [c for c in columns if not is_realtime(c, settings) or has_any(c, settings.keep_only)]
    return kept or list(columns)


def without_realtime(columns: Sequence[str], settings: ColumnSettings = ColumnSettings()) -> list[str]:
    return [c for c in columns if not is_realtime(c, settings)]


def without_blocked(columns: Sequence[str], settings: ColumnSettings = ColumnSettings()) -> list[str]:
    """Drop unwanted parts; with the blocklist also leakage names and case-sensitive patterns."""
    kept = [c for c in columns if not has_any(c, settings.drop_if_contains)]
    if settings.use_blocklist:
        blocked = set(settings.blocked_columns)
        kept = [c for c in kept if c not in blocked and not any(p in c for p in settings.blocked_patterns)]
    return kept


def plan_columns(columns: Sequence[str], settings: ColumnSettings = ColumnSettings()) -> list[str]:
    """Feature columns for the matrix, in input order."""
    wanted = [c for c in columns if c not in settings.never]
    wanted = without_realtime(wanted, settings) if settings.drop_realtime else keep_only(wanted, settings)
    return without_blocked(wanted, settings)


def drop_duplicate_ids(df: DataFrame, settings: ColumnSettings = ColumnSettings()) -> DataFrame:
    for canonical, copies in settings.duplicate_ids.items():
        if canonical in df.columns:
            df = df.drop(*[c for c in copies if c in df.columns])
    return df


def numeric_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, NumericType)]


def present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]
