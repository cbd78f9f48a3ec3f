"""Queries over the driver tables, one or more per inventory row."""

from __future__ import annotations


def all_queries():
    from gapline.suite import cleaning, flows, sources, snapshots, statics, timeline, training  # noqa: F401
    from gapline.suite.registry import QUERIES

    return dict(QUERIES)
