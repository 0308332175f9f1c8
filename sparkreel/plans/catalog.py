"""Imports every query module once and exposes the filled registry."""

from __future__ import annotations

from importlib import import_module

from sparkreel.plans.registry import ORACLES, QUERIES, Query

MODULES = ["statistics_queries", "clip_queries", "subtitle_queries", "scalar_queries", "state_queries", "report_queries", "source_queries", "stream_queries"]

for _name in MODULES:
    import_module(f"sparkreel.plans.{_name}")


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
