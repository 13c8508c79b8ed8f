"""The plans of the registry: queries by name, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafgraph.plans import batch, encodings, images, objects, runs

MODULES = (objects, images, batch, encodings, runs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for m in MODULES for k, f in vars(m).items() if k[0] == "q" and k[1:3].isdigit()}
    return dict(sorted(found.items()))


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
