"""Runs Arrow functions of this package on the workers."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def map_arrow(rows: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package's folder on the path of the workers, where they share the
    driver's machine; elsewhere the package is installed on the executors."""
    environment = rows.sparkSession.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return rows.mapInArrow(function, schema)
