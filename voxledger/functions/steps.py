"""Columns made once: rows take them step by step."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame

#: One step: columns that are added together, and that those of later steps name.
Steps = Sequence[dict[str, Column]]


def once(make: Callable) -> Callable:
    """`make` with its result kept for a Spark application. A column names what it works on and belongs to no table, but
    making a grammar's some thousand calls takes the driver a second, which a stream would spend again in each batch."""
    made: dict[tuple, object] = {}

    @wraps(make)
    def get(*args: object) -> object:
        key = (SparkContext.getOrCreate().applicationId, *args)
        if key not in made:
            made[key] = make(*args)
        return made[key]

    return get


def take(rows: DataFrame, steps: Steps) -> DataFrame:
    """rows with the columns of each step."""
    for step in steps:
        rows = rows.withColumns(step)
    return rows
