"""A registry of data sets or models as a table: one row each, with the tasks it is for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tasks(registry: DataFrame, name: str, tasks_col: str) -> DataFrame:
    """(name, task): a row for each task of each entry. An entry without tasks has none."""
    return registry.select(F.col(name), F.explode(tasks_col).alias("task"))


def for_task(registry: DataFrame, tasks_col: str, task: str) -> DataFrame:
    """The entries that have a task."""
    return registry.where(F.array_contains(tasks_col, task))
