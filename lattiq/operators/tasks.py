"""How many tasks work on a table: in proportion to its files, so that a task's memory stays the same."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Bytes of files that one task works on, for utterances and for facts.
TASK_BYTES, FACT_BYTES = 1 << 18, 1 << 22


def input_bytes(rows: DataFrame) -> int:
    """Bytes of the files (or other sources) below the rows."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def dealt(rows: DataFrame, task_bytes: int, *keys: str, size: int | None = None) -> DataFrame:
    """Rows dealt by key to as many tasks as their input takes.  What is grouped by these keys, or by
    more, stays where it is."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-(size or input_bytes(rows)) // task_bytes)), *keys)
