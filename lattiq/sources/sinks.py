"""Writers: idempotent appends, partitioned facts, CSV tables, JSON summaries, reports."""

from __future__ import annotations

import json
import math
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def append_new(rows: DataFrame, path: str, keys: list[str], compression: str = "gzip") -> None:
    """Append to a JSON-lines folder the rows whose keys are not there yet."""
    try:
        old = rows.sparkSession.read.schema(rows.schema).json(path)
        rows = rows.join(old.select(*keys).distinct(), keys, "left_anti")
    except AnalysisException:
        pass  # nothing has been written yet
    rows.write.mode("append").option("compression", compression).json(path)


def facts(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Parquet partitioned for pruning; rewriting a partition replaces it only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def csv_table(rows: DataFrame, path: str, digits: int | None = 3) -> None:
    """One CSV file of a report-sized table, floating columns rounded."""
    cols = [F.round(c, digits).alias(c) if t == "double" and digits is not None else F.col(c) for c, t in rows.dtypes]
    rows.select(*cols).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_json(path: str, value: object) -> None:
    """Atomic on the driver: a temporary file renamed into place; NaN becomes null."""

    def plain(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(plain(value), f, ensure_ascii=False, indent=1)
    os.replace(temp, path)


def summary(tables: dict[str, DataFrame], path: str) -> None:
    """Report-sized tables as JSON records."""
    write_json(path, {k: [r.asDict(True) for r in t.collect()] for k, t in tables.items()})


def markdown(title: str, rows: DataFrame, digits: int = 2) -> str:
    """A Markdown section of a report-sized table; nulls are blank."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows.collect()), ""])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new one of equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def interval_text(label: str, delta: str, low: str, high: str):
    """'label  +d [lo, hi]', or '(empty)' where there is no estimate."""
    return F.when(F.col(delta).isNull(), F.concat(F.lit(f"{label} (empty)"))).otherwise(F.format_string(f"{label} %+.2f [%+.2f, %+.2f]", delta, low, high))


def verdict_text(label: str, delta: str, low: str, high: str, better: str, worse: str, tied: str):
    """interval_text with the numbers of better, worse and tied utterances."""
    counts = F.format_string(" better %d / worse %d / tied %d", better, worse, tied)
    return F.concat(interval_text(label, delta, low, high), F.when(F.col(delta).isNull(), "").otherwise(counts))
