"""Incremental, idempotent ingest of append-only files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder every executor can reach: in spark.checkpoint.dir, without which only a local session runs."""
    top = spark.conf.get("spark.checkpoint.dir", "")
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    top = top or "file://" + tempfile.mkdtemp(prefix="lattiq-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ingest(spark: SparkSession, source: str, schema: StructType, keys: list[str], sink: str, checkpoint: str, fmt: str = "json", watermark: tuple[str, str] | None = None) -> None:
    """Append every new row of the folder ``source`` to the parquet folder ``sink`` exactly once.

    The checkpoint remembers which files were read; rows whose keys were seen before are dropped, for
    ever, or within ``watermark`` (column, delay) so that the state stays bounded.  Runs until what is
    there has been read.
    """
    rows = spark.readStream.schema(schema).format(fmt).load(source)
    rows = rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys) if watermark else rows.dropDuplicates(keys)
    q = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)
    q.awaitTermination()


def on_new_files(spark: SparkSession, source: str, schema: StructType, handle: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "json") -> None:
    """Call ``handle`` once for each batch of new files (done markers to analyse); the checkpoint makes
    it exactly once across restarts."""
    rows = spark.readStream.schema(schema).format(fmt).option("multiLine", "true").load(source)
    q = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def replay(rows: DataFrame, key: str) -> DataFrame:
    """Write rows as two overlapping JSON batches, ingest them in two runs, and read the result."""
    spark = rows.sparkSession
    source, sink, state = (shared_folder(spark, n) for n in ("in", "out", "state"))
    for part in (rows.filter(f"{key} % 3 <> 0"), rows.filter(f"{key} % 2 = 0 or {key} % 3 = 0")):
        part.write.mode("append").json(source)
        ingest(spark, source, rows.schema, [key], sink, state)
    return spark.read.schema(rows.schema).parquet(sink)
