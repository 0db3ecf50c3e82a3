"""Readers of dumps, manifests, transcripts, index files and fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import DONE, DUMP, MANIFEST


def path_parts(path: Column) -> dict[str, Column]:
    """model, set_name, shard, kind and arm of ``.../<model>__<set>__s<NN>__<kind>/<arm>.jsonl[.gz]``."""
    folder, file = F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1)
    p = F.split(folder, "__")
    return {"model": F.get(p, F.lit(0)), "set_name": F.get(p, F.lit(1)), "shard": F.substring(F.get(p, F.lit(2)), 2, 9).cast("int"), "kind": F.get(p, F.lit(3)), "arm": F.regexp_replace(file, r"\.jsonl(\.gz)?$", "")}


def dumps(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Candidate dumps.  Strict: a bad line fails.  Otherwise bad lines are dropped and of truncated
    gzip files what can be read is kept.  Blank lines never count."""
    reader = spark.read.schema(DUMP).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", "true")
    if not strict:
        reader = reader.option("ignoreCorruptFiles", "true")
    df = reader.json(path)
    file = F.col("_metadata.file_path")
    return df.select("*", file.alias("file")).withColumns({f"path_{k}": v for k, v in path_parts(F.col("file")).items()}).filter(F.col("id").isNotNull())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest; the id defaults to the audio file's stem."""
    stem = F.regexp_replace(F.element_at(F.split("audio", "/"), -1), r"\.[^.]*$", "")
    return spark.read.schema(MANIFEST).json(path).withColumn("id", F.coalesce("id", stem))


def transcripts(spark: SparkSession, path: str, audio: DataFrame | None = None) -> DataFrame:
    """(id, text) of a tree of ``*.trans.txt`` files, ids without audio left out."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.trans.txt").text(path).filter(F.trim("value") != "")
    p = F.split("value", " ", 2)
    out = lines.select(F.get(p, F.lit(0)).alias("id"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("text"))
    return out if audio is None else out.join(audio.select("id"), "id", "left_semi")


def comma_index(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, file, text): split on the first two commas only, trimmed, incomplete lines dropped."""
    p = F.split("value", ",", 3)
    rows = spark.read.text(path).filter(F.size(p) == 3).select(*[F.trim(F.get(p, F.lit(i))).alias(c) for i, c in enumerate(("line_id", "file", "text"))])
    return rows.filter("text <> ''")


def tab_index(spark: SparkSession, path: str, rate: int = 16000) -> DataFrame:
    """(id, file, raw, text, duration_s) of six-column tables; rows without a sample count dropped."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(p) >= 6)
    out = rows.select(*[F.get(p, F.lit(i)).alias(c) for i, c in enumerate(("id", "file", "raw", "text"))], (F.get(p, F.lit(5)).try_cast("long") / rate).alias("duration_s"))
    return out.filter("duration_s is not null")


def parquet_utterances(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a parquet set, by the first matching column name."""
    df = spark.read.parquet(path)
    first = lambda names, default: next((n for n in names if n in df.columns), default)
    uid, text = first(["id", "file"], df.columns[0]), first(["text", "transcription", "sentence", "normalized_text"], None)
    if text is None:
        raise ValueError(f"no text column among {df.columns}")
    return df.select(F.col(uid).cast("string").alias("id"), F.col(text).cast("string").alias("text"))


def utterances(spark: SparkSession, source: str, path: str) -> DataFrame:
    kinds = {"librispeech": transcripts, "manifest": manifest}
    if source not in kinds:
        raise ValueError(f"unknown source {source!r}")
    return kinds[source](spark, path).select("id", "text")


def fact_tables(spark: SparkSession, path: str, keys: list[str], grid: bool = False) -> DataFrame:
    """All fact files of a folder, schemas merged, null precision as '', of equal keys the last file's row."""
    reader = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    df = reader.parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    df = df.filter(F.col("_file").endswith(".grid.parquet") if grid else ~F.col("_file").contains(".grid."))
    if "precision" in df.columns:
        df = df.na.fill("", ["precision"])
    w = Window.partitionBy(*keys).orderBy(F.desc("_file"))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_file")


def done_markers(spark: SparkSession, path: str, plan: DataFrame) -> DataFrame:
    """Done markers with their jobs; markers of unknown jobs or without timings are skipped."""
    d = spark.read.schema(DONE).option("multiLine", "true").json(path)
    job = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.json$", "")
    d = d.filter("decode_s is not null").select("*", job.alias("id")).drop("model", "job")
    return d.join(F.broadcast(plan), "id")


def spread(files: list[str], take: int) -> list[str]:
    """``take`` files spread evenly over a sorted list."""
    return [files[int((i + 0.5) * len(files) / take)] for i in range(min(take, len(files)))]


def first_per_set(df: DataFrame, by: list[str], n: int, order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(file, line, value): the first n lines of every text file, gzipped ones too, in file order.

    Lines are ordered by the start of their split, then by reading order.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "_metadata.file_block_start", "value", F.monotonically_increasing_id().alias("_at"))
    w = Window.partitionBy("file").orderBy("file_block_start", "_at")
    return lines.withColumn("line", F.row_number().over(w)).filter(F.col("line") <= n).select("file", "line", "value")
