"""The training-corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; ``docs`` has the
columns of ``documents``, and so has every stage's result but the last one's.  No stage can be
expressed in one SQL statement, so there is no ORACLE_SQL; tests compare the stages with brute force.

* language: texts without a letter or with an ambiguous language go.
* near_duplicates: one document (the smallest doc_id) of each near-duplicate class stays; documents
  are linked from a Jaccard similarity of 80 % on.
* substrings: words of 50-word passages that an earlier document holds are cut out of the text;
  documents of which nothing is left go.
* benchmark: documents that hold a benchmark passage go.
* tokens: ids of the remaining texts.

Rows with a null doc_id pass the filters on their own merits and are never another's duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm import decontaminate, langid, near_dedup, sentencepiece_fst, substring_dedup
from lattiq.llm.common import bounded_batches, keyed, stored

NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a sure language.  Null, empty and letterless texts go; rows of null lang stay on their
    text's merits; columns of any name pass through."""
    bounded_batches(spark)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = langid.fit(known)
    names = [f"c{i}" for i in range(len(docs.columns))]  # extra columns may be called like the verdicts
    judged = langid.predict(docs.toDF(*names), model, names, names[docs.columns.index("text")])
    return judged.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each class.  Rows of one doc_id are one document: the one of
    the least text (by hash) stays for them, nulls apart; rows without a doc_id all stay."""
    bounded_batches(spark)
    kept = near_dedup.classes(docs, NEAR_PERCENT).filter("kept").select(F.col("doc_id").alias("__id")).filter("__id is not null").distinct()
    rid = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id").cast("long") == F.col("__id"), "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.col("text").isNull(), "__rid")
    named = named.withColumn("__rid", rid).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__rid", "__n")
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents; n_chars follows the text.  Each row of a
    repeated doc_id is cut by its own text; null and short texts stay as they are."""
    bounded_batches(spark)
    keys = keyed(docs)
    everything, cut = substring_dedup.removals(keys)
    gone = everything.filter("whole").select("rid").union(cut.filter(F.length("kept") == 0).select("rid")).distinct()
    changed = cut.filter(F.length("kept") > 0).select(F.col("rid").alias("__rid"), F.col("kept").alias("__kept"))
    own = docs.withColumn("__own", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    left = own.join(gone.withColumnRenamed("rid", "__rid"), F.col("__own") == F.col("__rid"), "left_anti")
    left = left.join(changed, F.col("__own") == F.col("__rid"), "left")
    new = {"text": F.coalesce("__kept", "text"), "n_chars": F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("__kept").cast("long"))}
    return left.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark window; null and empty texts hold none."""
    bounded_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number and the round trip of every row; null text has null ids."""
    bounded_batches(spark)
    return sentencepiece_fst.report(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("benchmark", benchmark), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"stage-{name}")
    return docs
