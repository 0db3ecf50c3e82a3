"""Scoring and selecting whole candidates.

A pool has one row per candidate: keys ``set_name``, ``id``; ``cand_i`` (draw order); ``words``;
``ref``; the confidence columns; ``e``, the edits against the reference.  Every selector keeps the
first maximum in draw order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import letters, once, word_distance

KEY = ["set_name", "id"]
SCORERS = ["mean_conf", "min_conf", "median_conf", "mean_logprob", "neg_entropy", "len_norm_conf", "mbr_wer", "conf_plus_mbr"]


def pair_distances(pool: DataFrame) -> DataFrame:
    """(key, i, j, d, len_i, len_j) of all candidate pairs i < j of an utterance.

    The candidates of an utterance (a bounded pool) are gathered once, each is spelled once over the
    utterance's alphabet, and the pairs are made within the row: one shuffle, and no join.
    """
    c = F.array_sort(F.collect_list(F.struct(F.col("cand_i").alias("i"), "words")))
    whole = pool.groupBy(*KEY).agg(c.alias("c"))
    spell = lambda alphabet: F.transform("c", lambda x: F.struct(x["i"].alias("i"), letters(x["words"], alphabet).alias("s"), F.size(x["words"]).alias("n")))
    spelled = once(F.array_distinct(F.flatten("c.words")), spell)
    first = whole.select(*KEY, spelled.alias("c")).select(*KEY, "c", F.explode("c").alias("a"))
    both = first.select(*KEY, "a", F.explode(F.filter("c", lambda x: x["i"] > F.col("a.i"))).alias("b"))
    return both.select(*KEY, F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.levenshtein("a.s", "b.s").alias("d"), F.col("a.n").alias("len_i"), F.col("b.n").alias("len_j"))


def mirrored(pairs: DataFrame) -> DataFrame:
    back = pairs.select(*KEY, F.col("j").alias("i"), F.col("i").alias("j"), "d", F.col("len_j").alias("len_i"), F.col("len_i").alias("len_j"))
    return pairs.unionByName(back)


def mbr(pool: DataFrame) -> DataFrame:
    """Adds ``mbr_wer``: minus the mean distance to the others, each over the other's length.  The
    candidates are gathered, compared and spread again, each utterance where it lies."""
    whole = pool.groupBy(*KEY).agg(F.collect_list(F.struct(*pool.columns)).alias("c"))
    spell = lambda alphabet: F.transform("c", lambda x: F.struct(x["cand_i"].alias("i"), letters(x["words"], alphabet).alias("s"), F.size(x["words"]).alias("n")))
    spelled = whole.select(*KEY, "c", once(F.array_distinct(F.flatten("c.words")), spell).alias("o"))
    each = spelled.select(*KEY, F.posexplode("c").alias("_p", "x"), "o").withColumn("own", F.get("o", F.col("_p")))
    each = each.withColumn("o", F.filter("o", lambda y: y["i"] != F.col("own.i")))
    risk = F.aggregate("o", F.lit(0.0), lambda total, y: total + F.levenshtein(F.col("own.s"), y["s"]) / F.greatest(y["n"], F.lit(1)))
    return each.select(*[F.col(c if c in KEY else f"x.{c}") for c in pool.columns], F.when(F.size("o") > 0, -risk / F.size("o")).otherwise(0.0).alias("mbr_wer"))


def with_scores(pool: DataFrame, lam: float = 0.5) -> DataFrame:
    """Adds the eight registered scores."""
    s = mbr(pool)
    return s.withColumns(
        {
            "mean_conf": F.col("avg_conf"),
            "neg_entropy": -F.col("mean_entropy"),
            "len_norm_conf": F.col("avg_conf") * F.log(1.0 + F.col("n_tokens")),
            "conf_plus_mbr": F.col("avg_conf") + lam * F.col("mbr_wer"),
        }
    )


def pick(scored: DataFrame, score: Column | str, digits: int | None = 9) -> DataFrame:
    """One row per utterance: the candidate of the largest score, the first of equals."""
    value = F.col(score) if isinstance(score, str) else score
    w = Window.partitionBy(*KEY).orderBy(F.desc(F.round(value, digits) if digits is not None else value), F.asc("cand_i"))
    return scored.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def scorer_table(scored: DataFrame) -> DataFrame:
    """One row per (utterance, scorer) with the picked candidate, and the pool's least and most edits."""
    best = lambda s: F.max_by(F.struct("cand_i", "e", "ref_len", F.col(s).cast("double").alias("score")), F.struct(F.round(F.col(s).cast("double"), 9), -F.col("cand_i")))
    g = scored.groupBy(*KEY).agg(F.min("e").alias("e_min"), F.max("e").alias("e_max"), *[best(s).alias(s) for s in SCORERS])
    long = g.select(*KEY, "e_min", "e_max", F.explode(F.array(*[F.struct(F.lit(s).alias("scorer"), F.col(s).alias("p")) for s in SCORERS])).alias("x"))
    return long.select(*KEY, "e_min", "e_max", "x.scorer", "x.p.*")


def central_index(pool: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(key, backbone): the candidate of smallest total distance to the others, first of equals."""
    pairs = pair_distances(pool) if pairs is None else pairs
    total = mirrored(pairs).groupBy(*KEY, F.col("i").alias("cand_i")).agg(F.sum("d").alias("total"))
    all_ = pool.select(*KEY, "cand_i").join(total, [*KEY, "cand_i"], "left").na.fill(0, ["total"])
    w = Window.partitionBy(*KEY).orderBy("total", "cand_i")
    return all_.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*KEY, F.col("cand_i").alias("backbone"), "total")


def bounds(pool: DataFrame) -> DataFrame:
    """Per utterance: edits of the first candidate, the best and worst, and a hashed random pick."""
    draw = F.pmod(F.xxhash64(*KEY), F.count("*").over(Window.partitionBy(*KEY)))
    marked = pool.withColumn("_draw", draw)
    return marked.groupBy(*KEY).agg(
        F.first("ref_len").alias("ref_len"),
        F.min("e").alias("e_oracle_cand"),
        F.max("e").alias("e_anti"),
        F.max(F.when(F.col("cand_i") == 0, F.col("e"))).alias("e_first"),
        F.max(F.when(F.col("cand_i") == F.col("_draw"), F.col("e"))).alias("e_random"),
        F.min(F.when(F.col("_best"), F.col("cand_i"))).alias("i_oracle") if "_best" in pool.columns else F.min_by("cand_i", F.struct("e", "cand_i")).alias("i_oracle"),
    )


def diversity(pool: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Per utterance: mean distance of pairs over the second's length, over the longer's, and texts."""
    pairs = pair_distances(pool) if pairs is None else pairs
    mean = pairs.groupBy(*KEY).agg(
        F.avg(F.col("d") / F.greatest("len_j", F.lit(1))).alias("diversity"),
        F.avg(F.col("d") / F.greatest("len_i", "len_j", F.lit(1))).alias("pairwise"),
    )
    texts = pool.groupBy(*KEY).agg(F.countDistinct(F.array_join("words", " ")).alias("n_unique"), F.count("*").alias("n_candidates"))
    return texts.join(mean, KEY, "left").na.fill(0.0, ["diversity", "pairwise"])


def cluster_weights(pool: DataFrame, gamma: float) -> DataFrame:
    """Weight of each candidate by the number of identical ones: size ** (gamma - 1)."""
    size = F.count("*").over(Window.partitionBy(*KEY, "words"))
    return pool.withColumn("dup_size", size).withColumn("weight", F.pow(size.cast("double"), F.lit(gamma - 1.0)))
