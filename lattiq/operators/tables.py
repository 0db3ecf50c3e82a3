"""Aggregates over the per-utterance-k fact table.

Facts have keys (model, set_name, id, k), ``cluster``, ``ref_len`` and edit counts ``e_*``.  All
tables are algebraic aggregates: partial sums are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tasks import FACT_BYTES, dealt

METHODS = ["first", "conf", "mbr", "rover_cg", "oracle_cand", "control"]


def rate(edits: str, words: str = "ref_len") -> Column:
    """Corpus word error rate in percent: a ratio of sums."""
    return 100.0 * F.sum(edits) / F.greatest(F.sum(words), F.lit(1))


def whole(column: str, value: Column) -> Column:
    """The value only where no row of the group lacks the column."""
    return F.when(F.count(column) == F.count("*"), value)


def mean_clipped(edits: str, words: str = "ref_len") -> Column:
    """Mean of per-utterance rates, references of no words counted as one."""
    return 100.0 * F.avg(F.col(edits) / F.greatest(words, F.lit(1)))


def cells(facts: DataFrame, by: list[str]) -> DataFrame:
    """Rates of every cell.  Clusters are counted by summing each cell's clusters first, a cluster in one
    task; nothing keeps the distinct ones of a cell."""
    share = lambda m: F.col(f"e_{m}") / F.greatest("ref_len", F.lit(1))
    better = (F.col("e_oracle_comp") < F.col("e_oracle_cand")).cast("double")
    sums = {"words": F.sum("ref_len"), "audio": F.sum("duration_s"), "pair": F.sum("pairwise"), "n_pair": F.count("pairwise"), "comp": F.sum("e_oracle_comp"), "n_comp": F.count("e_oracle_comp"), "better": F.sum(better), "n_better": F.count(better)}
    for m in METHODS:
        sums |= {f"s_{m}": F.sum(f"e_{m}"), f"m_{m}": F.sum(share(m)), f"n_{m}": F.count(share(m))}
    parts = dealt(facts, FACT_BYTES, "cluster").groupBy(*by, "cluster").agg(F.count("*").alias("n"), *[v.alias(f"_{c}") for c, v in sums.items()])
    c = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.count("cluster").alias("n_clusters"), *[F.sum(f"_{c}").alias(f"_{c}") for c in sums])
    pct = lambda v: 100.0 * F.col(v) / F.greatest("_words", F.lit(1))
    out = ["n", F.col("_words").alias("words"), (F.col("_audio") / 60).alias("audio_min"), "n_clusters", F.try_divide("_pair", "_n_pair").alias("pairwise")]
    for m in METHODS:
        out += [pct(f"_s_{m}").alias(f"wer_{m}"), (100.0 * F.try_divide(f"_m_{m}", f"_n_{m}")).alias(f"mu_{m}")]
    all_ = F.col("_n_comp") == F.col("n")
    out += [F.when(all_, pct("_comp")).alias("wer_oracle_comp"), F.when(all_, 100.0 * F.try_divide("_better", "_n_better")).alias("beats_best_pct")]
    return c.select(*by, *out)


def contrast_counts(facts: DataFrame, by: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Per group and pair (a, b) of methods: rate difference and wins, losses, ties of b over a.  Summed
    by cluster first, as in ``cells``."""
    sign = lambda a, b, f: F.count_if(f(F.col(f"e_{b}"), F.col(f"e_{a}")))
    arm = lambda a, b: F.struct((F.sum(f"e_{a}") - F.sum(f"e_{b}")).alias("gap"), sign(a, b, lambda y, x: y < x).alias("better"), sign(a, b, lambda y, x: y > x).alias("worse"), sign(a, b, lambda y, x: y == x).alias("tied"))
    parts = dealt(facts, FACT_BYTES, "cluster").groupBy(*by, "cluster").agg(F.count("*").alias("n"), F.sum("ref_len").alias("words"), *[arm(*p).alias(f"p{i}") for i, p in enumerate(pairs)])
    fields = ["gap", "better", "worse", "tied"]
    c = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.count("cluster").alias("n_clusters"), *[F.struct(*[F.sum(f"p{i}.{f}").alias(f) for f in fields]).alias(f"p{i}") for i in range(len(pairs))])
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("p")) for i, (a, b) in enumerate(pairs)])).alias("x")
    delta = (100.0 * F.col("x.p.gap") / F.greatest("words", F.lit(1))).alias("delta")
    return c.select(*by, "n", "words", "n_clusters", arms).select(*by, "x.a", "x.b", delta, "n", F.col("x.p.better").alias("n_better"), F.col("x.p.worse").alias("n_worse"), F.col("x.p.tied").alias("n_tied"), "n_clusters")


def cross_arm(facts: DataFrame, specs: DataFrame) -> DataFrame:
    """Paired comparisons across arms: specs has model_a, k_a, method_a, model_b, k_b, method_b.

    Both sides are unpivoted facts met on (set_name, id); a small specification table is joined
    first, so only the requested slices reach the pairing.
    """
    long = facts.select("model", "set_name", "id", "k", "ref_len", F.explode(F.create_map(*[x for m in METHODS for x in (F.lit(m), F.col(f"e_{m}"))])).alias("method", "e"))
    side = lambda s: long.select(*[F.col(c).alias(f"{c}_{s}") for c in ("model", "k", "method", "e", "ref_len")], "set_name", "id")
    spec = F.broadcast(specs)
    a = side("a").join(spec, ["model_a", "k_a", "method_a"])
    both = a.join(side("b"), ["set_name", "id", "model_b", "k_b", "method_b"])
    return both.groupBy("set_name", "model_a", "k_a", "method_a", "model_b", "k_b", "method_b").agg(
        F.count("*").alias("n"), (100.0 * (F.sum("e_a") - F.sum("e_b")) / F.greatest(F.sum("ref_len_a"), F.lit(1))).alias("delta"), F.count_if(F.col("e_b") < F.col("e_a")).alias("n_better")
    )


def random_effects(effects: DataFrame, by: list[str]) -> DataFrame:
    """DerSimonian-Laird pooling of (delta, se) rows: sums in two passes over the group."""
    e = effects.filter("se > 0").withColumn("w", F.try_divide(F.lit(1.0), F.col("se") * F.col("se")))
    one = e.groupBy(*by).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("delta")).alias("swd"), F.count("*").alias("k_sets"), F.count_if(F.col("delta") > 0).alias("n_positive"))
    x = e.join(one, by)
    q = x.groupBy(*by).agg(F.sum(F.col("w") * F.pow(F.col("delta") - F.col("swd") / F.col("sw"), F.lit(2.0))).alias("q"))
    spread = one.join(q, by).withColumn("tau2", F.when(F.col("k_sets") > 1, F.greatest(F.lit(0.0), F.try_divide(F.col("q") - (F.col("k_sets") - 1), F.col("sw") - F.col("sw2") / F.col("sw")))).otherwise(0.0))
    y = e.join(spread.select(*by, "tau2"), by).withColumn("wr", F.try_divide(F.lit(1.0), F.col("se") * F.col("se") + F.col("tau2")))
    pooled = y.groupBy(*by).agg((F.sum(F.col("wr") * F.col("delta")) / F.sum("wr")).alias("pooled"), F.sqrt(1.0 / F.sum("wr")).alias("pooled_se"))
    i2 = F.when((F.col("q") > 0) & (F.col("k_sets") > 1), F.greatest(F.lit(0.0), F.try_divide(F.col("q") - (F.col("k_sets") - 1), F.col("q")))).otherwise(0.0)
    return spread.join(pooled, by).select(*by, "k_sets", "pooled", (F.col("pooled") - 1.96 * F.col("pooled_se")).alias("ci_low"), (F.col("pooled") + 1.96 * F.col("pooled_se")).alias("ci_high"), "tau2", i2.alias("i2"), "n_positive")


def tuned(grid: DataFrame, dev: Column, params: list[str], by: list[str]) -> DataFrame:
    """Parameters of the smallest rate on the development rows (the smallest key of equals), and the
    rate they give on the others, from one pass over the grid."""
    on = lambda c, rows: F.sum(F.when(rows, F.col(c)))
    sums = grid.groupBy(*by, *params).agg((on("e", dev) / F.greatest(on("ref_len", dev), F.lit(1))).alias("r"), F.count_if(dev).alias("n_dev"), F.count_if(~dev).alias("n"), (100.0 * on("e", ~dev) / F.greatest(on("ref_len", ~dev), F.lit(1))).alias("test_wer"))
    w = Window.partitionBy(*by).orderBy(F.round("r", 12), *params)
    best = sums.filter("n_dev > 0").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1 and n > 0")
    return best.select(*by, *params, (100.0 * F.col("r")).alias("dev_wer"), "n", "test_wer")


def timing(done: DataFrame, facts_ms: DataFrame | None = None) -> DataFrame:
    """Cost per arm from done markers joined with their plan: done has model, kind, arms
    (array<struct<name, k>>), n_ok, audio_s, encode_s, decode_s (map), peak_mem_mb.  Encoding time is
    shared evenly by a job's arms."""
    x = done.withColumn("n_arms", F.greatest(F.size("arms"), F.lit(1))).select("*", F.explode("arms").alias("arm"))
    d = x.groupBy("model", "kind", F.col("arm.name").alias("arm")).agg(
        F.max("arm.k").alias("k"), F.sum("n_ok").alias("n"), F.sum("audio_s").alias("audio_s"), F.sum(F.col("encode_s") / F.col("n_arms")).alias("enc"), F.sum(F.coalesce(F.try_element_at("decode_s", F.col("arm.name")), F.lit(0.0))).alias("dec"), F.max("peak_mem_mb").alias("peak_mem_mb")
    )
    per = lambda v: v / F.col("n")
    audio = F.greatest("audio_s", F.lit(1e-9))
    out = d.filter("n > 0").select(
        "model", "kind", "arm", "k", "n", (F.col("audio_s") / 3600).alias("audio_h"), per(F.col("enc") + F.col("dec")).alias("s_per_utt"), per(F.col("enc")).alias("encode_s_per_utt"), per(F.col("dec")).alias("decode_s_per_utt"),
        ((F.col("enc") + F.col("dec")) / audio).alias("rtf"), (F.col("dec") / audio).alias("rtf_decode"), (1000 * F.col("dec") / F.col("n") / F.greatest("k", F.lit(1))).alias("ms_per_candidate"), "peak_mem_mb",
    )
    return out if facts_ms is None else out.join(facts_ms, ["model", "arm", "kind"], "left")


def condition_table(facts: DataFrame, by: list[str]) -> DataFrame:
    """Rates by condition with the gains of voting over selection (noise ladders and cells)."""
    gain = lambda m: rate(f"e_{m}") - rate("e_rover_cg")
    return facts.groupBy(*by).agg(F.count("*").alias("n"), F.avg("pairwise").alias("pairwise"), *[rate(f"e_{m}").alias(m) for m in ("first", "conf", "mbr")], rate("e_rover_cg").alias("rover"), gain("mbr").alias("gain_vs_mbr"), gain("conf").alias("gain_vs_conf"), rate("e_oracle_cand").alias("oracle_cand"), rate("e_control").alias("control"))


def length_table(facts: DataFrame, by: list[str], bucket: Column) -> DataFrame:
    b = facts.withColumn("words", bucket).filter("words is not null")
    return b.groupBy(*by, "words").agg(F.count("*").alias("n"), rate("e_mbr").alias("mbr"), rate("e_rover_cg").alias("rover"), (rate("e_mbr") - rate("e_rover_cg")).alias("gain"))


def headroom(facts: DataFrame, by: list[str]) -> DataFrame:
    """What the composition oracle gains over the best candidate, against what a control gains."""
    g = facts.filter("e_oracle_comp is not null").groupBy(*by).agg(F.count("*").alias("n"), rate("e_oracle_cand").alias("oracle_cand"), rate("e_oracle_comp").alias("oracle_comp"), rate("e_control").alias("control"), (100.0 * F.avg((F.col("e_oracle_comp") < F.col("e_oracle_cand")).cast("double"))).alias("beats_best_pct"))
    real, luck = F.col("oracle_cand") - F.col("oracle_comp"), F.col("oracle_cand") - F.col("control")
    return g.withColumns({"real_headroom": real, "luck": luck, "signal_to_luck": real / F.greatest(luck, F.lit(1e-9))})


def k_scale(facts: DataFrame, by: list[str]) -> DataFrame:
    return facts.groupBy(*by, "k").agg(F.count("*").alias("n"), rate("e_conf").alias("conf"), rate("e_mbr").alias("mbr"), rate("e_rover_cg").alias("rover"), rate("e_oracle_cand").alias("oracle_cand"), whole("e_oracle_comp", rate("e_oracle_comp")).alias("oracle_comp"))


def correlations(cells_: DataFrame, by: list[str], pairs: dict[str, tuple[str, str]], least: int = 4) -> DataFrame:
    """Pearson correlations over cells, for groups of at least ``least``; null where a side is constant."""

    def r(x: str, y: str) -> Column:
        return F.when((F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.covar_pop(x, y) / F.greatest(F.stddev_pop(x) * F.stddev_pop(y), F.lit(1e-300)))

    return cells_.groupBy(*by).agg(F.count("*").alias("n_cells"), *[r(*p).alias(name) for name, p in pairs.items()]).filter(F.col("n_cells") >= least)


def with_pooled(facts: DataFrame, by: str, label: str = "ALL") -> DataFrame:
    """Rates per group and a pooled row, in one pass by grouping sets."""
    g = facts.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).alias("_all"), F.count("*").alias("n"), rate("e_mbr").alias("mbr"), rate("e_rover_cg").alias("rover"))
    return g.withColumn(by, F.when(F.col("_all") == 1, label).otherwise(F.col(by))).drop("_all")


def largest_k(facts: DataFrame, by: list[str]) -> DataFrame:
    return facts.withColumn("_m", F.max("k").over(Window.partitionBy(*by))).filter("k = _m").drop("_m")


def k_labels(facts: DataFrame, metric: str, tolerance: float = 0.5) -> DataFrame:
    """Per utterance: the smallest k as good as the largest, and the knee of the composition oracle."""
    w = Window.partitionBy("model", "set_name", "id")
    end = w.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = facts.withColumn("last", F.last(metric).over(end)).withColumn("ov_last", F.last("e_oracle_comp", True).over(end)).withColumn("r", F.greatest(F.first("ref_len").over(end), F.lit(1)))
    near = F.col("e_oracle_comp").isNotNull() & (100.0 * (F.col("e_oracle_comp") - F.col("ov_last")) / F.col("r") <= tolerance)
    out = x.groupBy("model", "set_name", "id").agg(F.min(F.when(F.col(metric) <= F.col("last"), F.col("k"))).alias("k_needed"), F.min(F.when(near, F.col("k"))).alias("knee"), F.count("e_oracle_comp").alias("n_oracle"))
    return out.withColumn("k_knee", F.when(F.col("n_oracle") > 1, F.col("knee"))).drop("knee", "n_oracle")


def sweep_table(facts: DataFrame, by: list[str], setting: str) -> DataFrame:
    """Rates along a swept setting of each arm, at the largest k of all facts."""
    top = facts.agg(F.max("k").alias("_top"))
    x = facts.join(F.broadcast(top), F.col("k") == F.col("_top"))
    names = {"first": "first", "conf": "conf", "mbr": "mbr", "rover": "rover_cg", "oracle_cand": "oracle_cand", "oracle_comp": "oracle_comp"}
    return x.groupBy(*by, setting).agg(F.count("*").alias("n"), F.avg("pairwise").alias("pairwise"), *[whole(f"e_{c}", rate(f"e_{c}")).alias(n) for n, c in names.items()])


def top_weights(weights: DataFrame, name: str, weight: str, n: int) -> DataFrame:
    """The n features of largest absolute weight, ties by name (a report)."""
    return weights.orderBy(F.desc(F.abs(weight)), name).limit(n)


def split_half(grid: DataFrame, params: list[str], splits: int, side: Column) -> DataFrame:
    """Every split's two halves, each read with the parameters that were best on the other half.

    ``grid`` has cluster, params, e and ref_len; ``side`` is 0 or 1 from the columns cluster and split.
    Clusters are summed before they are dealt, so the shuffle has a row for each cluster and parameter.
    Equal error counts go to the smallest parameters.
    """
    sums = grid.groupBy("cluster", *params).agg(F.sum("e").alias("e"), F.sum("ref_len").alias("ref_len"))
    dealt = sums.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("half", side.cast("int"))
    halves = dealt.groupBy("split", "half", *params).agg(F.sum("e").alias("e"), F.sum("ref_len").alias("ref_len"))
    w = Window.partitionBy("split", "half").orderBy("e", *params)
    best = halves.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("split", (1 - F.col("half")).alias("half"), *params)
    return halves.join(best, ["split", "half", *params])
