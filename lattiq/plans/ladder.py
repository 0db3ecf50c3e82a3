"""Queries on the fact ladder F2, set operations, ordering, scheduling tables, and learned policies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import policy, schedule, stats, tables
from .fixtures import F1, F2, facts, pool, select_sql, table
from .registry import query

W_ = "100.0 * sum({0}) / greatest(sum(ref_len), 1)"
KEY = ["model", "set_name", "id", "k"]


def _wer(m: str) -> str:
    return W_.format("e_" + m)


_CELL = "; ".join(f"wer_{m}:d={_wer(m)}; mu_{m}:d=100.0 * avg(e_{m} * 1.0 / greatest(ref_len, 1))" for m in tables.METHODS)


@query("cells", select_sql(F2, f"model:s; set_name:s; k:b; n:b=count(*); words:b=sum(ref_len); audio_min:d=sum(duration_s) / 60; n_clusters:b=count(DISTINCT cluster); pairwise:d=avg(pairwise); {_CELL}; wer_oracle_comp:d=CASE WHEN count(e_oracle_comp) = count(*) THEN {_wer('oracle_comp')} END; beats_best_pct:d=CASE WHEN count(e_oracle_comp) = count(*) THEN 100.0 * avg(CASE WHEN e_oracle_comp < e_oracle_cand THEN 1.0 ELSE 0 END) END", "FROM facts GROUP BY 1, 2, 3"))
def _(spark, d):
    return tables.cells(facts(spark, d), ["model", "set_name", "k"])


@query("contrast_counts", select_sql(F2 + ", ct AS (SELECT model, set_name, k, ref_len, cluster, unnest(['conf', 'mbr', 'first']) AS a, unnest([e_conf, e_mbr, e_first]) AS ea, e_rover_cg AS eb FROM facts)", "model:s; set_name:s; k:b; a:s; b:s='rover_cg'; delta:d=100.0 * (sum(ea) - sum(eb)) / greatest(sum(ref_len), 1); n:b=count(*); n_better:b=count(*) FILTER (eb < ea); n_worse:b=count(*) FILTER (eb > ea); n_tied:b=count(*) FILTER (eb = ea); n_clusters:b=count(DISTINCT cluster)", "FROM ct GROUP BY model, set_name, k, a"))
def _(spark, d):
    return tables.contrast_counts(facts(spark, d), ["model", "set_name", "k"], [("conf", "rover_cg"), ("mbr", "rover_cg"), ("first", "rover_cg")])


_SPECS = [("m0", 2, "rover_cg", "m0", 1, "conf"), ("m1", 3, "mbr", "m1", 1, "first"), ("m2", 4, "rover_cg", "m2", 2, "rover_cg"), ("m0", 7, "oracle_cand", "m0", 1, "mbr")]
_SPEC_COLS = ["model_a", "k_a", "method_a", "model_b", "k_b", "method_b"]


@query("cross_arm", select_sql(F2 + ", sp(model_a, k_a, method_a, model_b, k_b, method_b) AS (VALUES " + ", ".join(str(s) for s in _SPECS) + "), lg AS (SELECT model, set_name, id, k, ref_len, unnest(['first', 'conf', 'mbr', 'rover_cg', 'oracle_cand', 'control']) AS method, unnest([e_first, e_conf, e_mbr, e_rover_cg, e_oracle_cand, e_control]) AS e FROM facts)", "set_name:s=x.set_name; model_a:s; k_a:b; method_a:s; model_b:s; k_b:b; method_b:s; n:b=count(*); delta:d=100.0 * (sum(x.e) - sum(y.e)) / greatest(sum(x.ref_len), 1); n_better:b=count(*) FILTER (y.e < x.e)", "FROM sp JOIN lg x ON x.model = model_a AND x.k = k_a AND x.method = method_a JOIN lg y ON y.model = model_b AND y.k = k_b AND y.method = method_b AND y.set_name = x.set_name AND y.id = x.id GROUP BY ALL"))
def _(spark, d):
    specs = spark.createDataFrame(_SPECS, "model_a string, k_a int, method_a string, model_b string, k_b int, method_b string")
    return tables.cross_arm(facts(spark, d), specs)


@query("paired_join", select_sql(F2, "set_name:s=a.set_name; id:b=a.id; ea:b=a.e_conf; eb:b=b.e_conf; cluster:b=a.cluster", "FROM facts a JOIN facts b ON a.set_name = b.set_name AND a.id = b.id AND a.model = b.model AND a.k = 1 AND b.k = 2"))
def _(spark, d):
    f = facts(spark, d)
    a = f.filter("k = 1").select("model", "set_name", "id", "cluster", F.col("e_conf").alias("ea"))
    b = f.filter("k = 2").select("model", "set_name", "id", F.col("e_conf").alias("eb"))
    return a.join(b, ["model", "set_name", "id"]).drop("model")


_EFF = F2 + ", ef AS (SELECT model, k, set_name, 100.0 * (sum(e_mbr) - sum(e_rover_cg)) / sum(ref_len) AS delta, 0.05 + (count(*) % 17) / 100.0 AS se FROM facts GROUP BY 1, 2, 3), o AS (SELECT model, k, sum(1 / (se * se)) AS sw, sum(1 / pow(se, 4)) AS sw2, sum(delta / (se * se)) AS swd, count(*) AS kk, count(*) FILTER (delta > 0) AS np FROM ef GROUP BY 1, 2), q AS (SELECT model, k, sum(pow(delta - swd / sw, 2) / (se * se)) AS q FROM ef JOIN o USING (model, k) GROUP BY 1, 2), t AS (SELECT model, k, kk, np, q, CASE WHEN kk > 1 THEN greatest(0, (q - (kk - 1)) / (sw - sw2 / sw)) ELSE 0 END AS tau2 FROM o JOIN q USING (model, k)), p AS (SELECT model, k, sum(delta / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS est, sqrt(1 / sum(1 / (se * se + tau2))) AS pse FROM ef JOIN t USING (model, k) GROUP BY 1, 2)"


@query("meta_random_effects", select_sql(_EFF, "model:s; k:b; k_sets:b=kk; pooled:d=est; ci_low:d=est - 1.96 * pse; ci_high:d=est + 1.96 * pse; tau2:d; i2:d=CASE WHEN q > 0 AND kk > 1 THEN greatest(0, (q - (kk - 1)) / q) ELSE 0 END; n_positive:b=np", "FROM t JOIN p USING (model, k)"))
def _(spark, d):
    e = facts(spark, d).groupBy("model", "k", "set_name").agg((100.0 * (F.sum("e_mbr") - F.sum("e_rover_cg")) / F.sum("ref_len")).alias("delta"), (0.05 + (F.count("*") % 17) / 100.0).alias("se"))
    return tables.random_effects(e, ["model", "k"])


_NOISE = "pairwise:d=avg(pairwise); " + "; ".join(f"{m}:d={_wer(m)}" for m in ("first", "conf", "mbr")) + f"; rover:d={_wer('rover_cg')}; gain_vs_mbr:d={_wer('mbr')} - {_wer('rover_cg')}; gain_vs_conf:d={_wer('conf')} - {_wer('rover_cg')}; oracle_cand:d={_wer('oracle_cand')}; control:d={_wer('control')}"


@query("paper_noise", select_sql(F2, f"model:s; condition:s=set_name; n:b=count(*); {_NOISE}", "FROM facts GROUP BY model, set_name"))
def _(spark, d):
    return tables.condition_table(facts(spark, d).withColumn("condition", F.col("set_name")), ["model", "condition"])


@query("paper_cells", select_sql(F2 + ", mk AS (SELECT *, max(k) OVER (PARTITION BY model, set_name, id) AS mx FROM facts)", f"model:s; set_name:s; n:b=count(*); {_NOISE}", "FROM mk WHERE k = mx GROUP BY 1, 2"))
def _(spark, d):
    return tables.condition_table(tables.largest_k(facts(spark, d), ["model", "set_name", "id"]), ["model", "set_name"])


@query("paper_length", select_sql(F2, f"model:s; words:s=CASE WHEN ref_len <= 5 THEN '1-5' WHEN ref_len <= 10 THEN '6-10' WHEN ref_len <= 20 THEN '11-20' ELSE '21+' END; n:b=count(*); mbr:d={_wer('mbr')}; rover:d={_wer('rover_cg')}; gain:d={_wer('mbr')} - {_wer('rover_cg')}", "FROM facts WHERE ref_len > 0 GROUP BY 1, 2"))
def _(spark, d):
    return tables.length_table(facts(spark, d), ["model"], tx.length_bucket_cut("ref_len"))


@query("paper_headroom", select_sql(F2 + f", h AS (SELECT model, count(*) AS n, {_wer('oracle_cand')} AS oc, {_wer('oracle_comp')} AS cp, {_wer('control')} AS ct, 100.0 * avg(CASE WHEN e_oracle_comp < e_oracle_cand THEN 1.0 ELSE 0 END) AS bb FROM facts WHERE e_oracle_comp IS NOT NULL GROUP BY 1)", "model:s; n:b; oracle_cand:d=oc; oracle_comp:d=cp; control:d=ct; real_headroom:d=oc - cp; luck:d=oc - ct; signal_to_luck:d=(oc - cp) / greatest(oc - ct, 1e-9); beats_best_pct:d=bb", "FROM h"))
def _(spark, d):
    return tables.headroom(facts(spark, d), ["model"])


@query("paper_kscale", select_sql(F2, f"model:s; set_name:s; k:b; n:b=count(*); conf:d={_wer('conf')}; mbr:d={_wer('mbr')}; rover:d={_wer('rover_cg')}; oracle_cand:d={_wer('oracle_cand')}; oracle_comp:d=CASE WHEN count(e_oracle_comp) = count(*) THEN {_wer('oracle_comp')} END", "FROM facts GROUP BY 1, 2, 3"))
def _(spark, d):
    return tables.k_scale(facts(spark, d), ["model", "set_name"])


@query("paper_corr", select_sql(F2 + f", c AS (SELECT model, set_name, k, avg(pairwise) AS pairwise, {_wer('mbr')} AS mbr, {_wer('mbr')} - {_wer('rover_cg')} AS gain_vs_mbr, {_wer('conf')} - {_wer('rover_cg')} AS gain_vs_conf FROM facts GROUP BY 1, 2, 3)", "model:s; n_cells:b=count(*); r_gain_pairwise:d=corr(gain_vs_mbr, pairwise); r_gain_baseline:d=corr(gain_vs_mbr, mbr); r_gain_conf_pairwise:d=corr(gain_vs_conf, pairwise)", "FROM c GROUP BY 1 HAVING count(*) >= 4"))
def _(spark, d):
    c = tables.condition_table(facts(spark, d), ["model", "set_name", "k"])
    return tables.correlations(c, ["model"], {"r_gain_pairwise": ("gain_vs_mbr", "pairwise"), "r_gain_baseline": ("gain_vs_mbr", "mbr"), "r_gain_conf_pairwise": ("gain_vs_conf", "pairwise")})


@query("pooled_row", select_sql(F2, f"set_name:s=coalesce(set_name, 'ALL'); n:b=count(*); mbr:d={_wer('mbr')}; rover:d={_wer('rover_cg')}", "FROM facts GROUP BY GROUPING SETS ((set_name), ())"))
def _(spark, d):
    return tables.with_pooled(facts(spark, d), "set_name")


@query("largest_k_rows", select_sql(F2 + ", mk AS (SELECT *, max(k) OVER (PARTITION BY model, set_name) AS mx FROM facts)", f"model:s; set_name:s; k:b; n:b=count(*); rover:d={_wer('rover_cg')}", "FROM mk WHERE k = mx GROUP BY 1, 2, 3"))
def _(spark, d):
    return tables.largest_k(facts(spark, d), ["model", "set_name"]).groupBy("model", "set_name", "k").agg(F.count("*").alias("n"), tables.rate("e_rover_cg").alias("rover"))


@query("k_needed", select_sql(F2 + ", e AS (SELECT *, last_value(e_rover_cg) OVER w AS lst, last_value(e_oracle_comp IGNORE NULLS) OVER w AS ov, greatest(first_value(ref_len) OVER w, 1) AS r FROM facts WINDOW w AS (PARTITION BY model, set_name, id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))", "model:s; set_name:s; id:b; k_needed:b=min(k) FILTER (e_rover_cg <= lst); k_knee:b=CASE WHEN count(e_oracle_comp) > 1 THEN min(k) FILTER (e_oracle_comp IS NOT NULL AND 100.0 * (e_oracle_comp - ov) / r <= 0.5) END", "FROM e GROUP BY 1, 2, 3"))
def _(spark, d):
    return tables.k_labels(facts(spark, d), "e_rover_cg")


@query("cost_curve", select_sql(F2 + f", kc AS (SELECT model, k, {_wer('rover_cg')} AS rover FROM facts GROUP BY 1, 2)", "model:s; k:b; cost_ms:d=CASE WHEN k <= 1 THEN 130 WHEN k <= 3 THEN 130 + (181 - 130) * (k - 1) / 2.0 WHEN k <= 5 THEN 181 + (302 - 181) * (k - 3) / 2.0 ELSE 302 + (599 - 302) * (k - 5) / 5.0 END; rover:d", "FROM kc"))
def _(spark, d):
    # Measured decode cost in milliseconds at k = 1, 3, 5, 10.
    points = [(1, 130.0), (3, 181.0), (5, 302.0), (10, 599.0)]
    cost = F.lit(points[0][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        line = y0 + (y1 - y0) * (F.col("k") - x0) / (x1 - x0)
        cost = line if x1 == points[-1][0] else F.when(F.col("k") <= x1, line).otherwise(cost)
    cost = F.when(F.col("k") <= 1, points[0][1]).otherwise(cost)
    return facts(spark, d).groupBy("model", "k").agg(tables.rate("e_rover_cg").alias("rover")).select("model", "k", cost.alias("cost_ms"), "rover")


@query("iso_quality_k", select_sql(F2 + f", q AS (SELECT model, k, {_wer('mbr')} AS m, {_wer('rover_cg')} AS r FROM facts GROUP BY 1, 2), b AS (SELECT model, min(m) AS bm FROM q GROUP BY 1)", "model:s; best_mbr:d=max(bm); k_iso:b=min(k) FILTER (r <= bm)", "FROM q JOIN b USING (model) GROUP BY 1"))
def _(spark, d):
    q = facts(spark, d).groupBy("model", "k").agg(tables.rate("e_mbr").alias("m"), tables.rate("e_rover_cg").alias("r"))
    q = q.withColumn("bm", F.min("m").over(Window.partitionBy("model")))
    return q.groupBy("model").agg(F.max("bm").alias("best_mbr"), F.min(F.when(F.col("r") <= F.col("bm"), F.col("k"))).alias("k_iso"))


@query("matched_length", select_sql(F2 + ", st AS (SELECT quantile_cont(pairwise, 0.5) AS med FROM facts)", f"n:b=count(*); rover:d={_wer('rover_cg')}", "FROM facts, st WHERE ref_len BETWEEN 10 AND 30 AND abs(pairwise - med) <= 10 HAVING count(*) >= 50"))
def _(spark, d):
    f = facts(spark, d)
    med = f.agg(F.percentile("pairwise", 0.5).alias("med"))
    m = f.crossJoin(F.broadcast(med)).filter(F.col("ref_len").between(10, 30) & (F.abs(F.col("pairwise") - F.col("med")) <= 10))
    return m.agg(F.count("*").alias("n"), tables.rate("e_rover_cg").alias("rover")).filter("n >= 50")


# --- resampling --------------------------------------------------------------------------------


def _draw_sql(*keys: str) -> str:
    """The SQL of ``stats.draw`` with seed 0."""
    x = "(" + " + ".join(f"{k} * {f}" for k, f in zip(keys, (7919, 104729, 15485863))) + f") % {stats.PRIME}"
    x = f"(({x}) * 48271) % {stats.PRIME}"
    return f"((((({x}) * ({x}) + ({x})) % {stats.PRIME}) * 69621) % {stats.PRIME}) / CAST({stats.PRIME} AS DOUBLE)"


_WEIGHT = " + ".join(f"(u >= {p!r})::int" for p in stats.poisson_steps())


def _rounds_sql(name: str, rows: str, by: str, keys: list[str], rounds: int, least: str) -> str:
    """CTEs name_q with the rounds' quantiles, deviation and share of non-positive rates."""
    return f""", {name}_u AS (SELECT *, {_draw_sql(*keys, "rd")} AS u FROM {rows}, range({rounds}) t(rd)),
{name}_r AS (SELECT {by}, rd, 100.0 * sum(d * ({_WEIGHT})) / greatest(sum(w * ({_WEIGHT})), {least}) AS r FROM {name}_u GROUP BY ALL),
{name}_q AS (SELECT {by}, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi, stddev_samp(r) AS se, avg(CASE WHEN r <= 0 THEN 1.0 ELSE 0 END) AS low FROM {name}_r GROUP BY ALL)"""


def _erfc_poly() -> str:
    poly = repr(stats.ERFC[-1])
    for c in reversed(stats.ERFC[:-1]):
        poly = f"(({poly}) * t + {c!r})"
    return poly


def _rank_sql(by: str) -> str:
    """CTE rank_p with the signed-rank p-value of column d of f."""
    return f""", sizes AS (SELECT {by}, abs(d) AS v, count(*)::double AS m, count(*) FILTER (d > 0) AS up FROM f WHERE d <> 0 GROUP BY ALL),
ranks AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY {by} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (m + 1) / 2 AS rk FROM sizes),
tests AS (SELECT {by}, sum(up * rk) AS plus, sum(m) AS n, sum(m * m * m - m) AS ties FROM ranks GROUP BY ALL),
vars AS (SELECT *, n * (n + 1) / 4 AS half, n * (n + 1) / 4 * (2 * n + 1) / 6 - ties / 48 AS var FROM tests),
rank_z AS (SELECT {by}, CASE WHEN var > 0 THEN abs(plus - half) / sqrt(var) / sqrt(2.0) END AS z FROM vars),
rank_p AS (SELECT {by}, least(1.0, t * exp({_erfc_poly()} - z * z)) AS p FROM (SELECT *, 1.0 / (1.0 + 0.5 * z) AS t FROM rank_z))"""


_F_K2 = F2 + ", f AS (SELECT model, set_name, id, k, cluster, e_conf - e_rover_cg AS d, ref_len AS w FROM facts WHERE k = 2)"
_G_K2 = ", g AS (SELECT model, set_name, cluster, sum(d) AS d, sum(w) AS w FROM f GROUP BY ALL)"
_CELLS = ", c AS (SELECT model, set_name, 100.0 * sum(d) / sum(w) AS delta, count(*) AS n, count(*) FILTER (d > 0) AS n_better, count(*) FILTER (d < 0) AS n_worse, count(*) FILTER (d = 0) AS n_tied, count(DISTINCT cluster) AS n_clusters FROM f GROUP BY ALL HAVING sum(w) > 0)"
_PAIRED = _F_K2 + _G_K2 + _CELLS + _rounds_sql("one", "f", "model, set_name", ["id", "k"], 500, "1e-12") + _rounds_sql("cl", "g", "model, set_name", ["cluster"], 500, "1.0") + _rank_sql("model, set_name")


@query("bootstrap_paired", select_sql(_PAIRED, "model:s; set_name:s; delta:d; ci_low:d=one_q.lo; ci_high:d=one_q.hi; se:d=one_q.se; p_boot:d=one_q.low; n:b; n_better:b; n_worse:b; n_tied:b; p_wilcoxon:d=CASE WHEN n = n_tied THEN 1.0 ELSE p END; n_clusters:b; cl_ci_low:d=CASE WHEN n_clusters >= 5 AND n_clusters < n THEN cl_q.lo END; cl_ci_high:d=CASE WHEN n_clusters >= 5 AND n_clusters < n THEN cl_q.hi END", "FROM c JOIN one_q USING (model, set_name) JOIN cl_q USING (model, set_name) LEFT JOIN rank_p USING (model, set_name)"))
def _(spark, d):
    return stats.bootstrap(facts(spark, d).filter("k = 2"), ["model", "set_name"], "e_conf", "e_rover_cg", rounds=500)


@query("bootstrap_point", select_sql(F2, "model:s; set_name:s; delta:d=100.0 * (sum(e_conf) - sum(e_rover_cg)) / sum(ref_len); n:b=count(*); n_better:b=count(*) FILTER (e_rover_cg < e_conf); n_worse:b=count(*) FILTER (e_rover_cg > e_conf); n_tied:b=count(*) FILTER (e_rover_cg = e_conf); n_clusters:b=count(DISTINCT cluster)", "FROM facts WHERE k = 3 GROUP BY 1, 2"))
def _(spark, d):
    return stats.bootstrap(facts(spark, d).filter("k = 3"), ["model", "set_name"], "e_conf", "e_rover_cg", rounds=50).select("model", "set_name", "delta", "n", "n_better", "n_worse", "n_tied", "n_clusters")


@query("bootstrap_hash", select_sql(F2 + ", r AS (SELECT model, rd, 100.0 * (sum(e_mbr * w) - sum(e_rover_cg * w)) / greatest(sum(ref_len * w), 1) AS d FROM (SELECT *, ((id * 31 + rd * 17 + k * 7) % 23) % 4 AS w FROM facts, range(40) t(rd)) GROUP BY 1, 2)", "model:s; rounds:b=count(*); mean:d=avg(d); ci_low:d=quantile_cont(d, 0.025); ci_high:d=quantile_cont(d, 0.975); p_no_gain:d=avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0 END)", "FROM r GROUP BY 1"))
def _(spark, d):
    w = ((F.col("id") * 31 + F.col("round") * 17 + F.col("k") * 7) % 23) % 4
    return stats.hash_bootstrap(facts(spark, d), ["model"], "e_mbr", "e_rover_cg", 40, w)


@query("tuning_bootstrap", select_sql(F2 + ", g AS (SELECT id % 2 AS half, k, rd, sum(e_mbr * w) * 1.0 / greatest(sum(ref_len * w), 1) AS x FROM (SELECT *, ((id * 13 + rd * 29) % 19) % 3 AS w FROM facts, range(20) t(rd)) WHERE id % 2 = 0 GROUP BY 1, 2, 3), b AS (SELECT rd, k FROM g QUALIFY row_number() OVER (PARTITION BY rd ORDER BY round(x, 12), k) = 1), t AS (SELECT k, 100.0 * sum(e_mbr) / sum(ref_len) AS wer FROM facts WHERE id % 2 = 1 GROUP BY 1)", "k:b; chosen:b=count(*); test_wer:d=max(wer)", "FROM b JOIN t USING (k) GROUP BY 1"))
def _(spark, d):
    """Resample the development half, choose k again each time, score the fixed other half."""
    f = facts(spark, d)
    r = f.filter("id % 2 = 0").withColumn("rd", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("w", ((F.col("id") * 13 + F.col("rd") * 29) % 19) % 3)
    g = r.groupBy("rd", "k").agg((F.sum(F.col("e_mbr") * F.col("w")) / F.greatest(F.sum(F.col("ref_len") * F.col("w")), F.lit(1))).alias("x"))
    b = g.withColumn("_rn", F.row_number().over(Window.partitionBy("rd").orderBy(F.round("x", 12), "k"))).filter("_rn = 1")
    t = f.filter("id % 2 = 1").groupBy("k").agg((100.0 * F.sum("e_mbr") / F.sum("ref_len")).alias("wer"))
    return b.groupBy("k").agg(F.count("*").alias("chosen")).join(t, "k").select("k", "chosen", F.col("wer").alias("test_wer"))


@query("wilcoxon", select_sql(F2 + ", f AS (SELECT model, e_conf - e_mbr AS d FROM facts WHERE k = 1)" + _rank_sql("model"), "model:s; n:b=any_value(n0); p_wilcoxon:d=CASE WHEN any_value(zeros) = any_value(n0) THEN 1.0 ELSE max(p) END", "FROM (SELECT model, count(*) AS n0, count(*) FILTER (d = 0) AS zeros FROM f GROUP BY 1) LEFT JOIN rank_p USING (model) GROUP BY 1"))
def _(spark, d):
    return stats.bootstrap(facts(spark, d).filter("k = 1"), ["model"], "e_conf", "e_mbr", rounds=50).select("model", "n", "p_wilcoxon")


@query("preregistered_checks", select_sql(F2 + ", s AS (SELECT model, k % 3 AS seed, 100.0 * (sum(e_mbr) - sum(e_rover_cg)) / sum(ref_len) AS d FROM facts GROUP BY 1, 2)", "model:s; verdict:s=CASE WHEN bool_and(d > 0) THEN 'PASS' ELSE 'FAIL' END; worst:d=min(d)", "FROM s GROUP BY 1"))
def _(spark, d):
    s = facts(spark, d).groupBy("model", (F.col("k") % 3).alias("seed")).agg((100.0 * (F.sum("e_mbr") - F.sum("e_rover_cg")) / F.sum("ref_len")).alias("d"))
    return s.groupBy("model").agg(F.when(F.bool_and(F.col("d") > 0), "PASS").otherwise("FAIL").alias("verdict"), F.min("d").alias("worst"))


@query("set_folds", select_sql(F2 + ", fo(set_name, fold) AS (SELECT set_name, row_number() OVER (ORDER BY set_name) % 3 FROM (SELECT DISTINCT set_name FROM facts)), x AS (SELECT a.fold, f.k, sum(e_mbr) AS e, sum(ref_len) AS r FROM (SELECT DISTINCT fold FROM fo) a JOIN fo ON fo.fold <> a.fold JOIN facts f ON f.set_name = fo.set_name GROUP BY 1, 2), b AS (SELECT fold, k FROM x QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(e * 1.0 / r, 12), k) = 1)", "fold:b=b.fold; k:b=b.k; test_wer:d=100.0 * sum(e_mbr) / sum(ref_len)", "FROM b JOIN fo ON fo.fold = b.fold JOIN facts f ON f.set_name = fo.set_name AND f.k = b.k GROUP BY 1, 2"))
def _(spark, d):
    f = facts(spark, d)
    sets = f.select("set_name").distinct()
    folds = sets.withColumn("fold", F.row_number().over(Window.orderBy("set_name")) % 3)
    s = f.join(F.broadcast(folds), "set_name").groupBy("fold", "k").agg(F.sum("e_mbr").alias("e"), F.sum("ref_len").alias("r"))
    w = Window.partitionBy("k")
    x = s.withColumn("x", (F.sum("e").over(w) - F.col("e")) / (F.sum("r").over(w) - F.col("r")))
    b = x.withColumn("_rn", F.row_number().over(Window.partitionBy("fold").orderBy(F.round("x", 12), "k"))).filter("_rn = 1")
    return b.select("fold", "k", (100.0 * F.col("e") / F.col("r")).alias("test_wer"))


# --- joins, sets, order ------------------------------------------------------------------------


@query("present_in_all_arms", select_sql(F2, "model:s; set_name:s; id:b", "FROM facts WHERE k IN (1, 2, 3) GROUP BY 1, 2, 3 HAVING count(DISTINCT k) = 3"))
def _(spark, d):
    return facts(spark, d).filter("k in (1, 2, 3)").groupBy("model", "set_name", "id").agg(F.countDistinct("k").alias("m")).filter("m = 3").drop("m")


@query("resume_anti_join", select_sql(F2, "set_name:s; id:b", "FROM facts a WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM facts b WHERE b.k = 2 AND b.set_name = a.set_name AND b.id = a.id)"))
def _(spark, d):
    f = facts(spark, d).select("set_name", "id", "k")
    return f.filter("k = 1").join(f.filter("k = 2"), ["set_name", "id"], "left_anti").select("set_name", "id")


@query("train_test_disjoint", select_sql(F2, "overlap:b=count(*)", "FROM (SELECT id FROM facts WHERE cluster % 2 = 0 INTERSECT SELECT id FROM facts WHERE cluster % 2 = 1)"))
def _(spark, d):
    f = facts(spark, d)
    return f.filter("cluster % 2 = 0").select("id").intersect(f.filter("cluster % 2 = 1").select("id")).agg(F.count("*").alias("overlap"))


@query("features_labels_join", select_sql(F1 + ", l AS (SELECT id, set_name, min(cand_i) FILTER (e = 0) AS k_needed FROM cand GROUP BY 1, 2)", "set_name:s; id:b; k_needed:b; n_tokens:b", "FROM cand JOIN l USING (set_name, id) WHERE cand_i = 0"))
def _(spark, d):
    p = pool(spark, d)
    l = p.groupBy("set_name", "id").agg(F.min(F.when(F.col("e") == 0, F.col("cand_i"))).alias("k_needed"))
    return p.filter("cand_i = 0").select("set_name", "id", "n_tokens").join(l, ["set_name", "id"])


@query("merge_sessions", select_sql("WITH a AS (SELECT event_id AS id, value, 1 AS pri FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, value * 2, 2 FROM events WHERE event_id % 2 = 0), f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY pri) = 1), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY pri DESC) = 1)", "id:b=f.id; first_wins:d=f.value; last_wins:d=l.value", "FROM f JOIN l USING (id)"))
def _(spark, d):
    e = table(spark, d, "events")
    a = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("id"), "value", F.lit(1).alias("pri")).unionByName(e.filter("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("value") * 2).alias("value"), F.lit(2).alias("pri")))
    return a.groupBy("id").agg(F.min_by("value", "pri").alias("first_wins"), F.max_by("value", "pri").alias("last_wins"))


@query("dedupe_keep_last", select_sql("", "l_orderkey:b; l_linenumber:b; l_extendedprice:d", "FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_quantity DESC) = 1"))
def _(spark, d):
    last = F.max(F.struct("l_shipdate", "l_extendedprice", "l_quantity")).alias("x")
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(last).select("l_orderkey", "l_linenumber", "x.l_extendedprice")


@query("round_robin", select_sql("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)", "source:s; doc_id:b; turn:b=rn; place:b=row_number() OVER (PARTITION BY rn ORDER BY source)", "FROM r"))
def _(spark, d):
    r = table(spark, d, "documents").withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return r.select("source", "doc_id", "turn", F.row_number().over(Window.partitionBy("turn").orderBy("source")).alias("place"))


@query("first_n_per_set", select_sql("", "source:s; doc_id:b", "FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10"))
def _(spark, d):
    r = table(spark, d, "documents").withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return r.filter("rn <= 10").select("source", "doc_id")


@query("schema_union", select_sql("", "id:b=doc_id; lang:s; url:s=NULL", "FROM documents UNION ALL SELECT page_id, NULL, url FROM pages"))
def _(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return a.unionByName(table(spark, d, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query("not_yet_done", select_sql("", "event_id:b", "FROM (SELECT event_id FROM events EXCEPT SELECT event_id FROM events WHERE event_id % 4 = 0)"))
def _(spark, d):
    e = table(spark, d, "events").select("event_id")
    return e.subtract(e.filter("event_id % 4 = 0"))


@query("mode_first_seen", select_sql("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)", "user_id:b; event_type:s; n:b", "FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1"))
def _(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "f")
    return c.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "event_type", "n")


@query("rank_to_quantile", select_sql("WITH r AS (SELECT source, doc_id, n_chars, (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) * 1.0 / greatest(count(*) OVER (PARTITION BY source) - 1, 1) AS u FROM documents)", "source:s; doc_id:b; u:d", "FROM r"))
def _(spark, d):
    w = Window.partitionBy("source")
    return table(spark, d, "documents").select("source", "doc_id", ((F.row_number().over(w.orderBy("n_chars", "doc_id")) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))).alias("u"))


@query("cumulative_minimum", select_sql(F2, "model:s; set_name:s; id:b; k:b; best_so_far:b=min(e_mbr) OVER (PARTITION BY model, set_name, id ORDER BY k ROWS UNBOUNDED PRECEDING)", "FROM facts"))
def _(spark, d):
    w = Window.partitionBy("model", "set_name", "id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return facts(spark, d).select(*KEY, F.min("e_mbr").over(w).alias("best_so_far"))


@query("nearest_rung", select_sql("WITH w AS (SELECT doc_id, n_chars / 100.0 AS want FROM documents)", "doc_id:b; k:b=list_sort([{'d': abs(want - 1), 'k': 1}, {'d': abs(want - 2), 'k': 2}, {'d': abs(want - 4), 'k': 4}, {'d': abs(want - 8), 'k': 8}, {'d': abs(want - 16), 'k': 16}])[1].k", "FROM w"))
def _(spark, d):
    want = F.col("n_chars") / 100.0
    return table(spark, d, "documents").select("doc_id", F.array_min(F.array(*[F.struct(F.abs(want - k).alias("d"), F.lit(k).alias("k")) for k in (1, 2, 4, 8, 16)]))["k"].alias("k"))


_TOK = "WITH t AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\\s]', '', 'g'), '\\s+'), lambda w: w <> '') AS w FROM documents), b AS (SELECT coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY i), '<s>') AS prev, x AS cur FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t))"


def _bigrams(spark, d):
    clean = F.regexp_replace(F.lower("text"), r"[^a-z0-9_\s]", "")
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    t = table(spark, d, "documents").select(F.concat(F.array(F.lit("<s>")), words).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("prev"), F.get("w", i).alias("cur")))
    return t.filter(F.size("w") > 1).select(F.explode(pairs).alias("p")).select("p.prev", "p.cur")


@query("bigram_counts", select_sql(_TOK, "prev:s; cur:s; n:b=count(*)", "FROM b GROUP BY 1, 2"))
def _(spark, d):
    return _bigrams(spark, d).groupBy("prev", "cur").agg(F.count("*").alias("n"))


@query("bigram_scores", select_sql(_TOK + ", c AS (SELECT prev, cur, count(*) AS n FROM b GROUP BY 1, 2), u AS (SELECT prev, sum(n) AS m FROM c GROUP BY 1), v AS (SELECT count(*) AS v FROM u)", "prev:s; cur:s; score:d=ln((n + 0.1) / (m + 0.1 * v)) / 12", "FROM c JOIN u USING (prev), v"))
def _(spark, d):
    c = _bigrams(spark, d).groupBy("prev", "cur").agg(F.count("*").alias("n"))
    u = c.groupBy("prev").agg(F.sum("n").alias("m"))
    v = u.agg(F.count("*").alias("v"))
    return c.join(u, "prev").crossJoin(F.broadcast(v)).select("prev", "cur", (F.log((F.col("n") + 0.1) / (F.col("m") + 0.1 * F.col("v"))) / 12).alias("score"))


# --- scheduling --------------------------------------------------------------------------------

_PLAN = "WITH s AS (SELECT n_name AS set_name, n_nationkey AS nk, n_regionkey AS rk, 200 + n_nationkey * 37 AS total FROM nation), m(model, tier, lang) AS (VALUES ('drax', 0, -1), ('whisper', 1, -1), ('ctc', 2, 1)), sh AS (SELECT unnest(range(6)) AS shard), j AS (SELECT model || '__' || set_name || '__s' || printf('%02d', shard) || '__main' AS job, model, set_name, shard, tier, nk, total FROM s JOIN m ON lang = -1 OR lang = rk JOIN sh ON shard < (total + 199) // 200)"


@query("plan_full", select_sql(_PLAN, "job:s; model:s; set_name:s; shard:b; tier:b; expected:b=least(200, total - shard * 200); ord:b=row_number() OVER (ORDER BY tier, shard, nk, model) - 1", "FROM j"))
def _(spark, d):
    return schedule.plan(_sets(spark, d), _models(spark)).select("job", "model", "set_name", "shard", "tier", "expected", "ord")


def _sets(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("set_name"), F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("lang"), (200 + F.col("n_nationkey") * 37).alias("total"))


def _models(spark):
    return spark.createDataFrame([("drax", 0, -1), ("whisper", 1, -1), ("ctc", 2, 1)], "model string, tier int, only_lang int")


_STATUS = _PLAN + ", x AS (SELECT *, CASE WHEN (nk * 7 + shard) % 5 = 0 THEN 'done' WHEN (nk * 7 + shard) % 5 = 1 THEN 'claimed' WHEN (nk * 7 + shard) % 5 = 2 AND tier = 1 THEN 'dead' WHEN nk % 4 = 3 THEN 'waiting' ELSE 'ready' END AS status FROM j)"


def _statuses(spark, d):
    p = schedule.plan(_sets(spark, d), _models(spark))
    h = (F.col("place") * 7 + F.col("shard")) % 5
    done, claimed = p.filter(h == 0).select("job"), p.filter(h.isin(0, 1)).select("job")
    dead = p.filter(h.isin(0, 2) & (F.col("tier") == 1)).select("job")
    return schedule.status(p, done, claimed, dead, p.filter("place % 4 <> 3").select("set_name").distinct())


@query("job_status", select_sql(_STATUS, "status:s; tier:b; n:b=count(*)", "FROM x GROUP BY 1, 2"))
def _(spark, d):
    return _statuses(spark, d).groupBy("status", "tier").agg(F.count("*").alias("n"))


@query("progress_by_model", select_sql(_STATUS, "model:s; n_jobs:b=count(*); n_done:b=count(*) FILTER (status = 'done'); min_ready_tier:b=min(tier) FILTER (status = 'ready')", "FROM x GROUP BY 1"))
def _(spark, d):
    return schedule.progress(_statuses(spark, d))


@query("timing", select_sql(_PLAN + ", dn AS (SELECT model, 'main' AS kind, unnest(['main', 'greedy']) AS arm, unnest([16, 1]) AS k, 100 + shard AS n_ok, 60.0 * (nk + 1) AS audio_s, (10.0 + shard) / 2 AS enc, unnest([5.0 + nk, 1.0 * shard]) AS dec, 1000.0 + nk AS mb FROM j), ag AS (SELECT model, kind, arm, max(k) AS k, sum(n_ok) AS n, sum(audio_s) AS audio_s, sum(enc) AS enc, sum(dec) AS dec, max(mb) AS mb FROM dn GROUP BY 1, 2, 3)", "model:s; kind:s; arm:s; k:b; n:b; audio_h:d=audio_s / 3600; s_per_utt:d=(enc + dec) / n; encode_s_per_utt:d=enc / n; decode_s_per_utt:d=dec / n; rtf:d=(enc + dec) / audio_s; rtf_decode:d=dec / audio_s; ms_per_candidate:d=1000 * dec / n / greatest(k, 1); peak_mem_mb:d=mb", "FROM ag"))
def _(spark, d):
    p = schedule.plan(_sets(spark, d), _models(spark))
    arms = F.array(F.struct(F.lit("main").alias("name"), F.lit(16).alias("k")), F.struct(F.lit("greedy").alias("name"), F.lit(1).alias("k")))
    done = p.select("model", F.lit("main").alias("kind"), arms.alias("arms"), (100 + F.col("shard")).alias("n_ok"), (60.0 * (F.col("place") + 1)).alias("audio_s"), (10.0 + F.col("shard")).alias("encode_s"), F.create_map(F.lit("main"), 5.0 + F.col("place"), F.lit("greedy"), 1.0 * F.col("shard")).alias("decode_s"), (1000.0 + F.col("place")).alias("peak_mem_mb"))
    return tables.timing(done)


# --- learned -----------------------------------------------------------------------------------


def _features(spark, d):
    from ..operators.learn import slot_features
    from .networks import positional_votes

    return slot_features(positional_votes(spark, d))


@query("slot_lr_fit")
def _(spark, d):
    from ..operators.learn import FEATURES, apply_slot_model, fit_slot_model

    f = _features(spark, d)
    w = fit_slot_model(f.filter("cluster < 10"), FEATURES, rounds=25)
    p = apply_slot_model(f.filter("cluster >= 10"), w)
    return p.groupBy("set_name").agg(F.count("*").alias("n"), F.count_if(F.col("word") == F.col("ref_word")).alias("right"))


@query("crf_viterbi")
def _(spark, d):
    from ..operators.learn import chain_decode, train_chain

    f = _features(spark, d)
    w, step = train_chain(f.filter("cluster < 10"), ["share", "mean_conf", "is_eps", "is_top"], epochs=2)
    p = chain_decode(f.filter("cluster >= 10"), w, step, gold=True)
    return p.groupBy("set_name").agg(F.count("*").alias("n"), F.count_if(F.col("word") == F.col("ref_word")).alias("right"))


@query("knn_rank")
def _(spark, d):
    from ..operators.learn import nearest_mean
    from ..operators.select import mbr, pick

    p = mbr(pool(spark, d))
    feats = ["avg_conf", "mean_logprob", "mbr_wer"]
    est = nearest_mean(p.filter("cluster < 8"), p.filter("cluster >= 8"), feats, "e", 15, ("e", "ref_len"))
    return pick(est, -F.col("estimate")).groupBy("set_name").agg(F.count("*").alias("n"), tables.rate("e").alias("wer"))


@query("boosted_stumps")
def _(spark, d):
    """Depth-1 boosted trees on 'this word is the reference', the best word of each slot."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = ["share", "mean_conf", "is_eps", "is_top", "margin"]
    f = VectorAssembler(inputCols=names, outputCol="x").transform(_features(spark, d))
    m = GBTClassifier(featuresCol="x", labelCol="gold", maxDepth=1, maxIter=8, stepSize=0.3, seed=1).fit(f.filter("cluster < 10"))
    s = m.transform(f.filter("cluster >= 10")).withColumn("p", F.round(vector_to_array("probability")[1], 9))
    w = Window.partitionBy("set_name", "id", "slot").orderBy(F.desc("p"), "ord")
    return s.withColumn("rn", F.row_number().over(w)).filter("rn = 1").groupBy("set_name").agg(F.count("*").alias("n"), F.count_if(F.col("word") == F.col("ref_word")).alias("right"))


@query("width_model")
def _(spark, d):
    p = pool(spark, d).filter("cand_i = 0")
    labels = pool(spark, d).groupBy("set_name", "id").agg(F.min_by("cand_i", F.struct("e", "cand_i")).alias("i")).select("set_name", "id", (F.col("i") + 1).alias("k_needed"))
    rows = p.join(labels, ["set_name", "id"])
    feats = ["duration_s", "n_tokens", "avg_conf", "mean_logprob"]
    fit = policy.normal_equations(rows.filter("cluster < 20"), feats, F.log(F.col("k_needed").cast("double")))
    return policy.predict_width(rows.filter("cluster >= 20"), feats, fit, rows.filter("cluster < 20"), [1, 2, 3, 4, 5, 6, 8], ["set_name"]).select("set_name", "id", "k", "k_needed")


@query("stitch_versus_vote")
def _(spark, d):
    """Error rates of the one-switch stitch of best slot scores and of voting, per set."""
    from ..operators import utterance as utt
    from .networks import ALPHA, EPS, per_utterance

    def fn(r, _, steps):
        v = utt.votes(r, steps)
        words, _ = utt.stitch(r["order"], *utt.micro(r["words"], steps), *v)
        return [(r["set_name"], len(r["ref"]), utt.edits(r["ref"], words), utt.edits(r["ref"], utt.hypothesis(utt.picks(*v, ALPHA, EPS))))]

    x = per_utterance(spark, d, fn, "set_name string, r long, es long, er long")
    return x.groupBy("set_name").agg(F.count("*").alias("n"), (100.0 * F.sum("es") / F.sum("r")).alias("stitch_wer"), (100.0 * F.sum("er") / F.sum("r")).alias("rover_wer"))


@query("collision_test", select_sql(F1 + ", p AS (SELECT a.set_name, a.id, abs(a.avg_conf - b.avg_conf) + abs(a.mean_entropy - b.mean_entropy) AS d, abs(a.e - b.e) AS de FROM cand a JOIN cand b ON a.set_name = b.set_name AND a.id = b.id AND a.cand_i < b.cand_i), q AS (SELECT *, percent_rank() OVER (PARTITION BY set_name ORDER BY round(d, 9)) AS u FROM p)", "set_name:s; near:d=avg(de) FILTER (u <= 0.05); overall:d=avg(de)", "FROM q GROUP BY 1"))
def _(spark, d):
    """Pairs are made within their utterance's row; a rank needs only how often each difference occurs."""
    c = pool(spark, d).groupBy("set_name", "id").agg(F.collect_list(F.struct("cand_i", "avg_conf", "mean_entropy", "e")).alias("c"))
    both = c.select("set_name", "c", F.explode("c").alias("a")).select("set_name", "a", F.explode(F.filter("c", lambda x: x["cand_i"] > F.col("a.cand_i"))).alias("b"))
    gap = lambda v: F.abs(F.col(f"a.{v}") - F.col(f"b.{v}"))
    x = both.groupBy("set_name", F.round(gap("avg_conf") + gap("mean_entropy"), 9).alias("d")).agg(F.count("*").alias("n"), F.sum(gap("e")).alias("de"))
    w = Window.partitionBy("set_name")
    before = F.coalesce(F.sum("n").over(w.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("u", F.coalesce(F.try_divide(before, F.sum("n").over(w) - 1), F.lit(0.0)))
    near = lambda v: F.sum(F.when(F.col("u") <= 0.05, F.col(v)))
    return x.groupBy("set_name").agg((near("de") / near("n")).alias("near"), (F.sum("de") / F.sum("n")).alias("overall"))


@query("ctc_collapse")
def _(spark, d):
    path = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.pmod(F.floor((F.col("doc_id") + i) / 3), F.lit(5)).cast("int"))
    conf = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.pmod(F.col("doc_id") * 7 + i * 3, F.lit(11)) / 11.0)
    runs = table(spark, d, "documents").select("doc_id", tx.collapse_runs(path, conf, 0).alias("r"))
    return runs.select("doc_id", F.posexplode("r").alias("pos", "x")).select("doc_id", "pos", "x.token", "x.conf")


@query("token_stats", select_sql("WITH t AS (SELECT doc_id, list_transform(range(0, doc_id % 7), lambda i: ((doc_id * 13 + i * 29) % 97 + 1) / 98.0) AS p FROM documents)", "doc_id:b; mean_p:d=coalesce(list_avg(p), 0); min_p:d=coalesce(list_min(p), 0); median_p:d=coalesce(list_median(p), 0); mean_logprob:d=coalesce(list_avg(list_transform(p, lambda x: ln(x))), -20); n_tokens:b=len(p)", "FROM t"))
def _(spark, d):
    p = F.filter(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(i < F.col("doc_id") % 7, ((F.col("doc_id") * 13 + i * 29) % 97 + 1) / 98.0)), lambda x: x.isNotNull())
    t = table(spark, d, "documents").select("doc_id", p.alias("p"))
    from ..functions.arrays import mean_of, median_of

    return t.select("doc_id", F.coalesce(mean_of("p"), F.lit(0.0)).alias("mean_p"), F.coalesce(F.array_min("p"), F.lit(0.0)).alias("min_p"), F.coalesce(median_of("p"), F.lit(0.0)).alias("median_p"), F.coalesce(mean_of(F.transform("p", lambda x: F.log(x))), F.lit(-20.0)).alias("mean_logprob"), F.size("p").alias("n_tokens"))


@query("char_similarity", select_sql("", "n_name:s; r_name:s; sim:d=1.0 - levenshtein(n_name, r_name) * 1.0 / greatest(length(n_name), length(r_name), 1)", "FROM nation, region"))
def _(spark, d):
    n, r = table(spark, d, "nation").select("n_name"), table(spark, d, "region").select("r_name")
    return n.crossJoin(F.broadcast(r)).select("n_name", "r_name", tx.char_similarity("n_name", "r_name").alias("sim"))


@query("stream_ingest_dedupe", select_sql("", "event_type:s; n:b=count(DISTINCT event_id)", "FROM events GROUP BY 1"))
def _(spark, d):
    from ..streaming.ingest import replay

    return replay(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "event_id").groupBy("event_type").agg(F.count("*").alias("n"))
