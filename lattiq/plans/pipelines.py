"""End-to-end drivers (pool to facts to tables) and the sources and sinks they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as fx
from ..operators import stats, tables
from ..sources import readers, sinks
from ..streaming.ingest import shared_folder
from .fixtures import F1, F2, PAIRS, facts, pool, select_sql, table
from .networks import ALPHAS, EPSES, GAMMAS, LAMBDAS
from .registry import query

_SEL = PAIRS + ", lad AS (SELECT unnest([1, 2, 4, 8]) AS k), pk AS (SELECT cand.*, k FROM cand JOIN lad ON cand_i < k), rk AS (SELECT p.set_name, p.id, k, p.i AS cand_i, -sum(d * 1.0 / greatest(len_j, 1)) / greatest(count(*), 1) AS mbr FROM pairs p JOIN lad ON p.i < k AND p.j < k GROUP BY 1, 2, 3, 4), s AS (SELECT pk.*, coalesce(mbr, 0) AS mbr FROM pk LEFT JOIN rk USING (set_name, id, k, cand_i)), a AS (SELECT *, row_number() OVER (w ORDER BY round(avg_conf, 9) DESC, cand_i) AS r1, row_number() OVER (w ORDER BY round(mbr, 9) DESC, cand_i) AS r2, row_number() OVER (w ORDER BY round(avg_conf + 0.5 * mbr, 9) DESC, cand_i) AS r3 FROM s WINDOW w AS (PARTITION BY set_name, id, k))"


@query("per_utt_k_selection", select_sql(_SEL, "set_name:s; id:b; k:b; ref_len:b=max(ref_len); n_unique:b=count(DISTINCT words); e_first:b=max(e) FILTER (cand_i = 0); e_conf:b=max(e) FILTER (r1 = 1); e_mbr:b=max(e) FILTER (r2 = 1); e_cm05:b=max(e) FILTER (r3 = 1); e_oracle_cand:b=min(e); e_anti:b=max(e)", "FROM a GROUP BY 1, 2, 3"))
def _(spark, d):
    f = fx.per_utterance_k(pool(spark, d), [1, 2, 4, 8])
    return f.select("set_name", "id", "k", "ref_len", "n_unique", "e_first", "e_conf", "e_mbr", "e_cm05", "e_oracle_cand", "e_anti")


@query("per_utt_k")
def _(spark, d):
    return fx.per_utterance_k(pool(spark, d), [1, 2, 4, 8])


@query("ladder_cells")
def _(spark, d):
    """From pool to the cells of the report: rates by set and k."""
    f = fx.per_utterance_k(pool(spark, d), [1, 4, 8])
    cols = ["first", "conf", "mbr", "rover_freq", "rover_c", "rover_cg", "oracle_cand", "oracle_comp"]
    return f.groupBy("set_name", "k").agg(F.count("*").alias("n"), F.avg("pairwise").alias("pairwise"), *[tables.rate(f"e_{c}").alias(c) for c in cols])


@query("ladder_contrasts")
def _(spark, d):
    """Paired and cluster bootstraps of voting against selection at the largest k, pooled over sets."""
    f = fx.per_utterance_k(pool(spark, d), [8]).filter("k = 8").select("set_name", "id", "k", "cluster", "ref_len", "e_conf", "e_rover_cg").persist()
    b = stats.bootstrap(f, ["set_name"], "e_conf", "e_rover_cg", rounds=200).withColumn("method", F.lit("conf"))
    return tables.random_effects(b, ["method"])


@query("parameter_grid")
def _(spark, d):
    g = fx.parameter_grid(pool(spark, d), ALPHAS, EPSES, GAMMAS, LAMBDAS)
    return g.groupBy("param", "alpha", "eps", "gamma", "lam").agg(F.count("*").alias("n"), F.sum("e").alias("e"))


@query("dump_scan", select_sql(F1, "set_name:s; arm:s='flat'; n_utts:b=count(DISTINCT id); n_cands:b=count(*); words:b=sum(n_words)", "FROM cand GROUP BY 1"))
def _(spark, d):
    """Write the pool as gzipped dumps, one folder a set, and scan them with the path's columns."""
    top = shared_folder(spark, "dumps")
    c = F.struct(F.array_join("words", " ").alias("text"), "avg_conf", "min_conf", "median_conf", "mean_logprob", "mean_entropy", "n_tokens", "word_conf", F.col("cand_i").alias("rank"))
    rows = pool(spark, d).groupBy("set_name", "id").agg(F.array_sort(F.collect_list(F.struct("cand_i", c.alias("c")))).alias("x"), F.first(F.array_join("ref", " ")).alias("reference"))
    rows = rows.select(F.concat(F.lit("m__"), "set_name", F.lit("__s00__main")).alias("job"), F.lit("flat").alias("arm_file"), F.col("id").cast("string").alias("id"), F.col("set_name").alias("dataset"), "reference", F.col("x.c").alias("candidates"))
    rows.write.partitionBy("job", "arm_file").option("compression", "gzip").json(top)
    got = readers.dumps(spark, top)
    # Hive-style folders name the job in "job=...".
    job = F.regexp_extract("file", "job=m__(.*?)__s", 1)
    x = got.select(job.alias("set_name"), F.regexp_extract("file", "arm_file=([^/]*)", 1).alias("arm"), "id", F.explode("candidates").alias("c"))
    return x.groupBy("set_name", "arm").agg(F.countDistinct("id").alias("n_utts"), F.count("*").alias("n_cands"), F.sum(F.size(F.filter(F.split("c.text", " "), lambda w: w != ""))).alias("words"))


@query("manifest_scan", select_sql("", "id:s='doc' || doc_id; duration_s:d=n_chars / 100.0", "FROM documents"))
def _(spark, d):
    top = shared_folder(spark, "manifest")
    t = table(spark, d, "documents")
    t.select(F.concat(F.lit("/audio/doc"), F.col("doc_id"), F.lit(".flac")).alias("audio"), "text", (F.col("n_chars") / 100.0).alias("duration_s")).write.json(top)
    return readers.manifest(spark, top).select("id", "duration_s")


@query("comma_index_scan", select_sql("", "line_id:s=p_partkey; file:s='f' || p_partkey; text:s=trim(p_name || ', x,' || p_partkey)", "FROM part WHERE p_name NOT LIKE '%,%'"))
def _(spark, d):
    top = shared_folder(spark, "index")
    p = table(spark, d, "part").filter(~F.col("p_name").contains(","))
    p.select(F.concat(F.col("p_partkey"), F.lit(", f"), F.col("p_partkey"), F.lit(" , "), F.col("p_name"), F.lit(", x,"), F.col("p_partkey"))).union(spark.createDataFrame([("only,two",)], "v string")).write.text(top)
    return readers.comma_index(spark, top)


@query("tab_index_scan", select_sql("", "id:s=c_custkey; duration_s:d=c_custkey * 160 / 16000.0", "FROM customer WHERE c_custkey % 7 <> 0"))
def _(spark, d):
    top = shared_folder(spark, "tsv")
    c = table(spark, d, "customer")
    last = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise((F.col("c_custkey") * 160).cast("string"))
    c.select(F.concat_ws("\t", "c_custkey", F.lit("f"), F.lit("raw"), F.lit("text"), F.lit("w"), last)).write.text(top)
    return readers.tab_index(spark, top).select("id", "duration_s")


@query("fact_files_keep_last", select_sql(F2, "model:s; set_name:s; id:b; k:b; e:b=CASE WHEN id % 3 = 0 THEN e_conf + 100 ELSE e_conf END", "FROM facts"))
def _(spark, d):
    top = shared_folder(spark, "facts")
    f = facts(spark, d).select("model", "set_name", "id", "k", F.col("e_conf").alias("e"))
    f.write.parquet(f"{top}/1")
    f.filter("id % 3 = 0").withColumn("e", F.col("e") + 100).withColumn("extra", F.lit(1)).write.parquet(f"{top}/2")
    return readers.fact_tables(spark, top, ["model", "set_name", "id", "k"]).select("model", "set_name", "id", "k", "e")


@query("append_resume", select_sql("", "event_id:b; value:d", "FROM events"))
def _(spark, d):
    top = shared_folder(spark, "append")
    e = table(spark, d, "events").select("event_id", "value")
    for part in (e.filter("event_id % 2 = 0"), e):
        sinks.append_new(part, top, ["event_id"])
    return spark.read.schema(e.schema).json(top)


@query("upsert_rows", select_sql("", "event_id:b; value:d=CASE WHEN event_id % 5 = 0 THEN -1 ELSE value END", "FROM events"))
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return sinks.upsert(e, e.filter("event_id % 5 = 0").withColumn("value", F.lit(-1.0)), ["event_id"])


@query("partitioned_facts_pruned", select_sql(F2, "id:b; k:b; e_conf:b", "FROM facts WHERE model = 'm1' AND set_name = '1-URGENT'"))
def _(spark, d):
    top = shared_folder(spark, "parts")
    sinks.facts(facts(spark, d), top, ["model", "set_name"])
    return spark.read.parquet(top).filter("model = 'm1' and set_name = '1-URGENT'").select("id", "k", "e_conf")


@query("interval_rows", select_sql(F2, "set_name:s; line:s=printf('conf-vote %+.2f [%+.2f, %+.2f]', 100.0 * (sum(e_conf) - sum(e_rover_cg)) / sum(ref_len), 0.0, 1.0)", "FROM facts GROUP BY 1"))
def _(spark, d):
    f = facts(spark, d).groupBy("set_name").agg((100.0 * (F.sum("e_conf") - F.sum("e_rover_cg")) / F.sum("ref_len")).alias("delta"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return f.select("set_name", sinks.interval_text("conf-vote", "delta", "lo", "hi").alias("line"))
