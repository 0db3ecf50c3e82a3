"""Queries on the candidate pool: text, filters, buckets, selectors, diversity, ladders, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import select as sel
from ..operators import stats, tables
from .fixtures import F1, F2, PAIRS, pool, select_sql, table
from .fixtures import facts as facts_of
from .registry import query

KEY = sel.KEY


@query("norm_word_count", select_sql("", "doc_id:b; n_words:b=len(w); normalized:s=array_to_string(w, ' ')", "FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\\s]', '', 'g'), '\\s+'), lambda w: w <> '') AS w FROM documents WHERE lang = 'en' AND NOT regexp_matches(text, '[^\x00-\x7F]'))"))
def _(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en'").filter(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return docs.select("doc_id", tx.n_words("text").alias("n_words"), tx.normalize("text").alias("normalized"))


@query("quality_filter_rank", select_sql("WITH x AS (SELECT doc_id, source, n_chars / 100.0 AS dur, len(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\\s]', '', 'g'), '\\s+'), lambda w: w <> '')) AS n FROM documents WHERE lang = 'en')", "source:s; doc_id:b; rank:b=row_number() OVER (PARTITION BY source ORDER BY (doc_id * 7919) % 10007, doc_id) - 1", "FROM x WHERE dur BETWEEN 0.8 AND 28 AND n BETWEEN 1 AND 75 QUALIFY row_number() OVER (PARTITION BY source ORDER BY (doc_id * 7919) % 10007, doc_id) <= 20"))
def _(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en'").filter(tx.keep_utterance(F.col("n_chars") / 100.0, tx.n_words("text")))
    w = Window.partitionBy("source").orderBy((F.col("doc_id") * 7919) % 10007, "doc_id")
    return docs.select("source", "doc_id", (F.row_number().over(w) - 1).alias("rank")).filter("rank < 20")


@query("crc_order_shard", None)
def _(spark, d):
    docs = table(spark, d, "documents").select("source", F.concat(F.lit("doc-"), F.col("doc_id")).alias("uid"))
    w = Window.partitionBy("source").orderBy(tx.order_key("uid", "pool-1"), "uid")
    return docs.select("source", "uid", tx.utterance_seed(1234, "uid", F.lit("main")).alias("seed"), (F.row_number().over(w) - 1).alias("rank")).withColumn("shard", F.floor(F.col("rank") / 200))


@query("max_duration_filter", select_sql("", "doc_id:b; duration_s:d=n_chars / 100.0", "FROM documents WHERE n_chars / 100.0 <= 20"))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 100.0).alias("duration_s")).filter("duration_s <= 20")


@query("shard_slice", select_sql("WITH x AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank FROM documents)", "source:s; shard:b=rank // 25; n:b=count(*); first_id:b=min(doc_id); last_id:b=max(doc_id)", "FROM x GROUP BY source, rank // 25"))
def _(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    x = table(spark, d, "documents").withColumn("rank", F.row_number().over(w) - 1)
    return x.groupBy("source", F.floor(F.col("rank") / 25).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("safe_names", None)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_name("url").alias("file_name"))


@query("cluster_of", select_sql("WITH x AS (SELECT doc_id, doc_id % 5 AS m, CASE doc_id % 5 WHEN 0 THEN doc_id || '-17-' || n_chars WHEN 1 THEN 'amie-es' || (1000 + doc_id % 9000) || 'a_x' WHEN 2 THEN 'call' || doc_id || '_S3' WHEN 3 THEN 'p' || doc_id || '_rest_more' ELSE 'dir' || doc_id || '/file' END AS uid FROM documents)", "doc_id:b; cluster:s=CASE m WHEN 0 THEN split_part(uid, '-', 1) WHEN 1 THEN upper(regexp_extract(uid, '([A-Za-z]{2}\\d{4}[a-z]?)', 1)) WHEN 2 THEN split_part(uid, '_S', 1) WHEN 3 THEN split_part(uid, '_', 1) ELSE split_part(uid, '/', 1) END", "FROM x"))
def _(spark, d):
    i, m = F.col("doc_id"), F.col("doc_id") % 5
    s = lambda x: F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    uid = F.when(m == 0, F.concat(s(i), F.lit("-17-"), s("n_chars"))).when(m == 1, F.concat(F.lit("amie-es"), s(1000 + i % 9000), F.lit("a_x"))).when(m == 2, F.concat(F.lit("call"), s(i), F.lit("_S3"))).when(m == 3, F.concat(F.lit("p"), s(i), F.lit("_rest_more"))).otherwise(F.concat(F.lit("dir"), s(i), F.lit("/file")))
    kind = F.when(m == 0, "speaker").when(m == 1, "meeting").when(m == 2, "call").when(m == 3, "underscore").otherwise("path")
    return table(spark, d, "documents").select("doc_id", tx.cluster_of(kind, uid).alias("cluster"))


@query("duration_buckets", select_sql(F1, "bucket:s=CASE WHEN duration_s >= 0 AND duration_s < 10 THEN '0-10s' WHEN duration_s >= 10 AND duration_s < 20 THEN '10-20s' WHEN duration_s >= 20 AND duration_s < 30 THEN '20-30s' ELSE '30s+' END; n:b=count(*); wer:d=100.0 * sum(e) / greatest(sum(ref_len), 1)", "FROM cand GROUP BY 1"))
def _(spark, d):
    return pool(spark, d).groupBy(tx.duration_bucket("duration_s").alias("bucket")).agg(F.count("*").alias("n"), tables.rate("e").alias("wer"))


@query("length_buckets_closed", select_sql(F1, "bucket:s=CASE WHEN n_words < 6 THEN '1-5' WHEN n_words < 11 THEN '6-10' WHEN n_words < 21 THEN '11-20' ELSE '21+' END; n:b=count(*); wer:d=100.0 * sum(e) / greatest(sum(ref_len), 1)", "FROM cand GROUP BY 1"))
def _(spark, d):
    return pool(spark, d).groupBy(tx.length_bucket_closed("n_words").alias("bucket")).agg(F.count("*").alias("n"), tables.rate("e").alias("wer"))


@query("length_buckets_cut", select_sql(F1, "bucket:s=CASE WHEN n_words <= 5 THEN '1-5' WHEN n_words <= 10 THEN '6-10' WHEN n_words <= 20 THEN '11-20' ELSE '21+' END; n:b=count(*)", "FROM cand WHERE n_words > 0 GROUP BY 1"))
def _(spark, d):
    return pool(spark, d).withColumn("bucket", tx.length_bucket_cut("n_words")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


@query("quartile_buckets", select_sql(F1 + ", u AS (SELECT set_name, id, duration_s, row_number() OVER (PARTITION BY set_name ORDER BY duration_s, id) - 1 AS rn, count(*) OVER (PARTITION BY set_name) AS n FROM cand WHERE cand_i = 0), ed AS (SELECT set_name, max(CASE WHEN rn = n * 1 // 4 THEN duration_s END) AS a, max(CASE WHEN rn = n * 2 // 4 THEN duration_s END) AS b, max(CASE WHEN rn = n * 3 // 4 THEN duration_s END) AS c FROM u GROUP BY 1)", "set_name:s=u.set_name; quartile:b=CASE WHEN duration_s < a THEN 0 WHEN duration_s < b THEN 1 WHEN duration_s < c THEN 2 ELSE 3 END; n:b=count(*)", "FROM u JOIN ed USING (set_name) GROUP BY 1, 2"))
def _(spark, d):
    u = pool(spark, d).filter("cand_i = 0").select("set_name", "id", "duration_s")
    w = Window.partitionBy("set_name")
    u = u.withColumn("rn", F.row_number().over(w.orderBy("duration_s", "id")) - 1).withColumn("n", F.count("*").over(w))
    edge = lambda i: F.max(F.when(F.col("rn") == F.floor(F.col("n") * i / 4), F.col("duration_s"))).over(w)
    q = F.when(F.col("duration_s") < edge(1), 0).when(F.col("duration_s") < edge(2), 1).when(F.col("duration_s") < edge(3), 2).otherwise(3)
    return u.withColumn("quartile", q).groupBy("set_name", "quartile").agg(F.count("*").alias("n"))


@query("pool_edits", select_sql(F1, "set_name:s; id:b; cand_i:b; ref_len:b; n_words:b; e:b", "FROM cand"))
def _(spark, d):
    return pool(spark, d).select(*KEY, "cand_i", "ref_len", "n_words", "e")


@query("utt_wer", select_sql(F1, "set_name:s; id:b; cand_i:b; wer:d=CASE WHEN ref_len = 0 THEN CASE WHEN n_words = 0 THEN 0 ELSE 1 END ELSE e * 1.0 / ref_len END", "FROM cand"))
def _(spark, d):
    return pool(spark, d).select(*KEY, "cand_i", tx.wer("e", "ref_len", "n_words").alias("wer"))


@query("corpus_wer", select_sql(F1, "set_name:s; cand_i:b; corpus_wer:d=100.0 * sum(e) / greatest(sum(ref_len), 1); mean_utt_wer:d=100.0 * avg(e * 1.0 / ref_len); mu_clip_wer:d=100.0 * avg(e * 1.0 / greatest(ref_len, 1))", "FROM cand GROUP BY 1, 2"))
def _(spark, d):
    p = pool(spark, d)
    return p.groupBy("set_name", "cand_i").agg(tables.rate("e").alias("corpus_wer"), (100.0 * F.avg(tx.wer("e", "ref_len", "n_words"))).alias("mean_utt_wer"), tables.mean_clipped("e").alias("mu_clip_wer"))


_PICKS = {"pick_conf": "avg_conf", "pick_minconf": "min_conf", "pick_medianconf": "median_conf", "pick_logprob": "mean_logprob", "pick_neg_entropy": "-mean_entropy", "pick_len_norm": "avg_conf * ln(1.0 + n_tokens)"}
for _name, _expr in _PICKS.items():

    def _pick(spark, d, expr=_expr):
        return sel.pick(pool(spark, d), F.expr(expr)).select(*KEY, "cand_i", "e")

    query(_name, select_sql(F1, "set_name:s; id:b; cand_i:b; e:b", f"FROM cand QUALIFY row_number() OVER (PARTITION BY set_name, id ORDER BY round({_expr}, 9) DESC, cand_i) = 1"))(_pick)


@query("mbr_scores", select_sql(PAIRS, "set_name:s; id:b; cand_i:b; mbr_wer:d", "FROM risk"))
def _(spark, d):
    return sel.mbr(pool(spark, d)).select(*KEY, "cand_i", "mbr_wer")


@query("pick_mbr", select_sql(PAIRS, "set_name:s; id:b; cand_i:b; e:b", "FROM scored QUALIFY row_number() OVER (PARTITION BY set_name, id ORDER BY round(mbr_wer, 9) DESC, cand_i) = 1"))
def _(spark, d):
    return sel.pick(sel.mbr(pool(spark, d)), "mbr_wer").select(*KEY, "cand_i", "e")


@query("pick_conf_plus_mbr", select_sql(PAIRS, "set_name:s; id:b; cand_i:b; e:b", "FROM scored QUALIFY row_number() OVER (PARTITION BY set_name, id ORDER BY round(conf_plus_mbr, 9) DESC, cand_i) = 1"))
def _(spark, d):
    return sel.pick(sel.with_scores(pool(spark, d)), "conf_plus_mbr").select(*KEY, "cand_i", "e")


_LONG = PAIRS + ", long AS (SELECT set_name, id, cand_i, e, ref_len, unnest(['" + "', '".join(sel.SCORERS) + "']) AS scorer, unnest([" + ", ".join(f"CAST({s} AS DOUBLE)" for s in sel.SCORERS) + "]) AS score FROM scored), best AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY set_name, id, scorer ORDER BY round(score, 9) DESC, cand_i) = 1)"


@query("scorer_table", select_sql(_LONG, "set_name:s; scorer:s; n:b=count(*); corpus_wer:d=100.0 * sum(e) / greatest(sum(ref_len), 1)", "FROM best GROUP BY 1, 2"))
def _(spark, d):
    return sel.scorer_table(sel.with_scores(pool(spark, d))).groupBy("set_name", "scorer").agg(F.count("*").alias("n"), tables.rate("e").alias("corpus_wer"))


_ORACLE = ", orc AS (SELECT set_name, id, min(e) AS e_min, max(e) AS e_max FROM cand GROUP BY 1, 2)"


@query("oracle_gap", select_sql(_LONG + _ORACLE + ", j AS (SELECT best.*, e_min, e_max FROM best JOIN orc USING (set_name, id))", "scorer:s; n:b=count(*); corpus_wer:d=100.0 * sum(e) / greatest(sum(ref_len), 1); mean_utt_wer:d=100.0 * avg(e * 1.0 / ref_len); hit_pct:d=100.0 * avg(CASE WHEN e = e_min THEN 1.0 ELSE 0 END); mean_gap:d=100.0 * avg((e - e_min) * 1.0 / ref_len); p50:d=quantile_cont(100.0 * (e - e_min) / ref_len, 0.5); p90:d=quantile_cont(100.0 * (e - e_min) / ref_len, 0.9); p99:d=quantile_cont(100.0 * (e - e_min) / ref_len, 0.99); max_gap:d=max(100.0 * (e - e_min) / ref_len); flat_pct:d=100.0 * avg(CASE WHEN e_min = e_max THEN 1.0 ELSE 0 END)", "FROM j GROUP BY 1"))
def _(spark, d):
    best = sel.scorer_table(sel.with_scores(pool(spark, d)))
    gap = 100.0 * (F.col("e") - F.col("e_min")) / F.col("ref_len")
    return best.groupBy("scorer").agg(
        F.count("*").alias("n"), tables.rate("e").alias("corpus_wer"), (100.0 * F.avg(F.col("e") / F.col("ref_len"))).alias("mean_utt_wer"), (100.0 * F.avg((F.col("e") == F.col("e_min")).cast("double"))).alias("hit_pct"),
        F.avg(gap).alias("mean_gap"), F.percentile(gap, 0.5).alias("p50"), F.percentile(gap, 0.9).alias("p90"), F.percentile(gap, 0.99).alias("p99"), F.max(gap).alias("max_gap"), (100.0 * F.avg((F.col("e_min") == F.col("e_max")).cast("double"))).alias("flat_pct"),
    )


@query("go_stop_verdict", select_sql(_LONG + _ORACLE + ", g AS (SELECT 100.0 * sum(e) / sum(ref_len) AS conf, 100.0 * sum(e_min) / sum(ref_len) AS orc FROM best JOIN orc USING (set_name, id) WHERE scorer = 'mean_conf')", "conf:d; oracle:d=orc; headroom:d=conf - orc; verdict:s=CASE WHEN conf - orc >= 1.0 THEN 'go' ELSE 'stop' END", "FROM g"))
def _(spark, d):
    p = pool(spark, d)
    best = sel.pick(p, "avg_conf").join(p.groupBy(*KEY).agg(F.min("e").alias("e_min")), KEY)
    g = best.agg((100.0 * F.sum("e") / F.sum("ref_len")).alias("conf"), (100.0 * F.sum("e_min") / F.sum("ref_len")).alias("oracle"))
    return g.withColumn("headroom", F.col("conf") - F.col("oracle")).withColumn("verdict", F.when(F.col("headroom") >= 1.0, "go").otherwise("stop"))


@query("central_index", select_sql(PAIRS, "set_name:s; id:b; backbone:b=cand_i; total:b=total", "FROM risk QUALIFY row_number() OVER (PARTITION BY set_name, id ORDER BY total, cand_i) = 1"))
def _(spark, d):
    return sel.central_index(pool(spark, d))


@query("oracle_anti_first", select_sql(F1, "set_name:s; id:b; e_oracle_cand:b=min(e); e_anti:b=max(e); e_first:b=max(CASE WHEN cand_i = 0 THEN e END); i_oracle:b=min(cand_i) FILTER (e = m)", "FROM (SELECT *, min(e) OVER (PARTITION BY set_name, id) AS m FROM cand) GROUP BY 1, 2"))
def _(spark, d):
    return sel.bounds(pool(spark, d)).select(*KEY, "e_oracle_cand", "e_anti", "e_first", "i_oracle")


@query("random_pick", None)
def _(spark, d):
    return sel.bounds(pool(spark, d)).select(*KEY, "e_random", "e_oracle_cand", "e_anti")


@query("diversity", select_sql(PAIRS + ", dv AS (SELECT set_name, id, avg(d * 1.0 / greatest(len_j, 1)) AS diversity, avg(d * 1.0 / greatest(len_i, len_j, 1)) AS pairwise FROM pairs WHERE i < j GROUP BY 1, 2), un AS (SELECT set_name, id, count(DISTINCT array_to_string(words, ' ')) AS n_unique, count(*) AS n_candidates FROM cand GROUP BY 1, 2)", "set_name:s; id:b; n_unique:b; n_candidates:b; diversity:d; pairwise:d", "FROM un JOIN dv USING (set_name, id)"))
def _(spark, d):
    return sel.diversity(pool(spark, d))


@query("cluster_weights_exact", select_sql(F1, "set_name:s; id:b; cand_i:b; dup_size:b=count(*) OVER (PARTITION BY set_name, id, words); weight:d=pow(count(*) OVER (PARTITION BY set_name, id, words), -0.5)", "FROM cand"))
def _(spark, d):
    return sel.cluster_weights(pool(spark, d), 0.5).select(*KEY, "cand_i", "dup_size", "weight")


@query("duplicate_sizes", select_sql(F1 + ", x AS (SELECT set_name, id, words, count(*) AS m FROM cand GROUP BY 1, 2, 3)", "dup_size:b=m; n_texts:b=count(*); n_utts:b=count(DISTINCT id)", "FROM x GROUP BY m"))
def _(spark, d):
    return pool(spark, d).groupBy(*KEY, "words").agg(F.count("*").alias("dup_size")).groupBy("dup_size").agg(F.count("*").alias("n_texts"), F.countDistinct("id").alias("n_utts"))


_LADDER = [1, 2, 3, 4, 5, 6, 8]


@query("k_ladder", select_sql(PAIRS + ", lad AS (SELECT unnest([1, 2, 3, 4, 5, 6, 8]) AS k), pk AS (SELECT cand.*, k FROM cand JOIN lad ON cand_i < k), rk AS (SELECT p.set_name, p.id, k, p.i AS cand_i, -sum(d * 1.0 / greatest(len_j, 1)) / greatest(count(*), 1) AS mbr FROM pairs p JOIN lad ON p.i < k AND p.j < k GROUP BY 1, 2, 3, 4), s AS (SELECT pk.*, coalesce(mbr, 0) AS mbr FROM pk LEFT JOIN rk USING (set_name, id, k, cand_i)), a AS (SELECT set_name, id, k, ref_len, e, row_number() OVER (PARTITION BY set_name, id, k ORDER BY round(avg_conf, 9) DESC, cand_i) AS rc, row_number() OVER (PARTITION BY set_name, id, k ORDER BY round(mbr, 9) DESC, cand_i) AS rm, min(e) OVER (PARTITION BY set_name, id, k) AS mn FROM s)", "set_name:s; k:b; conf:d=100.0 * sum(e) FILTER (rc = 1) / sum(ref_len) FILTER (rc = 1); mbr:d=100.0 * sum(e) FILTER (rm = 1) / sum(ref_len) FILTER (rm = 1); oracle:d=100.0 * sum(mn) FILTER (rc = 1) / sum(ref_len) FILTER (rc = 1)", "FROM a GROUP BY 1, 2"))
def _(spark, d):
    p = pool(spark, d).select(*KEY, "cand_i", "words", "avg_conf", "e", "ref_len")
    k = F.explode(F.filter(F.array(*[F.lit(x) for x in _LADDER]), lambda x: x > F.col("last"))).alias("k")
    steps = p.withColumn("last", F.col("cand_i")).select("*", k).drop("last", "words")
    pairs = sel.mirrored(sel.pair_distances(p)).withColumn("last", F.greatest("i", "j")).select("*", k)
    risk = pairs.groupBy(*KEY, "k", F.col("i").alias("cand_i")).agg((-F.sum(F.col("d") / F.greatest("len_j", F.lit(1))) / F.greatest(F.count("*"), F.lit(1))).alias("mbr"))
    s = steps.join(risk, [*KEY, "k", "cand_i"], "left").na.fill(0.0, ["mbr"])
    w = Window.partitionBy(*KEY, "k")
    s = s.withColumns({"rc": F.row_number().over(w.orderBy(F.desc(F.round("avg_conf", 9)), "cand_i")), "rm": F.row_number().over(w.orderBy(F.desc(F.round("mbr", 9)), "cand_i")), "mn": F.min("e").over(w)})
    pct = lambda c, r: 100.0 * F.sum(F.when(F.col(r) == 1, F.col(c))) / F.sum(F.when(F.col(r) == 1, F.col("ref_len")))
    return s.groupBy("set_name", "k").agg(pct("e", "rc").alias("conf"), pct("e", "rm").alias("mbr"), pct("mn", "rc").alias("oracle"))


@query("spearman_conf_wer", select_sql(F1 + ", r AS (SELECT set_name, rank() OVER (PARTITION BY set_name ORDER BY avg_conf) + (count(*) OVER (PARTITION BY set_name, avg_conf) - 1) / 2.0 AS x, rank() OVER (PARTITION BY set_name ORDER BY e) + (count(*) OVER (PARTITION BY set_name, e) - 1) / 2.0 AS y FROM cand)", "set_name:s; n:b=count(*); rho:d=corr(x, y)", "FROM r GROUP BY 1 HAVING count(*) >= 3"))
def _(spark, d):
    return stats.spearman(pool(spark, d), ["set_name"], "avg_conf", "e").filter("n >= 3")


@query("spearman_ordinal", select_sql(F1 + ", c0 AS (SELECT *, id * 8 + cand_i AS tie FROM cand), r AS (SELECT set_name, row_number() OVER (PARTITION BY set_name ORDER BY avg_conf, tie) AS x, row_number() OVER (PARTITION BY set_name ORDER BY e, tie) AS y FROM c0)", "set_name:s; n:b=count(*); rho:d=corr(x, y)", "FROM r GROUP BY 1 HAVING count(*) >= 3"))
def _(spark, d):
    p = pool(spark, d).withColumn("tie", F.col("id") * 8 + F.col("cand_i"))
    return stats.spearman_ordinal(p, ["set_name"], "avg_conf", "e", "tie").filter("n >= 3")


@query("gap_percentiles", select_sql(PAIRS, "set_name:s; p10:d=quantile_cont(d * 1.0 / greatest(len_j, 1), 0.1); p50:d=quantile_cont(d * 1.0 / greatest(len_j, 1), 0.5); p90:d=quantile_cont(d * 1.0 / greatest(len_j, 1), 0.9)", "FROM pairs WHERE i < j GROUP BY 1"))
def _(spark, d):
    p = sel.pair_distances(pool(spark, d)).withColumn("x", F.col("d") / F.greatest("len_j", F.lit(1)))
    return p.groupBy("set_name").agg(*[F.percentile("x", q).alias(n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])


@query("coverage", select_sql(F1 + ", o AS (SELECT set_name, id, min(e) AS m, max(e) AS x FROM cand GROUP BY 1, 2)", "set_name:s; n:b=count(*); perfect:b=count(*) FILTER (m = 0); flat:b=count(*) FILTER (m = x)", "FROM o GROUP BY 1"))
def _(spark, d):
    o = pool(spark, d).groupBy(*KEY).agg(F.min("e").alias("m"), F.max("e").alias("x"))
    return o.groupBy("set_name").agg(F.count("*").alias("n"), F.count_if(F.col("m") == 0).alias("perfect"), F.count_if(F.col("m") == F.col("x")).alias("flat"))


@query("zscore_menu_pick", select_sql(PAIRS + ", z AS (SELECT *, CASE WHEN stddev_pop(mean_logprob) OVER w > 1e-12 THEN (mean_logprob - avg(mean_logprob) OVER w) / stddev_pop(mean_logprob) OVER w ELSE 0 END AS za, CASE WHEN stddev_pop(mbr_wer) OVER w > 1e-12 THEN (mbr_wer - avg(mbr_wer) OVER w) / stddev_pop(mbr_wer) OVER w ELSE 0 END AS zb FROM scored WINDOW w AS (PARTITION BY set_name, id))", "set_name:s; id:b; cand_i:b; e:b", "FROM z QUALIFY row_number() OVER (PARTITION BY set_name, id ORDER BY round(0.3 * za + 0.7 * zb, 9) DESC, cand_i) = 1"))
def _(spark, d):
    s = sel.mbr(pool(spark, d))
    s = s.withColumns({"za": stats.zscore(KEY, "mean_logprob"), "zb": stats.zscore(KEY, "mbr_wer")})
    return sel.pick(s, 0.3 * F.col("za") + 0.7 * F.col("zb")).select(*KEY, "cand_i", "e")


@query("lm_rescore_pick", select_sql(F1, "set_name:s; id:b; cand_i:b; e:b", "FROM cand QUALIFY row_number() OVER (PARTITION BY set_name, id ORDER BY round(avg_conf + 0.2 * mean_logprob + 0.05 * n_words, 9) DESC, cand_i) = 1"))
def _(spark, d):
    return sel.pick(pool(spark, d), F.col("avg_conf") + 0.2 * F.col("mean_logprob") + 0.05 * F.col("n_words")).select(*KEY, "cand_i", "e")


@query("usable_candidates", select_sql(F1 + ", ok AS (SELECT *, count(*) OVER (PARTITION BY set_name, id) AS m FROM cand WHERE n_words > 0 AND len(word_conf) = n_words AND cand_i <> id % 8)", "set_name:s; id:b; n:b=count(*)", "FROM ok WHERE m >= 2 GROUP BY 1, 2"))
def _(spark, d):
    p = pool(spark, d).filter((F.col("n_words") > 0) & (F.size("word_conf") == F.size("words")) & (F.col("cand_i") != F.col("id") % 8))
    return p.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n >= 2")


@query("width_features", select_sql(F1 + ", f AS (SELECT set_name, id, duration_s, n_tokens, avg_conf, unnest(word_conf) AS c FROM cand WHERE cand_i = 0 AND n_words > 0)", "set_name:s; id:b; tokens_per_s:d=max(n_tokens / duration_s); avg_conf:d=max(avg_conf); conf_p10:d=quantile_cont(c, 0.1); conf_p25:d=quantile_cont(c, 0.25); frac_below_50:d=avg(CASE WHEN c < 0.5 THEN 1.0 ELSE 0 END); frac_below_80:d=avg(CASE WHEN c < 0.8 THEN 1.0 ELSE 0 END); conf_std:d=stddev_pop(c)", "FROM f GROUP BY 1, 2"))
def _(spark, d):
    x = pool(spark, d).filter("cand_i = 0").select(*KEY, "duration_s", "n_tokens", "avg_conf", F.explode("word_conf").alias("c"))
    return x.groupBy(*KEY).agg(
        F.max(F.col("n_tokens") / F.col("duration_s")).alias("tokens_per_s"), F.max("avg_conf").alias("avg_conf"), F.percentile("c", 0.1).alias("conf_p10"), F.percentile("c", 0.25).alias("conf_p25"),
        F.avg((F.col("c") < 0.5).cast("double")).alias("frac_below_50"), F.avg((F.col("c") < 0.8).cast("double")).alias("frac_below_80"), F.stddev_pop("c").alias("conf_std"),
    )


@query("composition_menu", select_sql(F1, "set_name:s; id:b; n_texts:b=count(DISTINCT array_to_string(words, ' '))", "FROM cand WHERE n_words > 0 GROUP BY 1, 2 HAVING count(DISTINCT array_to_string(words, ' ')) >= 3"))
def _(spark, d):
    p = pool(spark, d).filter("n_words > 0")
    return p.groupBy(*KEY).agg(F.countDistinct(F.array_join("words", " ")).alias("n_texts")).filter("n_texts >= 3")


@query("menu_keep_first", select_sql(F1, "set_name:s; id:b; cand_i:b; text:s=array_to_string(words, ' ')", "FROM cand WHERE n_words > 0 QUALIFY row_number() OVER (PARTITION BY set_name, id, words ORDER BY cand_i) = 1"))
def _(spark, d):
    w = Window.partitionBy(*KEY, "words").orderBy("cand_i")
    p = pool(spark, d).filter("n_words > 0").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return p.select(*KEY, "cand_i", F.array_join("words", " ").alias("text"))


@query("truncate_pool", select_sql(F1, "set_name:s; k:b=3; n:b=count(*); wer:d=100.0 * sum(e) / greatest(sum(ref_len), 1)", "FROM cand WHERE cand_i < 3 GROUP BY 1"))
def _(spark, d):
    g = pool(spark, d).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("cand_i", "e", "ref_len"))).alias("c"))
    x = g.select("set_name", F.explode(F.slice("c", 1, 3)).alias("x")).select("set_name", "x.*")
    return x.groupBy("set_name").agg(F.lit(3).alias("k"), F.count("*").alias("n"), tables.rate("e").alias("wer"))


@query("nested_float_rounding", select_sql(F1, "set_name:s; id:b; cand_i:b; total:d=list_sum(list_transform(word_conf, lambda c: round(c / 3.0, 4)))", "FROM cand WHERE n_words > 0"))
def _(spark, d):
    p = pool(spark, d).filter("n_words > 0")
    return p.select(*KEY, "cand_i", F.aggregate(F.transform("word_conf", lambda c: F.bround(c / 3.0, 4)), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("budget_allocation", select_sql(F1 + ", s AS (SELECT set_name, id, n_words * greatest(1.0 - avg_conf, 0.001) AS x FROM cand WHERE cand_i = 0)", "set_name:s; id:b; k:b=least(greatest(round_even(1.5 * x, 0), 1), 8)", "FROM s"))
def _(spark, d):
    from ..operators.policy import at_scale

    first = pool(spark, d).filter("cand_i = 0").withColumn("score", F.col("n_words") * F.greatest(1.0 - F.col("avg_conf"), F.lit(0.001)))
    return first.select(*KEY, at_scale(F.lit(1.5), "score", 1, 8).alias("k"))


@query("budget_allocation_fitted", None)
def _(spark, d):
    from ..operators.policy import POLICIES, allocate

    first = pool(spark, d).filter("cand_i = 0")
    return allocate(first.withColumn("score", POLICIES["words_unconf"]()), 4.0, 1, 8).select(*KEY, "k")


@query("adjusted_rand", select_sql(F2 + ", j AS (SELECT set_name, k % 3 AS x, e_conf AS y, count(*) AS m FROM facts GROUP BY 1, 2, 3), b AS (SELECT set_name, sum(m * (m - 1) / 2.0) AS s, sum(m) AS n FROM j GROUP BY 1), a1 AS (SELECT set_name, sum(m * (m - 1) / 2.0) AS a FROM (SELECT set_name, x, sum(m) AS m FROM j GROUP BY 1, 2) GROUP BY 1), b1 AS (SELECT set_name, sum(m * (m - 1) / 2.0) AS c FROM (SELECT set_name, y, sum(m) AS m FROM j GROUP BY 1, 2) GROUP BY 1)", "set_name:s; n:b; ari:d=(s - a * c / (n * (n - 1) / 2.0)) / ((a + c) / 2.0 - a * c / (n * (n - 1) / 2.0))", "FROM b JOIN a1 USING (set_name) JOIN b1 USING (set_name)"))
def _(spark, d):
    f = facts_of(spark, d).withColumn("x", F.col("k") % 3)
    return stats.adjusted_rand(f, ["set_name"], "x", "e_conf")
