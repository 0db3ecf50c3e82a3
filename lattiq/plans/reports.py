"""Queries on token pieces, the second normalisation, plans of sweeps, and further report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pieces as pc
from ..functions import text as tx
from ..operators import network as net
from ..operators import schedule
from ..operators import select as sel
from ..operators import tables
from ..sources import readers, sinks
from ..streaming.ingest import shared_folder
from .fixtures import F1, F2, F1B, PAIRS, facts, pool, positional, select_sql, table
from .networks import positional_votes
from .registry import query

KEY = sel.KEY
TOKEN_KEY = [*KEY, "cand_i"]

# --- token pieces: words of over three letters have two pieces; one candidate in seven lacks a word

_PIECES = (
    F1
    + """,
pcs AS (SELECT *, CASE WHEN id % 7 = 0 THEN len(words) - 1 ELSE len(words) END AS said, flatten(list_transform(words, lambda w: CASE WHEN length(w) > 3 THEN ['▁' || w[1:3], w[4:]] ELSE ['▁' || w] END)) AS ps FROM cand),
prow AS (SELECT set_name, id, cand_i, said, len(words) AS n_words, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pcs),
pnum AS (SELECT *, ((id * 31 + cand_i * 17 + i * 7) % 101) / 100.0 AS c, sum(CASE WHEN starts_with(p, '▁') THEN 1 ELSE 0 END) OVER (PARTITION BY set_name, id, cand_i ORDER BY i) AS wno FROM prow),
pword AS (SELECT set_name, id, cand_i, wno, max(said) AS said, max(n_words) AS n_words, avg(c) AS m, min(i) AS i FROM pnum GROUP BY 1, 2, 3, 4)"""
)


def _tokens(spark, d):
    """The pool with pieces, conf, ids, top_ids, top_p (a padding piece at the end) and text."""
    p = pool(spark, d)
    cut = F.flatten(F.transform("words", lambda w: F.when(F.length(w) > 3, F.array(F.concat(F.lit("▁"), F.substring(w, 1, 3)), F.substring(w, 4, 1 << 30))).otherwise(F.array(F.concat(F.lit("▁"), w)))))
    said = F.when(F.col("id") % 7 == 0, F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0)))).otherwise(F.col("words"))
    x = p.select(*TOKEN_KEY, "words", F.concat(cut, F.array(F.lit("<pad>"))).alias("pieces"), F.array_join(said, " ").alias("text"))
    each = lambda fn: F.transform("pieces", lambda _, i: fn(i + 1))
    odd = lambda i: F.pmod(F.col("id") + i, F.lit(2)) == 1
    return x.withColumns(
        {
            "conf": each(lambda i: F.pmod(F.col("id") * 31 + F.col("cand_i") * 17 + i * 7, F.lit(101)) / 100.0),
            "ids": each(lambda i: i),
            "top_ids": each(lambda i: F.array(i, i + 1, i + 2)),
            "top_p": each(lambda i: F.array(F.lit(0.6), F.lit(0.3), F.when(odd(i), 0.0002).otherwise(0.00005))),
        }
    )


def _weighed(values):
    """Number, sum and place-weighted sum of an array of doubles."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    placed = F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return F.when(values.isNotNull(), F.size(values)).alias("n"), total.alias("total"), placed.alias("placed")


@query("word_conf_pieces", select_sql(_PIECES, "set_name:s; id:b; cand_i:b; n:b=CASE WHEN max(said) = max(n_words) THEN count(*) END; total:d=CASE WHEN max(said) = max(n_words) THEN sum(m) END; placed:d=CASE WHEN max(said) = max(n_words) THEN sum(m * wno) END", "FROM pword GROUP BY 1, 2, 3"))
def _(spark, d):
    t = _tokens(spark, d).filter(F.size("words") > 0)
    conf = pc.sentence_confidences(F.col("pieces"), F.col("conf"), F.col("text"), ["<pad>"])
    return t.select(*TOKEN_KEY, conf.alias("wc")).select(*TOKEN_KEY, *_weighed(F.col("wc")))


@query("word_conf_bytes", select_sql(F1 + ", g AS (SELECT *, unnest(words) AS w, generate_subscripts(words, 1) AS j FROM cand), c AS (SELECT *, ((id * 31 + cand_i * 17 + CASE WHEN id % 5 = 0 THEN 1 ELSE j END * 7) % 101) / 100.0 AS m FROM g)", "set_name:s; id:b; cand_i:b; n:b=count(*); total:d=sum(m); placed:d=sum(m * j)", "FROM c GROUP BY 1, 2, 3"))
def _(spark, d):
    """One candidate in five is a single run of pieces with several words, which share its mean."""
    glued = F.array(F.concat(F.lit("Ġ"), F.array_join("words", "\n")))
    marked = F.transform("words", lambda w: F.concat(F.lit("Ġ"), w))
    x = pool(spark, d).filter(F.size("words") > 0).select(*TOKEN_KEY, F.array_join("words", " ").alias("text"), F.when(F.col("id") % 5 == 0, glued).otherwise(marked).alias("pieces"))
    x = x.withColumn("conf", F.transform("pieces", lambda _, i: F.pmod(F.col("id") * 31 + F.col("cand_i") * 17 + (i + 1) * 7, F.lit(101)) / 100.0))
    return x.select(*TOKEN_KEY, pc.byte_confidences(F.col("pieces"), F.col("conf"), F.col("text")).alias("wc")).select(*TOKEN_KEY, *_weighed(F.col("wc")))


@query("word_distributions", select_sql(_PIECES, "set_name:s; id:b; cand_i:b; n:b=count(*); first_ids:b=sum(i); kept:b=sum(2 + (id + i) % 2); mass:d=sum(0.9 + 0.0002 * ((id + i) % 2))", "FROM pword WHERE said = n_words GROUP BY 1, 2, 3"))
def _(spark, d):
    dist = pc.word_distributions(*[F.col(c) for c in ("pieces", "ids", "top_ids", "top_p", "text")], ["<pad>"])
    # An exploded array is made once a row: a filter on it would otherwise make the distributions again.
    x = _tokens(spark, d).filter(F.size("words") > 0).select(*TOKEN_KEY, F.explode(F.array(dist)).alias("wd")).filter("wd is not null")
    firsts = F.aggregate("wd", F.lit(0), lambda s, x: s + x["first"])
    kept = F.aggregate("wd", F.lit(0), lambda s, x: s + F.size(x["ids"]))
    mass = F.aggregate(F.flatten("wd.p"), F.lit(0.0), lambda s, x: s + x)
    return x.select(*TOKEN_KEY, F.size("wd").alias("n"), firsts.alias("first_ids"), kept.alias("kept"), mass.alias("mass"))


# --- second normalisation ----------------------------------------------------------------------

_BASIC = "list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower(text), '[<\\[][^>\\]]*[>\\]]', '', 'g'), '\\([^)]+\\)', '', 'g'), '[\\p{M}\\p{S}\\p{P}]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


@query("second_normaliser", select_sql(f"WITH x AS (SELECT doc_id, CASE WHEN lang <> 'en' THEN {_BASIC} END AS w FROM documents)", "doc_id:b; n_words:b=len(w); normalized:s=array_to_string(w, ' ')", "FROM x"))
def _(spark, d):
    """Null for English, for which no normaliser is given here."""
    w = table(spark, d, "documents").select("doc_id", tx.second_words("text", "lang").alias("w"))
    return w.select("doc_id", F.when(F.col("w").isNotNull(), F.size("w")).alias("n_words"), F.array_join("w", " ").alias("normalized"))


# --- keys, halves, plans -----------------------------------------------------------------------

@query("model_keys", select_sql(F2, "model_key:s=model || CASE k % 3 WHEN 1 THEN '@int8' WHEN 2 THEN '@fp16' ELSE '' END; n:b=count(*)", "FROM facts GROUP BY 1"))
def _(spark, d):
    precision = F.when(F.col("k") % 3 == 1, "int8").when(F.col("k") % 3 == 2, "fp16").otherwise("")
    return facts(spark, d).groupBy(tx.model_key("model", precision).alias("model_key")).agg(F.count("*").alias("n"))


_SETS = "WITH s AS (SELECT n_name AS set_name, n_regionkey AS lang, n_nationkey AS nk FROM nation), l AS (SELECT unnest(['NATION_7', 'NATION_3', 'NATION_0', 'NOWHERE', 'NATION_11']) AS set_name, unnest(range(5)) AS place)"
_LISTED = ["NATION_7", "NATION_3", "NATION_0", "NOWHERE", "NATION_11"]


def _sweep(spark, d):
    sets = table(spark, d, "nation").select(F.col("n_name").alias("set_name"), F.col("n_regionkey").alias("lang"))
    return schedule.sweep_plan(sets, _LISTED, "m1", [1, 2, 3])


@query("plan_sweep", select_sql(_SETS, "job:s='m1__' || set_name || '__s00__sweepT'; set_name:s; tier:b=0; shard:b=0; ord:b=place", "FROM s JOIN l USING (set_name) WHERE lang IN (1, 2, 3)"))
def _(spark, d):
    return _sweep(spark, d).select("job", "set_name", "tier", "shard", "ord")


@query("sweep_arms", select_sql(_SETS + ", t AS (SELECT unnest([0.5, 1.0, 1.25]) AS t, unnest(['T0.5', 'T1', 'T1.25']) AS name)", "set_name:s; name:s; K:b=16; T:d=t; steps:b=8", "FROM s JOIN l USING (set_name), t WHERE lang IN (1, 2, 3)"))
def _(spark, d):
    given = schedule.merged({"sweep": {"size": 8, "steps": 8}, "mode": "full"}, {"sweep": {"size": 16}})["sweep"]
    return schedule.temperature_arms(_sweep(spark, d).select("set_name"), [0.5, 1.0, 1.25], given["size"], given["steps"])


# --- report tables -----------------------------------------------------------------------------

@query("paper_sweep", select_sql(F2 + ", x AS (SELECT *, 1.0 + (id % 3) * 0.2 AS arm_t FROM facts WHERE k = (SELECT max(k) FROM facts))", "model:s; set_name:s; arm_t:d; n:b=count(*); pairwise:d=avg(pairwise); first:d=100.0 * sum(e_first) / greatest(sum(ref_len), 1); conf:d=100.0 * sum(e_conf) / greatest(sum(ref_len), 1); mbr:d=100.0 * sum(e_mbr) / greatest(sum(ref_len), 1); rover:d=100.0 * sum(e_rover_cg) / greatest(sum(ref_len), 1); oracle_cand:d=100.0 * sum(e_oracle_cand) / greatest(sum(ref_len), 1); oracle_comp:d=CASE WHEN count(*) = count(e_oracle_comp) THEN 100.0 * sum(e_oracle_comp) / greatest(sum(ref_len), 1) END", "FROM x GROUP BY 1, 2, 3"))
def _(spark, d):
    x = facts(spark, d).withColumn("arm_t", 1.0 + (F.col("id") % 3) * 0.2)
    return tables.sweep_table(x, ["model", "set_name"], "arm_t")


@query("top_weights", select_sql("", "supplier:s=s_name; weight:d=s_acctbal", "FROM supplier ORDER BY abs(s_acctbal) DESC, s_name LIMIT 20"))
def _(spark, d):
    w = table(spark, d, "supplier").select(F.col("s_name").alias("supplier"), F.col("s_acctbal").cast("double").alias("weight"))
    return tables.top_weights(w, "supplier", "weight", 20)


_PICKS = F1B + ", picks AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY set_name, id, slot ORDER BY round(0.5 * votes / 8.0 + 0.5 * CASE WHEN word = '' THEN 0.7 ELSE conf_sum / votes END, 9) DESC, ord) = 1), ways AS (SELECT 'first' AS method, set_name, word, ref_word FROM cells WHERE cand_i = 0 UNION ALL SELECT 'rover', set_name, word, ref_word FROM picks)"


@query("sid_by_method_positional", select_sql(_PICKS, "method:s; set_name:s; n:b=count(*); subs:b=count(*) FILTER (word <> '' AND word <> ref_word); dels:b=count(*) FILTER (word = ''); wer:d=100.0 * count(*) FILTER (word <> ref_word) / count(*)", "FROM ways GROUP BY 1, 2"))
def _(spark, d):
    first = positional(spark, d).filter("cand_i = 0").select(F.lit("first").alias("method"), "set_name", "word", "ref_word")
    rover = net.rover_picks(positional_votes(spark, d), 0.5, 0.7).select(F.lit("rover").alias("method"), "set_name", "word", "ref_word")
    return net.slot_sid(first.unionByName(rover), ["method", "set_name"])


@query("whole_views", select_sql(PAIRS, "set_name:s; id:b; cand_i:b; text:s=array_to_string(words, ' '); conf:d=avg_conf; mbr:d=mbr_wer", "FROM scored"))
def _(spark, d):
    return sel.mbr(pool(spark, d)).select(*TOKEN_KEY, F.array_join("words", " ").alias("text"), F.col("avg_conf").alias("conf"), F.col("mbr_wer").alias("mbr"))


_SIDE = "(cluster * 7919 + split * 104729) % 10007 % 2"


@query("split_half_tuning", select_sql(F2 + f", g AS (SELECT cluster, unnest([0, 1, 2, 3, 4]) AS a, e_conf, e_mbr, ref_len FROM facts WHERE k = 2), s AS (SELECT cluster, a, sum((4 - a) * e_conf + a * e_mbr) AS e, sum(ref_len) AS ref_len FROM g GROUP BY 1, 2), h AS (SELECT split, {_SIDE} AS half, a, sum(e) AS e, sum(ref_len) AS ref_len FROM s, range(50) t(split) GROUP BY ALL), b AS (SELECT split, 1 - half AS half, a FROM h QUALIFY row_number() OVER (PARTITION BY split, half ORDER BY e, a) = 1)", "split:b; half:b; a:b; e:b; ref_len:b", "FROM h JOIN b USING (split, half, a)"))
def _(spark, d):
    """The mixture of two selectors in quarters that is best on one half of the clusters, read on the other."""
    f = facts(spark, d).filter("k = 2").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(4))))
    grid = f.withColumn("e", (4 - F.col("a")) * F.col("e_conf") + F.col("a") * F.col("e_mbr"))
    side = (F.col("cluster") * 7919 + F.col("split") * 104729) % 10007 % 2
    return tables.split_half(grid, ["a"], 50, side)


@query("first_lines", select_sql("WITH x AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line FROM customer)", "nation:b=c_nationkey; line:b; cust:b=c_custkey", "FROM x WHERE line <= 3"))
def _(spark, d):
    """Write one gzipped file a nation, and read the first three lines of each."""
    top = shared_folder(spark, "lines")
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cust"))
    c.repartition("nation").sortWithinPartitions("nation", "cust").select("nation", F.col("cust").cast("string")).write.partitionBy("nation").option("compression", "gzip").text(top)
    got = readers.first_lines(spark, top, 3)
    return got.select(F.regexp_extract("file", "nation=([0-9]+)", 1).cast("long").alias("nation"), "line", F.col("value").cast("long").alias("cust"))


@query("verdict_rows", select_sql(F2 + ", x AS (SELECT model, 100.0 * (sum(e_conf) - sum(e_rover_cg)) / sum(ref_len) AS d, count(*) FILTER (e_rover_cg < e_conf) AS b, count(*) FILTER (e_rover_cg > e_conf) AS w, count(*) FILTER (e_rover_cg = e_conf) AS t FROM facts WHERE k = 3 GROUP BY 1)", "model:s; row:s=printf('conf %+.2f [%+.2f, %+.2f] better %d / worse %d / tied %d', d, d - 1, d + 1, b, w, t)", "FROM x"))
def _(spark, d):
    f = facts(spark, d).filter("k = 3").withColumn("_s", F.signum(F.col("e_conf") - F.col("e_rover_cg")))
    delta = 100.0 * (F.sum("e_conf") - F.sum("e_rover_cg")) / F.sum("ref_len")
    x = f.groupBy("model").agg(delta.alias("d"), *[F.count_if(F.col("_s") == s).alias(n) for n, s in (("better", 1), ("worse", -1), ("tied", 0))])
    x = x.withColumns({"lo": F.col("d") - 1, "hi": F.col("d") + 1})
    return x.select("model", sinks.verdict_text("conf", "d", "lo", "hi", "better", "worse", "tied").alias("row"))
