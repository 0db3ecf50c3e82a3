"""Tables in the engine's own shapes, derived from the driver tables, and their SQL counterparts.

F1 is a pool of eight candidates per sentence of the conversations, with deletions, repetitions and
substitutions; F1b is its positional sibling, one slot a reference word; F2 is a ladder of facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_distance
from ..operators.tasks import FACT_BYTES, TASK_BYTES, dealt, input_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of three words or more of every turn of every conversation, an utterance in one task."""
    turns = table(spark, sf_dir, "conversations")
    said = turns.select("conv_id", "turn", "role", F.posexplode(F.split("text", r"[.\n]")).alias("_p", "text"))
    clean = F.regexp_replace(F.lower("text"), r"[^a-z0-9_\s]", "")
    ref = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    id_ = F.col("conv_id") * 1_000_000 + F.col("turn") * 1000 + F.col("_p") + 1
    rows = said.select(id_.alias("id"), F.col("role").alias("set_name"), (F.col("conv_id") % 40).alias("cluster"), (F.length("text") / 100.0).alias("duration_s"), ref.alias("ref"))
    return dealt(rows.filter(F.size("ref") >= 3), TASK_BYTES, "set_name", "id")


def _confidences(df: DataFrame) -> DataFrame:
    i, r = F.col("id"), F.col("cand_i")
    return df.withColumns(
        {
            "avg_conf": ((i * 13 + r * 29) % 97) / 100.0,
            "min_conf": ((i * 13 + r * 29) % 97) / 200.0,
            "median_conf": ((i * 7 + r * 11) % 89) / 100.0,
            "mean_logprob": -((i * 3 + r * 19) % 83) / 10.0,
            "mean_entropy": ((i * 5 + r * 23) % 79) / 20.0,
        }
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_name, id, cluster, cand_i, ref, words, word_conf, confidences, ref_len, n_words, e."""
    refs = _references(spark, sf_dir)
    rows = refs.withColumn("cand_i", F.explode(F.sequence(F.lit(0), F.lit(7))))

    def perturb(w, j):
        h = F.pmod(F.col("id") * 31 + F.col("cand_i") * 17 + (j + 1) * 7, F.lit(23))
        other = F.element_at(F.col("ref"), (F.pmod(j + 1, F.size("ref")) + 1).cast("int"))
        return F.when(h == 0, F.array().cast("array<string>")).when(h == 1, F.array(w, w)).when(h == 2, F.array(other)).otherwise(F.array(w))

    rows = rows.withColumn("words", F.flatten(F.transform("ref", perturb)))
    rows = _confidences(rows).withColumns({"ref_len": F.size("ref"), "n_words": F.size("words"), "n_tokens": F.size("words") + 3})
    conf = F.transform("words", lambda w, j: F.pmod(F.col("id") * 31 + F.col("cand_i") * 17 + (j + 1) * 7, F.lit(101)) / 100.0)
    return rows.withColumns({"word_conf": conf, "e": word_distance("ref", "words")})


def positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1b: set_name, id, cluster, cand_i, slot, ref_word, word ('' is epsilon), conf."""
    refs = _references(spark, sf_dir)
    rows = refs.withColumn("cand_i", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("*", F.posexplode("ref").alias("_p", "ref_word"))
    rows = rows.withColumn("slot", F.col("_p") + 1)
    h = F.pmod(F.col("id") * 31 + F.col("cand_i") * 17 + F.col("slot") * 7, F.lit(23))
    at = lambda k: F.element_at(F.col("ref"), (F.pmod(F.col("slot") + k, F.size("ref")) + 1).cast("int"))
    word = F.when(h.isin(0, 5), "").when(h.isin(2, 7), at(0)).when(h == 11, at(1)).otherwise(F.col("ref_word"))
    conf = F.pmod(F.col("id") * 31 + F.col("cand_i") * 17 + F.col("slot") * 7, F.lit(101)) / 100.0
    return rows.select("set_name", "id", "cluster", "cand_i", "slot", "ref_word", word.alias("word"), conf.alias("conf"), F.size("ref").alias("ref_len"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per-utterance-k facts from lineitem and orders."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    size = input_bytes(li) + input_bytes(o)
    li, o = dealt(li, FACT_BYTES, "l_orderkey", size=size), dealt(o, FACT_BYTES, "o_orderkey", size=size)
    base = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy(F.col("o_orderpriority").alias("set_name"), F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), F.col("o_custkey").alias("cluster"))
        .agg(
            F.max("l_quantity").cast("long").alias("ref_len"),
            F.round(F.max("l_discount") * 100).cast("long").alias("e_conf"),
            F.round(F.max("l_tax") * 100).cast("long").alias("e_mbr"),
            (100.0 * F.max("l_discount")).alias("pairwise"),
            (F.max("l_extendedprice") / 1000.0).alias("duration_s"),
        )
    )
    f = base.withColumn("e_rover_cg", F.least("e_conf", "e_mbr")).withColumn("e_first", F.col("e_conf") + F.col("e_mbr"))
    f = f.withColumn("e_oracle_cand", F.greatest(F.col("e_rover_cg") - 1, F.lit(0).cast("long")))
    return f.withColumn("e_oracle_comp", F.when(F.col("k") % 2 == 0, F.floor(F.col("e_oracle_cand") / 2).cast("long"))).withColumn("e_control", F.least("e_oracle_cand", F.floor((F.col("e_oracle_cand") * 3) / 4).cast("long") + 0))


_BASE = """said AS (SELECT conv_id, turn, role, unnest(s) AS text, generate_subscripts(s, 1) AS p FROM (SELECT *, string_split_regex(text, '[.\\n]') AS s FROM conversations)),
base AS (SELECT conv_id * 1000000 + turn * 1000 + p AS id, role AS set_name, conv_id % 40 AS cluster, length(text) / 100.0 AS duration_s, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\\s]', '', 'g'), '\\s+'), lambda w: w <> '') AS ref
 FROM said)"""

F1 = f"""WITH {_BASE},
pool0 AS (SELECT id, set_name, cluster, duration_s, r, ref, flatten(list_transform(ref, lambda w, i:
  CASE (id * 31 + r * 17 + i * 7) % 23 WHEN 0 THEN []::varchar[] WHEN 1 THEN [w, w] WHEN 2 THEN [ref[(i % len(ref)) + 1]] ELSE [w] END)) AS c
 FROM base, range(8) t(r) WHERE len(ref) >= 3),
coded AS (SELECT *, list_distinct(list_concat(ref, c)) AS d FROM pool0),
cand AS (SELECT id, set_name, cluster, duration_s, r AS cand_i, ref, c AS words, len(ref) AS ref_len, len(c) AS n_words, len(c) + 3 AS n_tokens,
  ((id * 13 + r * 29) % 97) / 100.0 AS avg_conf, ((id * 13 + r * 29) % 97) / 200.0 AS min_conf, ((id * 7 + r * 11) % 89) / 100.0 AS median_conf,
  -((id * 3 + r * 19) % 83) / 10.0 AS mean_logprob, ((id * 5 + r * 23) % 79) / 20.0 AS mean_entropy,
  list_transform(c, lambda w, i: ((id * 31 + r * 17 + i * 7) % 101) / 100.0) AS word_conf,
  levenshtein(array_to_string(list_transform(ref, lambda w: chr(33 + list_position(d, w)::int)), ''), array_to_string(list_transform(c, lambda w: chr(33 + list_position(d, w)::int)), '')) AS e
 FROM coded)"""

PAIRS = (
    F1
    + """,
mates AS (SELECT a.set_name, a.id, a.cand_i AS i, b.cand_i AS j, a.words AS wa, b.words AS wb, list_distinct(list_concat(a.words, b.words)) AS d FROM cand a JOIN cand b ON a.id = b.id AND a.set_name = b.set_name AND a.cand_i <> b.cand_i),
pairs AS (SELECT set_name, id, i, j, len(wa) AS len_i, len(wb) AS len_j, levenshtein(array_to_string(list_transform(wa, lambda w: chr(33 + list_position(d, w)::int)), ''), array_to_string(list_transform(wb, lambda w: chr(33 + list_position(d, w)::int)), '')) AS d FROM mates),
risk AS (SELECT set_name, id, i AS cand_i, -sum(d / greatest(len_j, 1)) / greatest(count(*), 1) AS mbr_wer, sum(d) AS total FROM pairs GROUP BY 1, 2, 3),
scored AS (SELECT cand.*, mbr_wer, total, avg_conf AS mean_conf, -mean_entropy AS neg_entropy, avg_conf * ln(1.0 + n_tokens) AS len_norm_conf, avg_conf + 0.5 * mbr_wer AS conf_plus_mbr FROM cand JOIN risk USING (set_name, id, cand_i))"""
)

F1B = f"""WITH {_BASE},
cells AS (SELECT id, set_name, cluster, r AS cand_i, pos AS slot, ref[pos] AS ref_word, len(ref) AS ref_len,
  CASE WHEN (id * 31 + r * 17 + pos * 7) % 23 IN (0, 5) THEN '' WHEN (id * 31 + r * 17 + pos * 7) % 23 IN (2, 7) THEN ref[(pos % len(ref)) + 1]
       WHEN (id * 31 + r * 17 + pos * 7) % 23 = 11 THEN ref[((pos + 1) % len(ref)) + 1] ELSE ref[pos] END AS word,
  ((id * 31 + r * 17 + pos * 7) % 101) / 100.0 AS conf
 FROM base, range(8) t(r), unnest(generate_series(1, len(ref))) p(pos) WHERE len(ref) >= 3),
votes AS (SELECT set_name, id, cluster, slot, ref_word, ref_len, word, count(*) AS votes, sum(conf) AS conf_sum, min(cand_i) AS ord FROM cells GROUP BY ALL)"""

F2 = """WITH fb AS (SELECT o_orderpriority AS set_name, 'm' || (o_custkey % 3) AS model, l_orderkey AS id, l_linenumber AS k, o_custkey AS cluster,
  CAST(max(l_quantity) AS BIGINT) AS ref_len, CAST(round(max(l_discount) * 100) AS BIGINT) AS e_conf, CAST(round(max(l_tax) * 100) AS BIGINT) AS e_mbr,
  100.0 * max(l_discount) AS pairwise, max(l_extendedprice) / 1000.0 AS duration_s
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
fc AS (SELECT *, least(e_conf, e_mbr) AS e_rover_cg, e_conf + e_mbr AS e_first, greatest(least(e_conf, e_mbr) - 1, 0) AS e_oracle_cand FROM fb),
facts AS (SELECT *, CASE WHEN k % 2 = 0 THEN CAST(floor(e_oracle_cand / 2.0) AS BIGINT) END AS e_oracle_comp, CAST(floor(e_oracle_cand * 3 / 4.0) AS BIGINT) AS e_control FROM fc)"""


def select_sql(prefix: str, columns: str, rest: str) -> str:
    """``prefix`` SELECT columns ``rest``; columns are ``name:type=expr`` separated by ';', where
    type b is BIGINT, d is DOUBLE rounded to 6 places, s is VARCHAR and o is left as it is."""
    shapes = {"b": "CAST({} AS BIGINT)", "d": "round(CAST({} AS DOUBLE), 6)", "s": "CAST({} AS VARCHAR)", "o": "{}"}
    out = []
    for item in columns.split(";"):
        head, _, expr = item.strip().partition("=")
        name, _, kind = head.partition(":")
        out.append(f"{shapes[kind].format(expr or name)} AS {name}")
    return f"{prefix}\nSELECT {', '.join(out)} {rest}"


def tidy(df: DataFrame) -> DataFrame:
    """Integers as long and floating values rounded to 6 places, as in the SQL counterparts."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6)
        cols.append(c.alias(f.name))
    return df.select(*cols)
