"""Plans and job states as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD = 200


def n_shards(total, size: int = SHARD):
    return F.ceil(F.col(total) / size).cast("int")


def plan(sets: DataFrame, models: DataFrame, kind: str = "main", size: int = SHARD) -> DataFrame:
    """The cross product of sets, the models that take their language, and shards, in plan order:
    by tier, then shard, then listing order.  Both inputs are small configuration tables."""
    pairs = sets.crossJoin(F.broadcast(models)).filter("only_lang = -1 or only_lang = lang")
    jobs = pairs.withColumn("shard", F.explode(F.sequence(F.lit(0), n_shards("total", size) - 1)))
    jobs = jobs.withColumn("job", F.concat_ws("__", "model", "set_name", F.format_string("s%02d", "shard"), F.lit(kind)))
    jobs = jobs.withColumn("expected", F.least(F.lit(size), F.col("total") - F.col("shard") * size))
    return jobs.withColumn("ord", F.row_number().over(Window.orderBy("tier", "shard", "place", "model")) - 1)


def merged(defaults: dict, given: dict) -> dict:
    """Settings with the given ones over them; tables are merged one level deep."""
    return defaults | {k: defaults[k] | v if isinstance(v, dict) and isinstance(defaults.get(k), dict) else v for k, v in given.items()}


def sweep_plan(sets: DataFrame, listed: list[str], model: str, langs: list) -> DataFrame:
    """One job for each listed set whose language the model takes, on its first shard, in the
    listing's order (a small configuration table)."""
    place = F.array_position(F.array(*[F.lit(x) for x in listed]), F.col("set_name")) if listed else F.lit(0)
    jobs = sets.filter((place > 0) & F.col("lang").isin(*langs)).withColumns({"tier": F.lit(0), "shard": F.lit(0), "ord": place - 1})
    return jobs.withColumn("job", F.concat_ws("__", F.lit(model), "set_name", F.lit("s00"), F.lit("sweepT")))


def temperature_arms(sets: DataFrame, temperatures: list[float], size: int, steps: int) -> DataFrame:
    """Arms of a temperature ladder for every row of ``sets``: name, K, T and steps."""
    arms = F.array(*[F.struct(F.lit(f"T{t:g}").alias("name"), F.lit(size).alias("K"), F.lit(float(t)).alias("T"), F.lit(steps).alias("steps")) for t in temperatures])
    return sets.withColumn("arm", F.explode(arms)).select(*sets.columns, "arm.*")


def status(jobs: DataFrame, done: DataFrame, claimed: DataFrame, dead: DataFrame, manifests: DataFrame) -> DataFrame:
    """done before claimed before dead; waiting while the set has no manifest, else ready."""
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    x = jobs.join(flag(done, "job", "_done"), "job", "left").join(flag(claimed, "job", "_claimed"), "job", "left").join(flag(dead, "job", "_dead"), "job", "left").join(flag(manifests, "set_name", "_there"), "set_name", "left")
    s = F.when(F.col("_done"), "done").when(F.col("_claimed"), "claimed").when(F.col("_dead"), "dead").when(F.col("_there").isNull(), "waiting").when(F.col("expected") <= 0, "dead").otherwise("ready")
    return x.withColumn("status", s).drop("_done", "_claimed", "_dead", "_there")


def progress(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("model").agg(F.count("*").alias("n_jobs"), F.count_if(F.col("status") == "done").alias("n_done"), F.min(F.when(F.col("status") == "ready", F.col("tier"))).alias("min_ready_tier"))
