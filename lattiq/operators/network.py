"""Confusion networks: candidates aligned to a backbone, slots, votes, oracles and controls.

Only the alignment is Python (one row per utterance in, long rows out, whole Arrow batches); slots,
votes, picks, decomposition and controls are grouped and windowed DataFrame expressions over the
long table, keyed by (set_name, id).  Slots are numbered ``2*p+1`` for backbone word p and ``2*p``
for the gap before it, so their order needs no renumbering.  The empty word is epsilon.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .select import KEY

LAST = 1 << 40


def alignment(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Steps (i, j) of one optimal word alignment; None on a side marks an insertion or deletion.

    Common ends are matched first.  Walking back from the end, a deletion is preferred to an
    insertion, and either to a match or substitution, wherever all are optimal.  The columns of the
    distance table are bit vectors of where it grows by one downwards (a deletion) and rightwards.
    """
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    at: dict[str, int] = {}
    for i in range(lo, n):
        at[a[i]] = at.get(a[i], 0) | 1 << (i - lo)
    full = (1 << (n - lo)) - 1
    up, down, columns = full, 0, [(full, 0)]
    for j in range(lo, m):
        eq = at.get(b[j], 0)
        x = (((eq & up) + up) ^ up) | eq | down
        right, minus = down | (full & ~(x | up)), up & x
        plus, minus, y = (right << 1 | 1) & full, minus << 1 & full, eq | down
        up, down = minus | (full & ~(y | plus)), plus & y
        columns.append((up, right))
    i, j, mid = n - lo, m - lo, []
    while i or j:
        if i and columns[j][0] >> (i - 1) & 1:
            i -= 1
            mid.append((lo + i, None))
        elif j and (not i or columns[j][1] >> (i - 1) & 1):
            j -= 1
            mid.append((None, lo + j))
        else:
            i, j = i - 1, j - 1
            mid.append((lo + i, lo + j))
    mid.reverse()
    return [(t, t) for t in range(lo)] + mid + [(n + t, m + t) for t in range(len(a) - n)]


def placed(backbone: list[str], words: list[str]) -> list[tuple[int, int | None]]:
    """(slot, word position) of every word, and (slot, None) for every backbone word skipped."""
    out, at = [], 0
    for i, j in alignment(backbone, words):
        if i is None:
            out.append((2 * at, j))
        else:
            at = i + 1
            out.append((2 * i + 1, j))
    return out


def per_row(df: DataFrame, fn: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Arrow-batched flat map: fn turns one row into the rows of ``schema``."""
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = [r for x in batch.slice(lo, 512).to_pylist() for r in fn(x)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, schema)


def gathered(pool: DataFrame) -> DataFrame:
    """One row per utterance: ref and its candidates in draw order (bounded by the pool size K)."""
    items = F.array_sort(F.collect_list(F.struct("cand_i", "words", "word_conf")))
    g = pool.groupBy(*KEY).agg(F.first("ref").alias("ref"), items.alias("c"))
    return g.select(*KEY, "ref", F.col("c.cand_i").alias("order"), F.col("c.words").alias("words"), F.col("c.word_conf").alias("confs"))


def align_pool(pool: DataFrame, backbone: DataFrame) -> DataFrame:
    """(key, slot, cand_i, off, word, conf): where every candidate's words fall; off is null and word
    empty where a candidate skips a backbone word.  Candidate -1 is the reference."""

    schema = "set_name string, id long, slot int, cand_i int, off int, word string, conf double"
    names = ["set_name", "id", "slot", "cand_i", "off", "word", "conf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, cols = [], [[] for _ in range(5)]
                for n, (spine, order, lists, confs, ref) in enumerate(zip(*[part.column(c).to_pylist() for c in ("backbone", "order", "words", "confs", "ref")])):
                    spine, seen = lists[order.index(spine)], {}
                    for c, words, conf in [*zip(order, lists, confs), (-1, ref, None)]:
                        key = tuple(words)
                        if key not in seen:
                            steps = placed(spine, words)
                            seen[key] = [s for s, _ in steps], [j for _, j in steps], ["" if j is None else words[j] for _, j in steps]
                        slots, offs, said = seen[key]
                        known = len(conf) if conf is not None else 0
                        rows.append((n, len(slots)))
                        for col, more in zip(cols, (slots, [c] * len(slots), offs, said, [1.0 if j is None or j >= known else conf[j] for j in offs])):
                            col += more
                own = pa.array(np.repeat([n for n, _ in rows], [k for _, k in rows]) if rows else np.zeros(0, np.int64))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("set_name").take(own), part.column("id").take(own), *[pa.array(x, t) for x, t in zip(cols, kinds)]], names)

    return gathered(pool).join(backbone.select(*KEY, "backbone"), KEY).mapInArrow(run, schema)


def prepared(pool: DataFrame, strict: bool = True) -> DataFrame:
    """Word confidences fit for voting.

    ``strict``: those of an utterance only if all its candidates have exactly one a word, else null
    for all.  Otherwise each candidate without exact ones repeats its clipped mean (0.5 if unknown).
    """
    exact = F.coalesce(F.size("word_conf") == F.size("words"), F.lit(False))
    if strict:
        ok = F.min(exact).over(Window.partitionBy(*KEY))
        return pool.withColumn("word_conf", F.when(ok, F.col("word_conf")))
    mean = F.greatest(F.least(F.coalesce("avg_conf", F.lit(0.5)), F.lit(1.0)), F.lit(0.0))
    return pool.withColumn("word_conf", F.when(exact, F.col("word_conf")).otherwise(F.array_repeat(mean, F.size("words"))))


def votes(aligned: DataFrame, weights: DataFrame | None = None, use_conf: bool = True) -> DataFrame:
    """The network: (key, slot, word, votes, conf_sum, ord), epsilon in every slot.

    ``ord`` is the order in which a slot's words were first proposed, which breaks ties.
    """
    a = aligned.filter("cand_i >= 0")
    a = a.join(weights.select(*KEY, "cand_i", "weight"), [*KEY, "cand_i"]) if weights is not None else a.withColumn("weight", F.lit(1.0))
    conf = F.when((F.col("word") == "") | F.lit(not use_conf), 1.0).otherwise(F.col("conf"))
    ord_ = F.min(F.col("cand_i").cast("long") * 100_000 + F.coalesce("off", F.lit(0)))
    cell = a.groupBy(*KEY, "slot", "word").agg(F.sum("weight").alias("votes"), F.sum(conf * F.col("weight")).alias("conf_sum"), ord_.alias("ord"))
    total = a.select(*KEY, "cand_i", "weight").distinct().groupBy(*KEY).agg(F.sum("weight").alias("total"))
    voters = a.filter("slot % 2 = 0").select(*KEY, "slot", "cand_i", "weight").distinct().groupBy(*KEY, "slot").agg(F.sum("weight").alias("cast"))
    gaps = voters.join(total, KEY).select(*KEY, "slot", F.lit("").alias("word"), (F.col("total") - F.col("cast")).alias("votes"), F.lit(0.0).alias("conf_sum"), F.lit(LAST).alias("ord"))
    bare = cell.filter("slot % 2 = 1").groupBy(*KEY, "slot").agg(F.max(F.col("word") == "").alias("has")).filter("not has")
    bare = bare.select(*KEY, "slot", F.lit("").alias("word"), F.lit(0.0).alias("votes"), F.lit(0.0).alias("conf_sum"), F.lit(LAST).alias("ord"))
    return cell.unionByName(gaps).unionByName(bare).join(total, KEY)


def slot_score(alpha: Column | float, eps_conf: Column | float, digits: int = 9) -> Column:
    """Frequency mixed with mean confidence; epsilon has the confidence ``eps_conf``."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    e = F.lit(eps_conf) if isinstance(eps_conf, float) else eps_conf
    freq = F.when(F.col("total") > 0, F.col("votes") / F.col("total")).otherwise(0.0)
    conf = F.when(F.col("word") == "", e).when(F.col("votes") > 0, F.col("conf_sum") / F.col("votes")).otherwise(0.0)
    return F.round(a * freq + (1.0 - a) * conf, digits)


def rover_picks(network: DataFrame, alpha: float = 1.0, eps_conf: float = 0.5, extra: list[str] | None = None) -> DataFrame:
    """The winning word of every slot, epsilons included."""
    keys = [*KEY, *(extra or [])]
    w = Window.partitionBy(*keys, "slot").orderBy(F.desc("score"), F.asc("ord"))
    scored = network.withColumn("score", slot_score(alpha, eps_conf))
    return scored.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def hypothesis(picks: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(key, words): the picks in slot order without epsilons."""
    words = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("slot", "word"))), lambda x: x["word"]), lambda w: w != "")
    return picks.groupBy(*KEY, *(extra or [])).agg(words.alias("words"))


def reference_by_slot(aligned: DataFrame, network: DataFrame) -> DataFrame:
    """(key, slot, ref_word): the reference's word in every slot of the network ('' if none); of
    several reference words in one gap the first counts."""
    slots = network.select(*KEY, "slot").distinct()
    ref = aligned.filter("cand_i = -1").groupBy(*KEY, "slot").agg(F.min_by("word", F.coalesce("off", F.lit(0))).alias("ref_word"))
    return slots.join(ref, [*KEY, "slot"], "left").na.fill("", ["ref_word"])


def decompose(aligned: DataFrame, network: DataFrame, backbone: DataFrame, alpha: float = 1.0, eps_conf: float = 0.5) -> DataFrame:
    """Per utterance, over slots with a reference word: available, picked, backbone right, damaged, rescued."""
    spine = aligned.join(backbone.select(*KEY, F.col("backbone").alias("cand_i")), [*KEY, "cand_i"]).filter("slot % 2 = 1").select(*KEY, "slot", F.col("word").alias("base_word"))
    here = reference_by_slot(aligned, network).filter("ref_word <> ''")
    picks = rover_picks(network, alpha, eps_conf).select(*KEY, "slot", F.col("word").alias("pick"))
    has = network.select(*KEY, "slot", F.col("word").alias("ref_word"), F.lit(1).alias("avail"))
    rows = here.join(picks, [*KEY, "slot"]).join(spine, [*KEY, "slot"], "left").join(has, [*KEY, "slot", "ref_word"], "left")
    right, base = F.col("pick") == F.col("ref_word"), F.coalesce(F.col("base_word") == F.col("ref_word"), F.lit(False))
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.count("avail").alias("avail"), F.count_if(right).alias("picked"), F.count_if(base).alias("base"), F.count_if(base & ~right).alias("damage"), F.count_if(~base & right).alias("rescue"))


def summarise(parts: DataFrame, by: list[str]) -> DataFrame:
    """Pooled availability A, recoverability R, their product and the backbone's rate, in percent."""
    s = parts.filter("n > 0").groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "avail", "picked", "base", "damage", "rescue")], F.count("*").alias("n_utts"))
    pct = lambda x: 100.0 * F.col(x) / F.col("n")
    r = F.when(F.col("avail") > 0, 100.0 * F.col("picked") / F.col("avail")).otherwise(0.0)
    return s.select(*by, F.col("n").alias("n_slots"), pct("avail").alias("a_pct"), r.alias("r_pct"), pct("picked").alias("ar_pct"), pct("base").alias("base_pct"), pct("damage").alias("damage_pct"), pct("rescue").alias("rescue_pct"), "n_utts")


def slot_arrays(network: DataFrame) -> DataFrame:
    """(key, slots): array of word arrays in slot order, for the path searches."""
    slot = network.groupBy(*KEY, "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]).alias("w"))
    return slot.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "w"))), lambda x: x["w"]).alias("slots"))


def path_edits(slots: list[list[str]], ref: list[str]) -> int:
    """Fewest edits of any path through the slots against the reference."""
    n = len(ref)
    best = np.arange(n + 1)
    for words in slots:
        real = [w for w in words if w]
        new = best.copy() if len(real) < len(words) else np.full(n + 1, 1 << 30)
        if real:
            new = np.minimum(new, best + 1)
            if n:
                new[1:] = np.minimum(new[1:], best[:-1] + np.array([w not in real for w in ref]))
        best = np.minimum.accumulate(new - np.arange(n + 1)) + np.arange(n + 1)
    return int(best[n])


def oracle_edits(network: DataFrame, refs: DataFrame, name: str = "e_oracle_comp") -> DataFrame:
    def fn(r: dict) -> list[dict]:
        return [{"set_name": r["set_name"], "id": r["id"], name: path_edits(r["slots"], r["ref"])}]

    return per_row(slot_arrays(network).join(refs.select(*KEY, "ref").dropDuplicates(KEY), KEY), fn, f"set_name string, id long, {name} long")


def lexical_control(network: DataFrame, words: DataFrame) -> DataFrame:
    """The same slots with every alternative but the first replaced by a word of (n, word), drawn by
    hash; words drawn twice in a slot merge."""
    size = words.agg(F.count("*").alias("m"))
    rank = F.row_number().over(Window.partitionBy(*KEY, "slot").orderBy("ord"))
    real = network.filter("word <> ''").withColumn("_rank", rank).crossJoin(F.broadcast(size))
    real = real.withColumn("n", F.when(F.col("_rank") > 1, F.pmod(F.xxhash64(*KEY, "slot", "ord"), F.col("m"))))
    drawn = real.join(words.withColumnRenamed("word", "_new"), "n", "left").withColumn("word", F.coalesce("_new", "word"))
    merged = drawn.groupBy(*KEY, "slot", "word").agg(F.max("votes").alias("votes"), F.max("conf_sum").alias("conf_sum"), F.min("ord").alias("ord"), F.max("total").alias("total"))
    return merged.unionByName(network.filter("word = ''").select(merged.columns))


def permuted_control(network: DataFrame) -> DataFrame:
    """The alternatives (all but each slot's first word) of one slot moved to the next in a hashed order,
    which leaves no slot its own unless it is the only one."""
    rank = F.row_number().over(Window.partitionBy(*KEY, "slot").orderBy("ord"))
    real = network.filter("word <> ''").withColumn("_rank", rank)
    slots = network.select(*KEY, "slot").distinct()
    w = Window.partitionBy(*KEY).orderBy(F.xxhash64(*KEY, "slot"))
    order = slots.withColumn("_to", F.coalesce(F.lead("slot").over(w), F.first("slot").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    moved = real.filter("_rank > 1").join(order, [*KEY, "slot"]).drop("slot").withColumnRenamed("_to", "slot")
    rows = real.filter("_rank = 1").drop("_rank").unionByName(moved.drop("_rank").select(network.columns)).unionByName(network.filter("word = ''"))
    return rows.groupBy(*KEY, "slot", "word").agg(F.max("votes").alias("votes"), F.max("conf_sum").alias("conf_sum"), F.min("ord").alias("ord"), F.max("total").alias("total"))


def micro_slots(aligned: DataFrame) -> DataFrame:
    """(key, t, slot, cand_i, word): several words in one gap get a micro-slot each."""
    place = F.when(F.col("slot") % 2 == 1, 0).otherwise(F.row_number().over(Window.partitionBy(*KEY, "slot", "cand_i").orderBy("off")) - 1)
    cells = aligned.filter("cand_i >= 0").withColumn("m", place)
    axis = cells.select(*KEY, "slot", "m").distinct().withColumn("t", F.row_number().over(Window.partitionBy(*KEY).orderBy("slot", "m")) - 1)
    grid = axis.join(cells.select(*KEY, "cand_i").distinct(), KEY)
    return grid.join(cells.select(*KEY, "slot", "m", "cand_i", "word"), [*KEY, "slot", "m", "cand_i"], "left").na.fill("", ["word"]).select(*KEY, "t", "slot", "cand_i", "word")


def _matrix(micro: DataFrame) -> DataFrame:
    row = micro.groupBy(*KEY, "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_i", "word"))), lambda x: x["word"]).alias("row"))
    return row.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "row"))), lambda x: x["row"]).alias("rows"))


def switch_edits(rows: list[list[str]], ref: list[str], most: int) -> list[int]:
    """Fewest edits of a path that changes candidate at most s times, for s = 0 .. most.

    One budget after the other: with s changes a line may be entered, at any micro-slot, from the best
    of all lines with s - 1 (``joined``); all candidates' lines advance together.  Reference words are
    skipped after a micro-slot, not before the first one.
    """
    if not rows:
        return [len(ref)] * (most + 1)
    number = {w: i for i, w in enumerate(dict.fromkeys(["", *ref]))}
    said = np.array([[number.get(w, -1) for w in row] for row in rows])
    want, along = np.array([number[w] for w in ref], int), np.arange(len(ref) + 1)
    start = np.full((len(rows) + 1, len(ref) + 1), np.inf)
    start[0, 0] = 0
    joined, out = start, []
    for _ in range(most + 1):
        reached, lines = start.copy(), np.full((said.shape[1], len(ref) + 1), np.inf)
        for t, words in enumerate(said):
            lines = np.minimum(lines, joined[t])
            spoken = (words != 0)[:, None]
            extra = lines + spoken
            matched = lines[:, :-1] + (want != words[:, None])
            extra[:, 1:] = np.where(spoken, np.minimum(extra[:, 1:], matched), extra[:, 1:])
            lines = np.minimum.accumulate(extra - along, axis=1) + along
            reached[t + 1] = lines.min(0)
        out.append(int(reached[-1, -1]))
        joined = reached
    return out


def switch_oracle(micro: DataFrame, refs: DataFrame, budgets: list[int]) -> DataFrame:
    """(key, budget, e): the switch-budget oracle."""

    def fn(r: dict) -> list[dict]:
        e = switch_edits(r["rows"], r["ref"], max(budgets))
        return [{"set_name": r["set_name"], "id": r["id"], "budget": s, "e": e[s]} for s in budgets]

    return per_row(_matrix(micro).join(refs.select(*KEY, "ref").dropDuplicates(KEY), KEY), fn, "set_name string, id long, budget int, e long")


def best_stitch(micro: DataFrame, network: DataFrame, alpha: float = 0.5, eps_conf: float = 0.7) -> DataFrame:
    """(key, words, switched): the one-switch stitch of the largest summed log slot score, where a
    word's score is relative to its slot's best candidate.  Prefix sums are windows."""
    score = network.withColumn("score", slot_score(alpha, eps_conf)).select(*KEY, "slot", "word", "score")
    cell = micro.join(score, [*KEY, "slot", "word"], "left").withColumn("lg", F.log(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(1e-6))))
    cell = cell.withColumn("lg", F.col("lg") - F.max("lg").over(Window.partitionBy(*KEY, "t")))
    path = Window.partitionBy(*KEY, "cand_i").orderBy("t")
    head = F.coalesce(F.sum("lg").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    tail = F.sum("lg").over(path.rowsBetween(0, Window.unboundedFollowing))
    sums = cell.withColumn("head", F.round(head, 9)).withColumn("tail", F.round(tail, 9))
    whole = sums.groupBy(*KEY, "cand_i").agg((F.max("t") + 1).alias("t"), F.round(F.sum("lg"), 9).alias("head")).withColumn("tail", F.lit(0.0))
    ends = sums.select(*KEY, "cand_i", "t", "head", "tail").unionByName(whole.select(*KEY, "cand_i", "t", "head", "tail"))
    best = ends.groupBy(*KEY, "t").agg(F.max(F.struct("head", (-F.col("cand_i")).alias("i"))).alias("h"), F.max(F.struct("tail", (-F.col("cand_i")).alias("j"))).alias("g"))
    top = best.withColumn("_rn", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(F.round(F.col("h.head") + F.col("g.tail"), 9)), "t"))).filter("_rn = 1")
    top = top.select(*KEY, F.col("t").alias("cut"), (-F.col("h.i")).alias("i"), (-F.col("g.j")).alias("j"))
    words = micro.join(top, KEY).filter(((F.col("t") < F.col("cut")) & (F.col("cand_i") == F.col("i"))) | ((F.col("t") >= F.col("cut")) & (F.col("cand_i") == F.col("j"))))
    line = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("t", "word"))), lambda x: x["word"]), lambda w: w != "")
    return words.groupBy(*KEY).agg(line.alias("words"), F.first(F.col("i") != F.col("j")).alias("switched"))


def widen(network: DataFrame, distance: int, decay: float) -> DataFrame:
    """Adds to every slot the words of slots up to ``distance`` away that it lacks, votes decayed."""
    if not distance:
        return network
    place = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("slot"))
    own = F.array(F.struct(F.lit(0).alias("gap"), F.col("p").alias("at")))
    away = F.array(*[F.struct(F.lit(abs(i)).alias("gap"), (F.col("p") + i).alias("at")) for i in range(-distance, distance + 1) if i])
    sent = network.withColumn("p", place).withColumn("x", F.explode(F.when(F.col("word") == "", own).otherwise(F.concat(own, away))))
    # The slot of a place is known from its own words; places before the first and after the last have none.
    here = F.when(F.col("x.gap") == 0, F.col("slot"))
    got = sent.withColumn("_slot", F.max(here).over(Window.partitionBy(*KEY, "x.at"))).filter("_slot is not null")
    item = F.struct("x.gap", F.col("p").alias("q"), "votes", "conf_sum", "ord", "total")
    near = got.groupBy(*KEY, F.col("_slot").alias("slot"), "word").agg(F.min_by(item, F.struct("x.gap", "p")).alias("i"))
    gap, scale = F.col("i.gap"), F.pow(F.lit(decay), F.col("i.gap").cast("double"))
    faded = lambda c: F.when(gap == 0, F.col(f"i.{c}")).otherwise(F.col(f"i.{c}") * scale).alias(c)
    ord_ = F.when(gap == 0, F.col("i.ord")).otherwise((F.lit(LAST) + gap * 100_000 + F.col("i.q")).cast("long")).alias("ord")
    return near.select(*KEY, "slot", "word", faded("votes"), faded("conf_sum"), ord_, F.col("i.total").alias("total"))


def slot_sid(picks: DataFrame, by: list[str]) -> DataFrame:
    """Substitutions and deletions of a positional network, one slot a reference word, and their rate."""
    wrong, empty = F.col("word") != F.col("ref_word"), F.col("word") == ""
    out = picks.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(wrong & ~empty).alias("subs"), F.count_if(empty).alias("dels"))
    return out.withColumn("wer", 100.0 * (F.col("subs") + F.col("dels")) / F.greatest("n", F.lit(1)))
