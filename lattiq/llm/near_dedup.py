"""MinHash near-duplicate classes from bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles (hashes of lower-cased words).  Two sets are linked
from a similarity of ``percent`` on, which the caller chooses (op9 ``PERCENT``, the pipeline 80).

1. Documents with equal sets collapse to the smallest doc_id by one partially aggregated group-by.
2. Inverted lists hold, for each of the ``probes_of(percent)`` smallest hash values of a set, the
   documents that retain it.  Two sets at the threshold share fewer than two of them with probability
   ``MISS`` at most (10 values at 85 %, 12 at 80 %), so pairs of a short list (up to ``SHORT`` documents) that share fewer than two, or differ too much in
   size, are dropped; members of a long list stay only where a second retained value is shared too.
3. What is left of a list is one block.  A list of more than ``BLOCK`` members is cut by size class
   (linked sets differ by at most one class) and by hash into blocks, and every two blocks that may
   hold links meet in a group of their own, so no group is ever collected whole and none is dropped.
4. In a block, overlaps of the bottom-``SKETCH`` sketches are counted through the retained values, the
   union-sketch estimate drops pairs more than ``SLACK`` standard deviations below the threshold, and the rest are
   confirmed on the full sets.  Pairs already connected through confirmed links are skipped, so a
   block returns at most one link a member.
5. Components by hooking every node to its smallest neighbour, pointer jumping and shrinking what is
   connected to one node, on tables in the shared folder, until no link is left.

Edge cases: a text of fewer than five words is one shingle of them all; null texts and texts without
words have the empty set and are linked with nothing; rows that share a doc_id are one node; a null
doc_id is its own component (component_id null, kept true).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, grams, lean, possible, signed, slices, stored

K = 5
MISS = 4e-7
SHORT = 16
SKETCH = 128
SLACK = 5.07
BLOCK = 512
PERCENT = 85
SLICE = 500_000


def probes_of(percent: int) -> int:
    """The fewest retained values of which a pair at the threshold shares two but for ``MISS``."""
    j, n = percent / 100, 2
    while (1 - j) ** n + n * j * (1 - j) ** (n - 1) > MISS:
        n += 1
    return n


def least_estimate(percent: int) -> float:
    """The union-sketch estimate below which a pair is not confirmed."""
    j = percent / 100
    return j - SLACK * float(np.sqrt(j * (1 - j) / SKETCH))


def shingle_sets(s, fold: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row of a slice."""
    w = Words(s, fold=fold)
    g = grams(w.hash, K, 1)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        n = b - a
        if n >= K:
            out.append(np.unique(g[a : b - K + 1]))
        else:
            out.append(grams(w.hash[a:b], int(n), 100 + int(n)) if n else np.zeros(0, np.uint64))
    return out


_PROFILE = "doc_id long, n_shingles long, set_a long, set_b long, probes array<long>"


def profiles(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, set size, a 128-bit digest of the set, and its smallest values."""
    probes = probes_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, limit=SLICE):
                sets = shingle_sets(s)
                xor = np.array([np.bitwise_xor.reduce(x) if len(x) else 0 for x in sets], np.uint64)
                total = np.array([x.sum(dtype=np.uint64) if len(x) else 0 for x in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [s.rows.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(signed(xor)), pa.array(signed(total)), pa.array([signed(x[:probes]) for x in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "probes"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), _PROFILE)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def links(sets: list[np.ndarray], left: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs among sorted hash sets.

    ``left`` (if given) marks the sets of the one block; only pairs across the two blocks are tried.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    sketch = [x[:SKETCH] for x in sets]
    limit = np.array([x[-1] if len(s) > SKETCH else np.iinfo(np.uint64).max for x, s in zip(sketch, sets)], np.uint64)
    values = np.concatenate(sketch)
    owner = np.repeat(np.arange(n), [len(x) for x in sketch])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]))
    degree = np.bincount(column)
    shared = degree[column] > 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((n, n), np.float32)
    _, column = np.unique(column, return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    for lo in range(0, width, 4096):
        here = (column >= lo) & (column < lo + 4096)
        m = np.zeros((n, min(4096, width - lo)), np.float32)
        m[owner[here], column[here] - lo] = 1
        common += m @ m.T
    ratio_ok = 100 * np.minimum(size[:, None], size[None]) >= percent * np.maximum(size[:, None], size[None])
    floor = least_estimate(percent) * np.minimum(np.minimum(size, SKETCH)[:, None], np.minimum(size, SKETCH)[None]) / 2
    maybe = ratio_ok & (common >= floor) & (common > 0)
    if left is not None:
        maybe &= left[:, None] != left[None]
    i, j = np.nonzero(np.triu(maybe, 1))
    top = np.minimum(limit[i], limit[j])
    within = lambda k: np.array([np.searchsorted(sketch[a], t, "right") for a, t in zip(k, top)])
    estimate = common[i, j] / np.maximum(within(i) + within(j) - common[i, j], 1) if len(i) else np.zeros(0)
    keep = np.flatnonzero(estimate >= least_estimate(percent))
    found, forest = [], _Union(n)
    for k in keep[np.argsort(-estimate[keep], kind="stable")]:
        a, b = int(i[k]), int(j[k])
        if forest.find(a) == forest.find(b):
            continue
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * both >= percent * (size[a] + size[b] - both):
            forest.join(a, b)
            found.append((a, b))
    return found


def _blocks(lists: DataFrame, percent: int) -> DataFrame:
    """(v, block, doc_id, side) rows: which members meet where."""
    cls = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(percent / 100))).cast("int")
    short = lists.filter(F.col("m") <= BLOCK).select("v", F.lit("").alias("block"), "doc_id", F.lit(0).alias("side"))
    long = lists.filter(F.col("m") > BLOCK).withColumn("c", cls)
    sizes = long.groupBy("v", "c").agg(F.count("*").alias("mc"))
    cuts = F.ceil(F.col("mc") / BLOCK).cast("int")
    own = long.join(sizes, ["v", "c"]).withColumn("cuts", cuts).withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int"))
    above = sizes.select("v", (F.col("c") - 1).alias("c"), cuts.alias("up"))
    below = sizes.select("v", (F.col("c") + 1).alias("c"), cuts.alias("down"))
    own = own.join(above, ["v", "c"], "left").join(below, ["v", "c"], "left").na.fill(0, ["up", "down"])
    name = lambda c, i, d, j: F.concat_ws(".", c, i, d, j)
    same = own.select(
        "v", "doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(name(F.col("c"), F.least("sub", k), F.col("c"), F.greatest("sub", k)).alias("block"), F.when(F.col("sub") <= k, 0).otherwise(1).alias("side")))).alias("x")
    )
    upward = own.filter("up > 0").select("v", "doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("up") - 1), lambda k: F.struct(name(F.col("c"), F.col("sub"), F.col("c") + 1, k).alias("block"), F.lit(0).alias("side")))).alias("x"))
    downward = own.filter("down > 0").select("v", "doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda k: F.struct(name(F.col("c") - 1, k, F.col("c"), F.col("sub")).alias("block"), F.lit(1).alias("side")))).alias("x"))
    long = same.unionByName(upward).unionByName(downward).select("v", "x.block", "doc_id", "x.side")
    return short.unionByName(long)


def _candidates(twins: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(v, doc_id, n, m): lists of the documents that share at least two retained values; the tables they are made of."""
    docs = twins.select(F.col("rep").alias("doc_id"), "n", "probes")
    entries = docs.select(F.explode("probes").alias("v"), "doc_id", "n", "probes")
    sizes = entries.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1")
    entries = stored(entries.join(sizes, "v"), "entries")
    short = entries.filter(F.col("m") <= SHORT).drop("m")
    side = lambda s: short.select("v", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "probes")])
    alike = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.size(F.array_intersect("probes_a", "probes_b")) >= F.least(F.lit(2), "n_a", "n_b"))
    pairs = side("a").join(side("b"), "v").filter(F.col("doc_id_a") < F.col("doc_id_b")).filter(alike)
    pairs = pairs.groupBy("doc_id_a", "doc_id_b", "n_a", "n_b").agg(F.min("v").alias("v"))
    ends = pairs.select("v", F.explode(F.array(F.struct(F.col("doc_id_a").alias("doc_id"), F.col("n_a").alias("n")), F.struct(F.col("doc_id_b").alias("doc_id"), F.col("n_b").alias("n")))).alias("x"))
    kept = ends.select("v", "x.doc_id", "x.n").distinct()
    long = entries.filter(F.col("m") > SHORT).select("v", "doc_id", "n", F.explode_outer(F.filter("probes", lambda p: p > F.col("v"))).alias("second"))
    twice = long.groupBy("v", "second").agg(F.count("*").alias("k")).filter((F.col("k") > 1) | F.col("second").isNull())
    kept = kept.unionByName(long.join(twice.drop("k"), (long["v"] == twice["v"]) & long["second"].eqNullSafe(twice["second"]), "left_semi").select("v", "doc_id", "n").distinct())
    kept = stored(kept, "kept")
    discard(entries)
    lists = kept.groupBy("v").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc_id")).alias("s1"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("s2")).filter("m > 1")
    return kept.join(lists.groupBy("m", "s1", "s2").agg(F.min("v").alias("v")).select("v", "m"), "v"), [kept]


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the wanted documents, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, limit=SLICE):
                yield pa.RecordBatch.from_arrays([s.rows.column("doc_id"), pa.array([x.tobytes() for x in shingle_sets(s)], pa.binary())], ["doc_id", "shingles"])

    sets = possible(docs.select("doc_id", "text"), wanted, then=run, schema="doc_id long, shingles binary")
    return sets.join(wanted, "doc_id", "left_semi")


def _confirmed(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within every (v, block); many small blocks share a task and a Python call."""

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        sides = np.array([r[1] for r in rows])
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        return [(rows[i][0], rows[j][0]) for i, j in links(sets, sides if sides.any() else None, percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("v", "block", "doc_id", "side", "shingles")]
            for v, block, *rest in zip(*cols):
                if (v, block) != key:
                    out += flush(rows)
                    key, rows = (v, block), []
                rows.append(tuple(rest))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
                out = []
        out += flush(rows)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    dealt = members.repartition("v", "block").sortWithinPartitions("v", "block")
    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of the symmetric edges (a, b), all nodes of a root connected.

    Every node hooks to its smallest neighbour.  Of the nodes on a cycle of such hooks each has the
    next but one no larger than itself, so cycles are pairs, and the smaller of a pair becomes a root;
    pointer jumping, which halves the distances, brings the rest to it.  A root has two nodes at least.
    """
    hook = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hooks")
    back = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
    root = F.when((F.col("next") == F.col("node")) & (F.col("node") < F.col("root")), F.col("node")).otherwise(F.col("root"))
    up = stored(hook.join(back, "root").select("node", root.alias("root")), "hooks")
    discard(hook)
    while True:
        far = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = stored(up.join(far, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "hooks")
        discard(up)
        if new.filter("moved").isEmpty():
            return new
        up = new


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component) for every node of the undirected edges (a, b): the smallest node reachable.

    Each round shrinks the connected nodes of ``_roots`` to one, which at least halves the nodes that
    still have a neighbour; it ends after log2 of the nodes of the largest component at most.
    """
    left = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges")
    labels = None
    while labels is None or not left.isEmpty():
        roots = _roots(left)
        own = roots.select("node", "root")
        if labels is None:
            new = own.withColumnRenamed("node", "doc_id")
        else:
            new = labels.join(own.withColumnRenamed("node", "label"), "label", "left").select("doc_id", F.coalesce("root", "label").alias("root"))
        new = stored(new.select("doc_id", F.col("root").alias("label")), "labels")
        ends = left.join(own.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        fewer = stored(ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        for table in (left, roots, *([] if labels is None else [labels])):
            discard(table)
        left, labels = fewer, new
    least = labels.groupBy("label").agg(F.min("doc_id").alias("component"))
    return labels.join(least, "label").select("doc_id", "component")


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id long, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = stored(profiles(docs, percent), "profiles")
    filled = profile.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    twins = filled.groupBy("set_a", "set_b", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.first("probes").alias("probes"))
    twins = stored(twins, "twins")
    # Rows of one doc_id with different texts are one node, and so are equal sets.
    same = filled.join(twins.select("set_a", "set_b", F.col("n").alias("n_shingles"), "rep"), ["set_a", "set_b", "n_shingles"]).select("doc_id", "rep").distinct()
    same = stored(same, "same")
    rows = stored(profile.select("doc_id", "n_shingles"), "rows")
    discard(profile)
    lists, used = _candidates(twins, percent)
    members = stored(_blocks(lists, percent), "members")
    discard(twins, *used)
    found = stored(_confirmed(members.join(_full_sets(docs, members.select("doc_id").distinct()), "doc_id"), percent), "links")
    discard(members)
    ends = same.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).filter("a < top")
    near = components(found.unionByName(same.join(ends, "doc_id").select("a", F.col("rep").alias("b"))))
    own = same.join(near.withColumnRenamed("doc_id", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = rows.join(own, "doc_id", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
