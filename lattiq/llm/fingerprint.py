"""Document fingerprints from closed syncmers, in DataFrame expressions only.

Words are hashed; a k-mer of ``K`` consecutive words is kept when the smallest hash among its inner
``S``-word substrings lies at its first or last place (a closed syncmer).  The choice depends on the
k-mer alone, so an edit elsewhere never moves it, and every kept k-mer is an anchor with a position.
The fingerprint is the ``SIZE`` smallest distinct syncmer hashes, each with its first position; likeness
of two fingerprints is the share of common hashes among the ``SIZE`` smallest of their union (an
unbiased Jaccard estimate).  The positions match texts place by place: of the anchors that a text
shares with its edited one, ``in_place`` is the share that have not moved.

Edge cases: a text of fewer than ``K`` words is one k-mer of all its words; null, empty or
white-space texts have the empty fingerprint, which is like itself (1.0) and like nothing else
(0.0).  Repeated rows are handled one by one; with repeated or null doc_ids the "next" document is
the next row in (doc_id, text) order, nulls first.  A single document's next is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S, SIZE = 5, 2, 64
BLOCK_ROWS, FAN, DEPTH = 2000, 64, 3


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kmer(h: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(h, i + j) for j in range(n)])


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<position, hash>> of the closed syncmers of a text, in order."""
    inner = k - s + 1

    def of_hashes(h: Column) -> Column:
        def of_smers(m: Column) -> Column:
            def closed(i: Column) -> Column:
                return F.least(F.get(m, i), F.get(m, i + (inner - 1))) <= F.least(*[F.get(m, i + j) for j in range(1, inner - 1)])

            kept = F.filter(F.sequence(F.lit(0), F.size(h) - k), closed)
            return F.transform(kept, lambda i: F.struct(i.alias("position"), _kmer(h, i, k).alias("hash")))

        smers = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: _kmer(h, i, s))
        short = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")).alias("hash")))
        return F.when(F.size(h) == 0, F.filter(short, lambda x: F.lit(False))).when(F.size(h) < k, short).otherwise(let(smers, of_smers))

    return let(_word_hashes(text), of_hashes)


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch(text: Column, k: int = K, s: int = S, size: int = SIZE) -> Column:
    """The ``size`` smallest distinct syncmers of a text as structs (hash, first position), ascending."""

    def distinct(all_: Column) -> Column:
        return F.filter(all_, lambda x, i: (i == 0) | (x["hash"] != F.get(all_, i - 1)["hash"]))

    by_hash = F.transform(anchors(text, k, s), lambda a: F.struct(a["hash"].alias("hash"), a["position"].alias("position")))
    return F.slice(let(F.array_sort(by_hash), distinct), 1, size)


def in_place(a: Column, b: Column) -> Column:
    """Share of the common hashes of two sketches that have the same position; null without any."""
    common = F.size(F.array_intersect(hashes(a), hashes(b)))
    return F.when(common > 0, F.size(F.array_intersect(a, b)) / common)


def hashes(marks: Column) -> Column:
    return marks.getField("hash")


def as_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ",")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Share of common values among the ``size`` smallest of the union of two sketches."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    share = let(union, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def _block_of(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most key, by a search of up to DEPTH levels of FAN cuts."""
    if len(cuts) <= FAN:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda e: e <= key))
    step = FAN ** (DEPTH - 1) if len(cuts) > FAN ** (DEPTH - 1) else FAN
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    lists = F.array(*[F.array(*[F.lit(c) for c in p]).cast("array<bigint>") for p in parts])
    heads = F.array(*[F.lit(p[0]) for p in parts]).cast("array<bigint>")
    own = F.greatest(F.size(F.filter(heads, lambda e: e <= key)) - 1, F.lit(0))
    return own * step + F.size(F.filter(F.get(lists, own), lambda e: e <= key))


def with_next(docs: DataFrame, text: str, made: str, make, order: list[str]) -> DataFrame:
    """Each row with _next, the ``text`` and ``made`` = make(text) of the following row in global order
    (the last gets the first's).

    Rows are dealt into blocks of about ``BLOCK_ROWS`` (at most FAN**DEPTH blocks) by approximate
    quantiles of the id, of which one a block reaches the driver, so no task sorts more than a block.
    The first text of each block closes the seams; only there is ``make`` carried out again.
    """
    key = F.coalesce(F.col(order[0]), F.lit(-(1 << 63)))
    n = min(max(1, docs.count() // BLOCK_ROWS), FAN**DEPTH)
    cuts = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0] if n > 1 else []
    block = _block_of(key, sorted(set(cuts or []))) if cuts else F.lit(0)
    rows = docs.withColumn("_block", block)
    w = Window.partitionBy("_block").orderBy(*[F.asc_nulls_first(c) for c in order])
    led = rows.withColumn("_next", F.lead(F.struct(text, made)).over(w))
    firsts = rows.groupBy("_block").agg(F.min_by(F.col(text), F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])).alias("_head"))
    seam = Window.orderBy("_block")
    everything = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select("_block", F.coalesce(F.lead("_head").over(seam), F.first("_head").over(everything)).alias("_head"))
    return led.join(heads, "_block").withColumn("_next", F.coalesce("_next", F.struct(F.col("_head").alias(text), make(F.col("_head")).alias(made)))).drop("_block", "_head")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and anchors-based likeness to the edited text and to the next document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = with_next(rows.withColumn("sketch", sketch(F.col("text"))), "text", "sketch", sketch, ["doc_id", "text"])
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("_next.text"), F.lit(1), cut))
    pairs = pairs.withColumn("edited", edited)
    pairs = pairs.withColumn("edited_sketch", sketch(F.col("edited")))
    own, other, following = (hashes(F.col(c)) for c in ("sketch", "edited_sketch", "_next.sketch"))
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        in_place(F.col("sketch"), F.col("edited_sketch")).alias("in_place"),
    )
