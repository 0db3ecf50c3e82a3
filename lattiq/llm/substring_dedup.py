"""Removal of repeated word passages with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of one document.  Every word covered by a window that also
starts in a document with a smaller doc_id is removed.

1. Documents with the same word sequence collapse to the smallest doc_id; the others are removed
   whole (if they hold a window).  What follows looks at one document of each class.
2. Every window has an anchor (see ``anchors``); anchors met in one document only cannot recur.
3. Documents with recurring anchors give segments: the words of all windows of one anchor.  Equal
   segments collapse, keeping the smallest and largest doc_id.
4. Windows of the distinct segments are confirmed by a partially aggregated group-by on 128-bit
   digests: those of two documents or more are passages' windows, with their first document.
5. The confirmed windows are compiled into Aho-Corasick automata over words, in shards of about
   ``SHARD_WINDOWS`` windows by anchor; segments of an anchor meet its shard, and the automaton
   locates every occurrence word by word.  The segments of a hot anchor are dealt over several
   shards, each with the anchor's windows, so no shard grows with one anchor's copies.
6. Hits whose first document is smaller than the segment's own are united per document.

Equal segments at equal steps, as periodic texts have them, are one entry.

Edge cases: null texts have no words and hash as the empty text; documents shorter than a window
lose nothing; rows that share a doc_id count as one document for "smaller" and need not have the same
text: each row is reported by its own, identical ones alike; rows without a doc_id are never first
and lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Anchors, recurring, runs, wanted_anchors
from .common import SLICE_BYTES, Words, discard, keyed, lean, possible, rolling, signed, slices, stored

WINDOW, GRAM = 50, 10
SHARD_WINDOWS = 12_000
SALT_SEGMENTS = 64


def _anchors(w: Words) -> Anchors:
    return Anchors(rolling(w.hash, GRAM), w.first, WINDOW, GRAM)


def profiles(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, the hash of the words joined by one space, and the distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, limit=SLICE_BYTES // 2):
                w = Words(s)
                a = _anchors(w)
                cut = np.searchsorted(a.row, np.arange(s.n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[s.rows.column(c) for c in ("rid", "doc_id")],
                        pa.array(w.count, pa.int64()),
                        pa.array([hashlib.sha256(b" ".join(s.text(i).split())).digest() for i in range(s.n)], pa.binary()),
                        pa.array([signed(np.unique(a.h[x:y])) for x, y in zip(cut, cut[1:])], pa.list_(pa.int64())),
                    ],
                    ["rid", "doc_id", "n_words", "digest", "anchors"],
                )

    return docs.select("rid", "doc_id", "text").mapInArrow(lean(run), "rid long, doc_id long, n_words long, digest binary, anchors array<long>")


def _segments(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, start, reps, step, h, segment, words) of the recurring anchors of (rid, doc_id, text, hs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, limit=SLICE_BYTES // 2):
                w = Words(s)
                a = _anchors(w)
                at = wanted_anchors(s, a)
                first, last, row = a.start[at], a.start[at] + a.windows[at] - 1 + WINDOW, a.row[at]
                before = np.concatenate([[0], np.cumsum(w.hash, dtype=np.uint64)])
                head, reps, step = runs(row, a.h[at], before[last] - before[first], first, WINDOW)
                first, last, row = first[head], last[head], row[head]
                words = [b" ".join(s.data[w.start[x] : w.end[y - 1]].tobytes().split()) for x, y in zip(first, last)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[s.rows.column(c).take(pa.array(row)) for c in ("rid", "doc_id")],
                        pa.array(first - w.first[row], pa.int64()),
                        pa.array(reps, pa.int32()),
                        pa.array(step, pa.int32()),
                        pa.array(signed(a.h[at][head])),
                        pa.array([hashlib.md5(x).digest() for x in words], pa.binary()),
                        pa.array(words, pa.binary()),
                    ],
                    ["rid", "doc_id", "start", "reps", "step", "h", "segment", "words"],
                )

    return docs.select("rid", "doc_id", "text", "hs").mapInArrow(lean(run), "rid long, doc_id long, start long, reps int, step int, h long, segment binary, words binary")


def _windows(segments: DataFrame) -> DataFrame:
    """Every window of the distinct segments with a 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.set_column(batch.schema.get_field_index("words"), "words", batch.column("words").cast(pa.string())), "words", 500_000):
                w = Words(s)
                count = np.maximum(w.count - WINDOW + 1, 0)
                row = np.repeat(np.arange(s.n), count)
                off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = w.first[row] + off
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(signed(rolling(w.hash, WINDOW, v)[at])) for v in range(2)], *[s.rows.column(c).take(pa.array(row)) for c in ("h", "segment", "lo", "hi")], pa.array(off.astype(np.int32))],
                    ["x", "y", "h", "segment", "lo", "hi", "off"],
                )

    return segments.select("h", "segment", "lo", "hi", "words").mapInArrow(lean(run), "x long, y long, h long, segment binary, lo long, hi long, off int")


class Automaton:
    """Aho-Corasick over words: every distinct word of the shard's windows is one code point."""

    def __init__(self) -> None:
        self.code: dict[bytes, str] = {}
        self.auto = ahocorasick.Automaton()

    def spell(self, words: list[bytes], grow: bool) -> str:
        out = []
        for x in words:
            c = self.code.get(x)
            if c is None and grow:
                n = len(self.code) + 2
                c = self.code[x] = chr(n if n < 0xD800 else n + 0x800)
            out.append(c or "\x01")
        return "".join(out)

    def add(self, words: list[bytes], first: int) -> None:
        self.auto.add_word(self.spell(words, True), (len(words), first))

    def compile(self) -> None:
        if len(self.auto):
            self.auto.make_automaton()

    def occurrences(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(first word, first document) of every occurrence of every window, in order."""
        if not len(self.auto):
            return []
        return [(end - n + 1, doc) for end, (n, doc) in self.auto.iter(self.spell(words, False))]


def _locate(dealt: DataFrame) -> DataFrame:
    """Run the automata: rows sorted by shard, a shard's windows (kind 0) before its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, auto, ready = None, Automaton(), False
        for batch in batches:
            seg, offs, firsts = [], [], []
            cols = [batch.column(c).to_pylist() for c in ("shard", "kind", "segment", "words", "offs", "firsts")]
            for sh, kind, segment, words, off, first in zip(*cols):
                if sh != shard:
                    shard, auto, ready = sh, Automaton(), False
                words = words.split(b" ")
                if kind == 0:
                    for o, f in zip(off, first):
                        auto.add(words[o : o + WINDOW], f)
                    continue
                if not ready:
                    auto.compile()
                    ready = True
                hits = auto.occurrences(words)
                if hits:
                    seg.append(segment)
                    offs.append([a for a, _ in hits])
                    firsts.append([b for _, b in hits])
            yield pa.RecordBatch.from_arrays([pa.array(seg, pa.binary()), pa.array(offs, pa.list_(pa.int32())), pa.array(firsts, pa.list_(pa.int64()))], ["segment", "offs", "firsts"])

    return dealt.mapInArrow(lean(run), "segment binary, offs array<int>, firsts array<long>")


def _hits(segments: DataFrame) -> DataFrame:
    """segment -> offsets of its recurring windows and their first documents."""
    distinct = stored(segments.groupBy("segment").agg(F.first("h").alias("h"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("words").alias("words")), "distinct")
    owner = F.min_by(F.struct("segment", "off"), F.struct("lo", "segment", "off"))
    confirmed = _windows(distinct).groupBy("x", "y").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.first("h").alias("h"), owner.alias("at")).filter("first < last")
    passages = confirmed.groupBy("at.segment").agg(F.first("h").alias("h"), F.collect_list(F.struct(F.col("at.off"), "first")).alias("w"))
    passages = stored(passages.join(distinct.select("segment", "words"), "segment"), "passages")
    shards = (passages.agg(F.sum(F.size("w"))).first()[0] or 0) // SHARD_WINDOWS + 1
    per_anchor = distinct.groupBy("h").agg(F.count("*").alias("n")).select("h", F.ceil(F.col("n") / SALT_SEGMENTS).cast("int").alias("salts"))
    shard = F.pmod(F.xxhash64("h", "salt"), F.lit(shards)).alias("shard")
    spread = passages.join(per_anchor, "h").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    patterns = spread.select(shard, F.lit(0).alias("kind"), "segment", "words", F.col("w.off").alias("offs"), F.col("w.first").alias("firsts"))
    streamed = distinct.join(passages.select("h").distinct(), "h", "left_semi").join(per_anchor, "h").withColumn("salt", F.pmod(F.xxhash64("segment"), F.col("salts")).cast("int"))
    streamed = streamed.select(shard, F.lit(1).alias("kind"), "segment", "words", F.lit(None).cast("array<int>").alias("offs"), F.lit(None).cast("array<bigint>").alias("firsts"))
    dealt = patterns.unionByName(streamed).repartition(max(1, min(shards, 4096)), "shard").sortWithinPartitions("shard", "kind")
    return _locate(dealt)


def _cut(rows: DataFrame) -> DataFrame:
    """(rid, text, spans) -> what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                out = []
                for text, lows, highs in zip(*[part.column(c).to_pylist() for c in ("text", "lows", "highs")]):
                    words = (text or "").encode().split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, lows, 1)
                    np.add.at(gone, highs, -1)
                    left = [w for w, g in zip(words, np.cumsum(gone)) if g == 0]
                    out.append((len(words) - len(left), b" ".join(left)))
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array([n for n, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary()).cast(pa.string())], ["rid", "n_removed", "kept"])

    rows = rows.select("rid", "text", F.col("spans.lo").alias("lows"), F.col("spans.hi").alias("highs"))
    return rows.mapInArrow(lean(run), "rid long, n_removed long, kept string")


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all, cut) of keyed docs (rid, doc_id, text): ``all`` has rid, doc_id, n_words, digest and whole (the
    document repeats an earlier one), ``cut`` has rid, n_removed and kept where words are removed."""
    profile = stored(profiles(docs), "profiles")
    first = profile.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    whole = F.coalesce((F.col("n_words") >= WINDOW) & (F.col("first") < F.col("doc_id")), F.lit(False))
    everything = stored(profile.drop("anchors").join(first, "digest", "left").withColumn("whole", whole).drop("first"), "everything")
    gone = everything.filter("whole").select("rid").distinct()
    entries = profile.filter(F.col("doc_id").isNotNull()).select("rid", "anchors").join(gone, "rid", "left_anti").select("rid", F.explode("anchors").alias("h"))
    wanted = entries.join(recurring(entries, across=True), "h").groupBy("rid").agg(F.collect_set("h").alias("hs"))
    wanted = stored(wanted, "wanted")
    discard(profile)
    subject = stored(possible(docs, wanted.select("rid"), "rid").join(wanted, "rid").dropDuplicates(["rid"]), "subjects")
    discard(wanted)
    segments = stored(_segments(subject), "segments")
    hits = stored(_hits(segments), "hits")
    placed = segments.select("rid", "doc_id", "start", "reps", "step", "segment").join(hits, "segment")
    end = F.col("start") + (F.col("reps") - 1) * F.col("step") + WINDOW
    spans = F.transform(F.filter(F.arrays_zip("offs", "firsts"), lambda x: x["firsts"] < F.col("doc_id")), lambda x: F.struct((F.col("start") + x["offs"]).alias("lo"), (end + x["offs"]).alias("hi")))
    found = placed.withColumn("spans", spans).filter(F.size("spans") > 0).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    found = stored(found, "found")
    discard(segments, hits)
    # Merged, as a broadcast join would leave two Python operators, and so two workers, to a task.
    cut = stored(_cut(possible(subject.select("rid", "text"), found.select("rid"), "rid").join(found.hint("merge"), "rid")), "cut")
    discard(subject, found)
    return everything, cut


def report(docs: DataFrame) -> DataFrame:
    everything, cut = removals(keyed(docs))
    cut = cut.select("rid", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("sha"))
    out = everything.join(cut, "rid", "left")
    removed = F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(F.col("whole"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("digest"))))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), sha.alias("kept_sha256"))
