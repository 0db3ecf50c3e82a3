"""Byte-level removal of repeated strings with a run-length compressed suffix index.

Every byte covered by a ``WINDOW``-byte string that also starts earlier (in a document of smaller
doc_id, or earlier in the same one) is removed.

1. Documents equal byte for byte collapse to the smallest doc_id; the others are removed whole.
2. Windows are represented by anchors (see ``anchors``); an anchor met only once cannot recur.
   The windows of one recurring anchor are a segment; equal segments collapse to the earliest, and
   all their later occurrences are covered.
3. The distinct segments are dealt by anchor.  Each task builds, for a chunk of whole anchor groups,
   a run-length index (``RunLengthIndex``): the Burrows-Wheeler transform as runs, the LF mapping per
   run, and for every class of suffixes that agree on ``WINDOW`` bytes a sample of its earliest
   position.  The segments are streamed backwards through it in lockstep; where the match statistic
   reaches ``WINDOW`` and the sample is earlier than the place itself, the window is marked.
4. Groups of more than ``HOT`` distinct segments would make one task long and are split by longer
   context: the windows that hold the anchor at offsets of one bin all hold the same bytes around it,
   which key their piece of the segment.  Equal pieces collapse to the earliest as segments do, pieces
   alone under their key are done, and what is left is indexed as in 3, or split again into narrower
   bins.  The last bins are one window wide, where equal keys are equal windows; so a segment costs a
   few pieces, not one row a window, however common its anchor is.
5. Marks are united per document.

Occurrences of segments are kept as 128-bit hashes; bytes move only for segments whose anchor has two
or more of them, since the windows of one segment hold its anchor at different offsets and so differ.
Equal segments at equal steps, as periodic texts have them, are one entry.

Edge cases: null texts are empty; texts shorter than a window lose nothing; rows of one doc_id count
as equal in order and need not have the same text: of such rows none is removed whole for another,
and identical ones get the same result; rows without a doc_id lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Anchors, leftmost, recurring, runs, wanted_anchors
from .common import Slice, byte_symbols, discard, keyed, lean, mix, possible, rolling, signed, slices, span_hash, stored

WINDOW, GRAM = 100, 24
HOT = 1024
BINS = (20, 5, 1)  # widths, each a divisor of the one before
CHUNK = 600_000


def _suffix_order(code: np.ndarray, left: np.ndarray, depth: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by their suffixes up to the terminator (code 0, ``left`` places ahead), equal tails in
    text order; and ranks by the first ``depth`` symbols.

    A rank is one more than the place of its first member in the order.  Suffixes begin as one number of as
    many symbols as 63 bits hold; then only those still tied are sorted, by the ranks of two places ahead."""
    n = len(code)
    ahead = lambda x, i, step: np.where(left[i] >= step, x[np.minimum(i + step, n - 1)], 0)
    used = np.zeros(int(code.max()) + 1, bool)
    used[code], used[0] = True, True
    dense, sigma = (np.cumsum(used) - 1)[code], max(int(used.sum()), 2)
    deep, key = 1, dense.copy()
    while deep < min(depth, n) and sigma ** (deep + 1) < 1 << 63:
        key *= sigma
        key[: n - deep] += dense[deep:]
        deep += 1
    short = np.flatnonzero(left < deep - 1)  # nothing beyond the terminator
    beyond = np.power(sigma, deep - 1 - left[short])
    key[short] = key[short] // beyond * beyond
    tied, rank, at_depth, wide = None, np.empty(n, np.int64), None, (n + 2) ** 3 < 1 << 63
    while True:
        order = np.argsort(key)
        key, at = key[order], np.arange(len(order))
        head = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.maximum.accumulate(np.where(head, at, 0))
        if tied is None:
            tied = order
            rank[tied] = place + 1
        else:
            tied = tied[order]
            group = rank[tied]
            old = np.concatenate([[True], group[1:] != group[:-1]])
            rank[tied] = group + place - np.maximum.accumulate(np.where(old, at, 0))
        if deep == depth:
            at_depth = rank.copy()
        tied = tied[~(head & np.append(head[1:], True))]
        tied = tied[left[tied] >= deep]  # tails that have ended stay equal
        if deep >= max(longest, depth) or not len(tied):
            break
        # up to twice as far again, and no further than ``depth`` before it has been reached
        step = deep if deep >= depth else min(deep, depth - deep)
        further = step if deep >= depth else min(step, depth - deep - step)
        key = rank[tied] * (n + 2) + ahead(rank, tied, step)
        if wide and further:
            key = key * (n + 2) + ahead(rank, tied, step + further)
            step += further
        deep += step
    order = np.empty(n, np.int64)
    order[rank - 1] = np.arange(n)
    same = np.flatnonzero(np.bincount(rank)[rank] > 1)
    same = same[np.argsort(rank[same], kind="stable")]
    own = rank[same]
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    order[own - 1 + np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own))))] = same
    return order, rank if at_depth is None else at_depth


class RunLengthIndex:
    """Index of the concatenation of texts, each closed by its own terminator.

    ``run_start``, ``run_head`` are the runs of the transform, ``run_to`` the LF image of each run's
    first place.  ``class_start``/``class_end`` delimit the suffix-array ranges of two or more
    suffixes agreeing on ``depth`` bytes, ``class_first`` is the smallest text position in each.
    """

    def __init__(self, texts: list[bytes], depth: int = WINDOW):
        size = np.array([len(t) for t in texts]) + 1
        self.end = np.cumsum(size) - 1  # positions of the terminators
        self.begin = self.end - size + 1
        n = int(size.sum())
        code = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        code[self.end] = 0
        left = np.repeat(self.end, size) - np.arange(n)  # bytes before the terminator
        order, at_depth = _suffix_order(code, left, depth, int(size.max()))
        last = code[np.maximum(order - 1, 0)]
        begins = np.zeros(n, bool)
        begins[self.begin] = True
        last[begins[order]] = 0  # before a text: a terminator
        head = np.concatenate([[True], last[1:] != last[:-1]])
        self.run_start = np.flatnonzero(head)
        self.run_head = last[self.run_start]
        length = np.diff(np.append(self.run_start, n))
        by_head = np.argsort(self.run_head.astype(np.uint16), kind="stable")
        self.run_to = np.empty(len(length), np.int64)
        self.run_to[by_head] = np.cumsum(length[by_head]) - length[by_head]
        full = left[order] >= depth
        same = np.concatenate([[False], (at_depth[order][1:] == at_depth[order][:-1]) & full[1:] & full[:-1], [False]])
        self.class_start = np.flatnonzero(~same[:-1] & same[1:])
        self.class_end = np.flatnonzero(same[:-1] & ~same[1:]) + 1
        self.class_first = np.minimum.reduceat(np.append(order, n), np.stack([self.class_start, self.class_end], 1).ravel())[::2] if len(self.class_start) else np.zeros(0, np.int64)
        self.runs = len(self.run_start)

    def back(self, place: np.ndarray) -> np.ndarray:
        """LF: the place of the suffix one byte longer."""
        run = np.searchsorted(self.run_start, place, "right") - 1
        return self.run_to[run] + place - self.run_start[run]

    def earliest(self, place: np.ndarray) -> np.ndarray:
        """Where the place's suffix matches another on the whole depth: the class's first position, else -1."""
        if not len(self.class_start):
            return np.full(len(place), -1)
        k = np.searchsorted(self.class_start, place, "right") - 1
        return np.where((k >= 0) & (place < self.class_end[np.maximum(k, 0)]), self.class_first[np.maximum(k, 0)], -1)

    def repeated(self, doc: np.ndarray | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(text, offset) of every window with an earlier occurrence: all texts streamed backwards.

        Texts come in order of the documents and places they were cut from; windows at the same
        place of two rows of one doc_id are not earlier than each other."""
        live = np.argsort(self.begin - self.end, kind="stable")  # longest first
        length = (self.end - self.begin)[live]
        steps = np.arange(1, int(length[0]) + 1 if len(length) else 1)
        number = np.searchsorted(-length, -steps, "right")  # texts at least so long
        if not number.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        everywhere = np.arange(int(self.end[-1]) + 1)
        back, earliest = self.back(everywhere), self.earliest(everywhere)
        place, places = live.astype(np.int64), []  # terminators sort first, in text order
        for n in number:
            place = back[place[:n]]
            places.append(place)
        first = earliest[np.concatenate(places)]
        text = live[np.arange(len(first)) - np.repeat(np.cumsum(number) - number, number)]
        at = self.end[text] - np.repeat(steps, number)
        hit = np.flatnonzero((first >= 0) & (first < at))
        if doc is not None:
            there, here = np.searchsorted(self.end, first[hit]), text[hit]
            place_of = lambda text, x: start[text] + x - self.begin[text]
            hit = hit[(doc[there] != doc[here]) | (place_of(there, first[hit]) != place_of(here, at[hit]))]
        return text[hit], at[hit] - self.begin[text[hit]]


def _anchors(s: Slice) -> Anchors:
    return Anchors(rolling(byte_symbols(s.data), GRAM), s.off, WINDOW, GRAM)


def profiles(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_bytes, sha-256 of the bytes, and the anchors (twice if met more than once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch):
                a = _anchors(s)
                order = np.lexsort((a.h, a.row))
                h, row = a.h[order], a.row[order]
                keep = np.ones(len(h), bool)
                keep[2:] = (h[2:] != h[:-2]) | (row[2:] != row[:-2])
                h, row = h[keep], row[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[s.rows.column(c) for c in ("rid", "doc_id")],
                        pa.array(np.diff(s.off), pa.int64()),
                        pa.array([hashlib.sha256(s.text(i)).digest() for i in range(s.n)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(s.n + 1)).astype(np.int32)), pa.array(signed(h))),
                    ],
                    ["rid", "doc_id", "n_bytes", "digest", "anchors"],
                )

    return docs.select("rid", "doc_id", "text").mapInArrow(lean(run), "rid long, doc_id long, n_bytes long, digest binary, anchors array<long>")


def _segments(docs: DataFrame) -> DataFrame:
    """The segments of the wanted anchors: where they start, and 128 bits of hash in place of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch):
                a = _anchors(s)
                at = wanted_anchors(s, a)
                lo, hi, row = a.start[at], a.start[at] + a.windows[at] - 1 + WINDOW, a.row[at]
                x, y = (span_hash(s.data, lo, hi, v) for v in range(2))
                head, reps, step = runs(row, x, y, lo, WINDOW)
                row = row[head]
                cols = [lo[head] - s.off[row], (hi - lo)[head].astype(np.int32), reps.astype(np.int32), step.astype(np.int32), signed(a.h[at][head]), signed(x[head]), signed(y[head])]
                yield pa.RecordBatch.from_arrays([*[s.rows.column(c).take(pa.array(row)) for c in ("rid", "doc_id")], *[pa.array(c) for c in cols]], ["rid", "doc_id", "start", "size", "reps", "step", "h", "x", "y"])

    return docs.select("rid", "doc_id", "text", "hs").mapInArrow(lean(run), "rid long, doc_id long, start long, size int, reps int, step int, h long, x long, y long")


def _with_bytes(rows: DataFrame) -> DataFrame:
    """(h, n, x, y, doc_id, start, bytes) of the segments listed beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, limit=500_000):
                lists = s.rows.column("segments")
                row = np.repeat(np.arange(s.n), lists.value_lengths().to_numpy(zero_copy_only=False))
                part = lists.flatten()
                start, size = (part.field(c).to_numpy(zero_copy_only=False) for c in ("start", "size"))
                lo = s.off[row] + start
                data = [s.data[x:y].tobytes() for x, y in zip(lo, lo + size)]
                yield pa.RecordBatch.from_arrays([*[part.field(c) for c in ("h", "n", "x", "y", "doc_id", "start")], pa.array(data, pa.binary())], ["h", "n", "x", "y", "doc_id", "start", "bytes"])

    return rows.mapInArrow(lean(run), "h long, n long, x long, y long, doc_id long, start long, bytes binary")


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of segments one after the other, their offsets, and where each one's anchor lies."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    gram = rolling(byte_symbols(raw), GRAM)
    return raw, off, leftmost(gram[off[:-1, None] + np.arange(WINDOW - GRAM + 1)])


_MARKS = "x long, y long, offs array<int>"
_PIECE = "h long, u long, w long, x long, y long, doc_id long, start long, shift int, bytes binary"


def _indexed(segments: DataFrame) -> DataFrame:
    """(x, y, offsets of windows that start earlier too) of segments, or of pieces ``shift`` bytes into them."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        texts = [row[-1] for row in held]
        docs, starts, shifts = (np.array([row[k] for row in held], np.int64) for k in (2, 3, 4))
        sort = np.lexsort((starts + _joined(texts)[2], docs))  # equal windows are in the order of their anchors
        held, docs, starts, shifts = [held[i] for i in sort], docs[sort], starts[sort], shifts[sort]
        xs, ys, *_, texts = zip(*held)
        text, off = RunLengthIndex(list(texts)).repeated(docs, starts)
        order = np.lexsort((off, text))
        text, off = text[order], off[order] + shifts[text[order]]
        own, begin = np.unique(text, return_index=True)
        lists = np.split(off.astype(np.int32), begin[1:]) if len(own) else []
        return pa.RecordBatch.from_arrays([*[pa.array([ids[i] for i in own], pa.int64()) for ids in (xs, ys)], pa.array(lists, pa.list_(pa.int32()))], ["x", "y", "offs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for h, *row in zip(*[batch.column(c).to_pylist() for c in ("h", "x", "y", "doc_id", "start", "shift", "bytes")]):
                if h != last and size > CHUNK:
                    yield flush(held)
                    held, size = [], 0
                last = h
                held.append(row)
                size += len(row[-1])
        if held:
            yield flush(held)

    return segments.repartition("h").sortWithinPartitions("h").select("h", "x", "y", "doc_id", "start", "shift", "bytes").mapInArrow(lean(run), _MARKS)


def _pieces(segments: DataFrame, width: int) -> DataFrame:
    """Segments (or pieces) cut where the anchor's offset in the window enters another bin of ``width``
    offsets; h is the hash of the bin and of the bytes all its windows hold, u and w that of the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                raw, off, anchor = _joined(part.column("bytes").to_pylist())
                final = anchor - (np.diff(off) - WINDOW)  # and in the last
                low, number = final // width, anchor // width - final // width + 1
                row = np.repeat(np.arange(part.num_rows), number)
                bin_ = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                most, least = np.minimum(anchor[row], bin_ * width + width - 1), np.maximum(final[row], bin_ * width)
                shift = anchor[row] - most
                begin = off[row] + shift
                end = begin + most - least + WINDOW
                at = off[row] + anchor[row]
                common = span_hash(raw, at - bin_ * width, at + WINDOW - bin_ * width - width + 1)
                ids = [part.column(c).take(pa.array(row)) for c in ("x", "y", "doc_id")]
                start, shifted = (part.column(c).to_numpy()[row] + shift for c in ("start", "shift"))
                hashes = [signed(mix(common + bin_.astype(np.uint64))), *[signed(span_hash(raw, begin, end, v)) for v in range(2)]]
                cut = [raw[a:b].tobytes() for a, b in zip(begin, end)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in hashes], *ids, pa.array(start), pa.array(shifted.astype(np.int32)), pa.array(cut, pa.binary())], ["h", "u", "w", "x", "y", "doc_id", "start", "shift", "bytes"])

    return segments.select("x", "y", "doc_id", "start", "shift", "bytes").mapInArrow(lean(run), _PIECE)


def _split(segments: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """Marks of the segments of hot anchors, and the tables they are read from."""
    marks, tables = None, []
    for width in BINS:
        if segments.isEmpty():
            break
        pieces = stored(_pieces(segments, width), f"pieces-{width}")
        first = stored(pieces.groupBy("h", "u", "w").agg(F.min(F.struct("doc_id", "start")).alias("first")), f"first-{width}")
        shared = first.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
        here = F.struct("doc_id", "start")
        late = pieces.withColumn("offs", F.sequence("shift", F.col("shift") + F.length("bytes") - WINDOW)).drop("bytes")
        late = late.join(first, ["h", "u", "w"]).filter(here > F.col("first")).select("x", "y", "offs")
        marks = late if marks is None else marks.unionByName(late)
        tables += [pieces, first]
        if width == BINS[-1]:
            break
        left = stored(pieces.join(shared, "h").join(first, ["h", "u", "w"]).filter(here == F.col("first")).drop("first"), f"left-{width}")
        marks = marks.unionByName(_indexed(left.filter(F.col("n") <= HOT)))
        tables.append(left)
        segments = left.filter(F.col("n") > HOT)
    return None if marks is None else marks.groupBy("x", "y").agg(F.flatten(F.collect_list("offs")).alias("offs")), tables


def _cut(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch):
                lists = s.rows.column("spans")
                at = np.repeat(s.off[:-1], lists.value_lengths().to_numpy(zero_copy_only=False))
                part = lists.flatten()
                gone = np.zeros(len(s.data) + 1, np.int64)
                np.add.at(gone, at + part.field("lo").to_numpy(zero_copy_only=False), 1)
                np.add.at(gone, at + part.field("hi").to_numpy(zero_copy_only=False), -1)
                out = np.cumsum(gone)[:-1] > 0
                begins = out.copy()  # of a removed run: the byte before is kept, or in another text
                begins[1:] &= ~out[:-1]
                heads = s.off[:-1][np.diff(s.off) > 0]
                begins[heads] = out[heads]
                cut = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[s.off])
                shas = [hashlib.sha256(s.data[a:b][~out[a:b]].tobytes()).hexdigest() for a, b in zip(s.off, s.off[1:])]
                yield pa.RecordBatch.from_arrays([s.rows.column("rid"), pa.array(cut(out), pa.int64()), pa.array(cut(begins), pa.int64()), pa.array(shas)], ["rid", "n_removed", "n_spans", "sha"])

    return rows.mapInArrow(lean(run), "rid long, n_removed long, n_spans long, sha string")


def report(docs: DataFrame) -> DataFrame:
    docs = keyed(docs)
    profile = stored(profiles(docs), "profiles")
    first = profile.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    whole = F.coalesce((F.col("n_bytes") >= WINDOW) & (F.col("first") < F.col("doc_id")), F.lit(False))
    everything = stored(profile.drop("anchors").join(first, "digest", "left").withColumn("whole", whole).drop("first"), "everything")
    gone = everything.filter("whole").select("rid").distinct()
    entries = profile.filter(F.col("doc_id").isNotNull()).select("rid", "anchors").join(gone, "rid", "left_anti").select("rid", F.explode("anchors").alias("h"))
    wanted = entries.join(recurring(entries, across=False), "h").groupBy("rid").agg(F.collect_set("h").alias("hs"))
    wanted = stored(wanted, "wanted")
    discard(profile)
    subject = stored(possible(docs, wanted.select("rid"), "rid").join(wanted, "rid").dropDuplicates(["rid"]), "subjects")
    discard(wanted)
    segments = stored(_segments(subject), "segments")
    distinct = segments.groupBy("x", "y").agg(F.first("h").alias("h"), F.sum("reps").alias("times"), F.min(F.struct("doc_id", "start", "rid", "size")).alias("at"))
    distinct = stored(distinct, "distinct")
    variants = distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    listed = distinct.join(variants, "h").groupBy("at.rid").agg(F.collect_list(F.struct("h", "n", "x", "y", "at.doc_id", "at.start", "at.size")).alias("segments"))
    texts = subject.select("rid", "text")
    bytes_ = stored(_with_bytes(texts.join(listed, "rid")).withColumn("shift", F.lit(0)), "bytes")
    hot, tables = _split(bytes_.filter(F.col("n") > HOT))
    cold = _indexed(bytes_.filter(F.col("n") <= HOT))
    marks = stored(cold if hot is None else cold.unionByName(hot), "marks")
    discard(bytes_, *tables)
    origin = distinct.select("x", "y", "times", "at").join(marks, ["x", "y"], "left").filter("times > 1 or offs is not null").drop("times")
    placed = segments.select("rid", "doc_id", "start", "size", "reps", "step", "x", "y").join(origin, ["x", "y"])
    is_first = (F.col("doc_id") == F.col("at.doc_id")) & (F.col("start") == F.col("at.start"))
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    end = F.col("start") + F.col("size") + (F.col("reps") - 1) * F.col("step")
    own = F.transform(F.coalesce("offs", F.array().cast("array<int>")), lambda o: span(F.col("start") + o, F.col("start") + o + WINDOW))
    again = F.filter(F.array(span(F.col("start") + F.col("step"), end)), lambda _: F.col("reps") > 1)
    spans = placed.withColumn("spans", F.when(is_first, F.concat(own, again)).otherwise(F.array(span(F.col("start"), end)))).filter(F.size("spans") > 0)
    found = stored(spans.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "found")
    discard(distinct, segments, marks)
    cut = stored(_cut(possible(texts, found.select("rid"), "rid").join(found, "rid")), "cut")
    discard(subject, found)
    out = everything.join(cut, "rid", "left")
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(F.col("whole"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
