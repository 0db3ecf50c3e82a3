"""Benchmark decontamination by a distributed positional inverted index.

The index is stored in the shared folder, partitioned by document: a shard of about ``SHARD_BYTES`` of
text is one row with its documents, its distinct terms (hash and spelling) and, for every term, the
ascending positions at which it occurs.  Documents are separated by a gap wider than any window or
slop, so a match never crosses documents.  A phrase is answered by taking the posting list of its
rarest term, shifting it by the term's offset, and intersecting with the shifted lists of the other
terms from rare to frequent; a proximity query takes the same route with a slop.  A query term meets a
shard's list only if the spellings agree, so hashes never make a match.

The benchmark is the stated query set: its windows are broadcast in blocks of at most
``BLOCK_WINDOWS``, made one after the other, and every shard answers one block after the other.
Nothing is shuffled, and every row comes back once whatever its doc_id.  ``clean`` filters documents as
they are read, with an index of the slice in memory.

Edge cases: null or empty text has no words and is returned with zero counts; an item without words
has no window; an item shorter than the window is one window of all its words; rows that share an
item_id are one item, and a null item_id counts as the empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Slice, Words, lean, signed, slices, stored

WINDOW = 10
SLOP = 20
BLOCK_WINDOWS = 200_000
SHARD_BYTES = 2_000_000

SEPARATORS = np.zeros(256, bool)
SEPARATORS[0x00:0x30] = SEPARATORS[0x3A:0x41] = SEPARATORS[0x5B:0x61] = SEPARATORS[0x7B:0x80] = True

_HITS = "array<struct<lo:int,hi:int>>"
_SCHEMA = f"doc_id long, n_words long, hits {_HITS}, items array<string>, near_items array<string>"


def windows_of(texts: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple[str, list[bytes]]]:
    """(item, words) of every window of every item; words are lower-cased bytes."""
    out = []
    for item, text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        w = Words(Slice(None, raw, np.array([0, len(raw)])), SEPARATORS, fold=True)
        words = [w.bytes[a:b].tobytes() for a, b in zip(w.start, w.end)]
        if words:
            size = min(window, len(words))
            out += [(item, words[i : i + size]) for i in range(len(words) - size + 1)]
    return out


@dataclass
class Phrases:
    """The query side: distinct windows with their terms, and the items each window belongs to."""

    vocab: np.ndarray  # sorted term hashes
    spelling: list[bytes]
    terms: np.ndarray  # windows x WINDOW term numbers, -1 beyond the window's length
    size: np.ndarray
    items: list[list[str]]

    @classmethod
    def build(cls, windows: list[tuple[str, list[bytes]]], width: int = WINDOW) -> Phrases:
        owner: dict[tuple[bytes, ...], set[str]] = {}
        for item, words in windows:
            owner.setdefault(tuple(words), set()).add(item)
        spelling = sorted({w for words in owner for w in words})
        text = np.frombuffer(b" ".join(spelling), np.uint8)
        w = Words(Slice(None, text, np.array([0, len(text)])), SEPARATORS)
        order = np.argsort(w.hash, kind="stable")
        number = {spelling[j]: i for i, j in enumerate(order)}
        terms = np.full((len(owner), width), -1, np.int64)
        for i, words in enumerate(owner):
            terms[i, : len(words)] = [number[x] for x in words]
        return cls(w.hash[order], [spelling[j] for j in order], terms, (terms >= 0).sum(1), [sorted(x) for x in owner.values()])


class PositionalIndex:
    """Posting lists of one shard: for each query term the ascending positions in the token stream."""

    def __init__(self, positions: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.positions, self.begin, self.end, self.df = positions, begin, end, end - begin

    def list(self, term: int) -> np.ndarray:
        return self.positions[self.begin[term] : self.end[term]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Start positions of an exact phrase."""
        rare = np.argsort(self.df[terms], kind="stable")
        at = self.list(terms[rare[0]]) - rare[0]
        for j in rare[1:]:
            if not len(at):
                break
            there = self.list(terms[j])
            k = np.searchsorted(there, at + j)
            k[k == len(there)] = len(there) - 1
            at = at[there[k] == at + j] if len(there) else at[:0]
        return at

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most ``slop`` positions away."""
        terms = np.unique(terms)
        rare = np.argsort(self.df[terms], kind="stable")
        at = self.list(terms[rare[0]])
        for j in rare[1:]:
            if not len(at):
                break
            there = self.list(terms[j])
            at = at[np.searchsorted(there, at + slop, "right") > np.searchsorted(there, at - slop)]
        return at


_GAP = max(WINDOW, SLOP) + 1


def _postings(words: Words) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(term hashes ascending, their spellings, list bounds, positions) of a slice."""
    terms, first, own = np.unique(words.hash, return_index=True, return_inverse=True)
    order = np.argsort(own, kind="stable")
    position = (np.arange(len(words.hash)) + words.row * _GAP)[order]
    bounds = np.searchsorted(own[order], np.arange(len(terms) + 1))
    return terms, [words.bytes[a:b].tobytes() for a, b in zip(words.start[first], words.end[first])], bounds, position


def build(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id long, text): one row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, limit=SHARD_BYTES):
                w = Words(s, SEPARATORS, fold=True)
                terms, spelled, bounds, position = _postings(w)
                one = lambda x, t: pa.array([x], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [one(s.column("doc_id"), pa.int64()), one(w.count, pa.int32()), one(signed(terms), pa.int64()), pa.array([b" ".join(spelled)], pa.binary()), one(bounds.astype(np.int32), pa.int32()), one(position.astype(np.int32), pa.int32())],
                    ["doc_ids", "counts", "terms", "spelled", "bounds", "positions"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_ids array<long>, counts array<int>, terms array<long>, spelled binary, bounds array<int>, positions array<int>")


def _lists(terms: np.ndarray, spelled: list[bytes], bounds: np.ndarray, positions: np.ndarray, q: Phrases) -> PositionalIndex:
    """The shard's lists of the query's terms; empty for terms it lacks or spells otherwise."""
    k = np.searchsorted(terms, q.vocab)
    k[k == len(terms)] = 0
    known = terms[k] == q.vocab if len(terms) else np.zeros(len(q.vocab), bool)
    for i in np.flatnonzero(known):
        known[i] = spelled[k[i]] == q.spelling[i]
    begin = np.where(known, bounds[k] if len(terms) else 0, 0)
    return PositionalIndex(positions, begin, np.where(known, bounds[np.minimum(k + 1, len(bounds) - 1)], begin))


def _search(index: PositionalIndex, count: np.ndarray, q: Phrases, slop: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(window, its length, rows and first words of its exact matches, rows of its proximity matches)."""
    first = np.cumsum(count) - count + np.arange(len(count)) * _GAP
    here = index.df > 0
    alive = np.flatnonzero(np.where(q.terms >= 0, here[np.maximum(q.terms, 0)], True).all(1)) if len(q.terms) else []
    for i in alive:
        terms = q.terms[i, : q.size[i]]
        at = index.phrase(terms)
        row = np.searchsorted(first, at, "right") - 1
        near = np.zeros(0, np.int64) if slop is None else np.unique(np.searchsorted(first, index.near(terms, slop), "right") - 1)
        if len(at) or len(near):
            yield int(i), len(terms), row, at - first[row], near


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int) -> list[Broadcast]:
    """The windows of the benchmark, broadcast block by block as its rows arrive."""
    spark, out, held = docs.sparkSession, [], []
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        held += windows_of([(r[0], r[1])], window)
        while len(held) >= BLOCK_WINDOWS:
            out.append(spark.sparkContext.broadcast(Phrases.build(held[:BLOCK_WINDOWS], window)))
            held = held[BLOCK_WINDOWS:]
    if held:
        out.append(spark.sparkContext.broadcast(Phrases.build(held, window)))
    return out


def _each(blocks: list[Broadcast]) -> Iterator[Phrases]:
    for b in blocks:
        yield b.value
        if len(blocks) > 1:  # a worker holds one block at a time
            b.__dict__.pop("_value", None)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, hits (word ranges of every occurring window), items (their item_ids), and
    near_items: the items of which all words of a window occur within ``slop`` words of its rarest one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(docs, benchmark, window)
    if slop >= _GAP or window >= _GAP:
        raise ValueError("window and slop must be below the gap between documents")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                value = lambda c: batch.column(c).slice(r, 1).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                count, ids = value("counts"), batch.column("doc_ids").slice(r, 1).flatten()
                terms, bounds, positions = value("terms").view(np.uint64), value("bounds"), value("positions").astype(np.int64)
                spelled = batch.column("spelled")[r].as_py().split(b" ") if len(terms) else []
                hits, items, near = ([set() for _ in range(len(count))] for _ in range(3))
                for q in _each(blocks):
                    for i, n, row, lo, close in _search(_lists(terms, spelled, bounds, positions, q), count, q, slop):
                        for d, x in zip(row.tolist(), lo.tolist()):
                            hits[d].add((x, x + n))
                            items[d].update(q.items[i])
                        for d in close.tolist():
                            near[d].update(q.items[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(count, pa.int64()),
                        pa.array([[{"lo": a, "hi": b} for a, b in sorted(h)] for h in hits], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                        *[pa.array([sorted(x) for x in found], pa.list_(pa.string())) for found in (items, near)],
                    ],
                    ["doc_id", "n_words", "hits", "items", "near_items"],
                )

    return stored(build(rows), "postings").mapInArrow(lean(search), _SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any occurrence, all columns as they are; nothing is shuffled."""
    blocks = _blocks(docs, benchmark, window)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, limit=SHARD_BYTES // 4):
                w = Words(s, SEPARATORS, fold=True)
                parts, hit = _postings(w), np.zeros(s.n, bool)
                for q in _each(blocks):
                    for _, _, row, _, _ in _search(_lists(*parts, q), w.count, q, None):
                        hit[row] = True
                yield s.rows.filter(pa.array(~hit))

    return docs.mapInArrow(lean(keep), docs.schema) if blocks else docs


def n_covered(hits: str = "hits") -> F.Column:
    """Number of words in the union of the half-open ranges."""
    step = lambda acc, h: F.struct((acc["n"] + F.greatest(h["hi"] - F.greatest(acc["end"], h["lo"]), F.lit(0))).alias("n"), F.greatest(acc["end"], h["hi"]).alias("end"))
    return F.aggregate(F.array_sort(hits), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"].cast("long"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest per document: words, hit words, items, and the hash of the item list."""
    found = occurrences(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        n_covered().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )
