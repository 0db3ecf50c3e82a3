"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds the words (sorted 64-bit hashes) with their counts; level n holds, for every
n-gram, its last word below the node of its first n-1 words.  A level is cut into shards: level 1 by
ranges of the hash, the others by a hash of the context, with one shard for every ``SHARD_TOKENS``
training tokens.  A context of more than ``HOT`` tokens is spread over all shards by its words, so no
shard grows with one context.  A shard is one flat file of Elias-Fano sequences (contexts, monotone
pointers to their children, children relative to their context) and one-byte codes of quantised
probabilities and left-over masses.  Files are written to the shared folder and memory-mapped by the
scoring tasks; an n-gram is found by successor search within the range of its context.

Counting moves blocks, not rows: a task adds up its n-grams and sends every shard one sorted,
delta-coded block of them, which the shard's task merges.  A second pass over the shards, which moves
nothing, quantises once the discount of the level is known.

Smoothing is interpolated absolute discounting: p(w|c) = d(c,w) + b(c) p(w|shorter c), with
d = (count - D) / count(c) for every n-gram seen, D = n1 / (n1 + 2 n2) of the level's n-grams seen once
and twice (``DISCOUNT`` where one of them is 0), b(c) the mass left over, and add-one unigrams with one
unseen type.  d and b are rounded down to 256 levels a shard, so probabilities never sum to more than 1.

Every document ends in one end token, which is also the context of its first word; so every
occurrence of a context is followed by a token, and its count is the sum of its children's.  Edge
cases: null and empty texts are one end token; with no training document every count is 0 and
p = 1/(N+V+1) = 1; repeated rows are scored, and counted, each.  (Node, word) keys have 63 bits: up to
3e9 types, or 9e18 divided by the types n-grams.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Slice, Words, bucket_of, discard, lean, mix, remove, schema_with, shared_dir, signed, slices, stored

ORDER = 3
DISCOUNT = 0.6
SHARD_ROWS = 1_000_000
SHARD_TOKENS = 4_000_000
HOT = 500_000
SLICE = 2_000_000
REMOTE_BYTES = 256_000_000
END = U64(0x0123456789ABCDEF)
ONE = U64(1)
_B01, _B80 = U64(0x0101010101010101), U64(0x8080808080808080)
_B55, _B33, _B0F = U64(0x5555555555555555), U64(0x3333333333333333), U64(0x0F0F0F0F0F0F0F0F)


_NTH = np.zeros((256, 8), np.int64)  # place of the n-th set bit of a byte
for _b in range(256):
    for _n, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _NTH[_b, _n] = _p


class EliasFano:
    """A sorted uint64 sequence: low bits packed, high bits in unary, with rank directories of both bits."""

    def __init__(self, n: int, low: int, lows: np.ndarray, high: np.ndarray, ranks: np.ndarray, zeros: np.ndarray):
        self.n, self.low, self.lows, self.high, self.ranks, self.zeros = n, low, lows, high, ranks, zeros

    @classmethod
    def pack(cls, values: np.ndarray, universe: int) -> tuple[dict, list[np.ndarray]]:
        n = len(values)
        low = max(0, (universe // max(n, 1)).bit_length() - 1)
        packed = np.zeros(n * low // 64 + 2, np.uint64)
        if low:
            bit = np.arange(n, dtype=np.uint64) * U64(low)
            word, shift = (bit >> U64(6)).astype(np.int64), bit & U64(63)
            part = values & U64((1 << low) - 1)
            np.bitwise_or.at(packed, word, part << shift)
            over = np.where(shift > 0, part >> (U64(64) - np.maximum(shift, ONE)), U64(0))
            np.bitwise_or.at(packed, word + 1, over)
        at = (values >> U64(low)).astype(np.int64) + np.arange(n) if low < 64 else np.arange(n)
        size = (n + (universe >> low) + 2) // 64 + 2
        high = np.zeros(size, np.uint64)
        np.bitwise_or.at(high, at >> 6, ONE << (at & 63).astype(np.uint64))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.int64)
        return {"n": n, "low": low}, [packed, high, ranks, np.arange(len(ranks)) * 64 - ranks]

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero bit: directory, then byte sums within the word."""
        directory = self.ranks if ones else self.zeros
        w = np.searchsorted(directory, k, "right") - 1
        left = (k - directory[w]).astype(np.uint64)
        word = self.high[w] if ones else ~self.high[w]
        s = word - ((word >> ONE) & _B55)
        s = (s & _B33) + ((s >> U64(2)) & _B33)
        s = ((s + (s >> U64(4))) & _B0F) * _B01  # byte i: ones up to and with byte i
        octet = np.bitwise_count(((left * _B01 | _B80) - s) & _B80).astype(np.uint64) * U64(8)
        before = np.where(octet > 0, (s >> (np.maximum(octet, U64(8)) - U64(8))) & U64(255), U64(0))
        return w * 64 + octet.astype(np.int64) + _NTH[((word >> octet) & U64(255)).astype(np.int64), (left - before).astype(np.int64)]

    def _from(self, at: np.ndarray) -> np.ndarray:
        """The 64 high bits from each position on."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        return (self.high[word] >> shift) | np.where(shift > 0, self.high[word + 1] << (U64(64) - np.maximum(shift, ONE)), U64(0))

    def lows_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * U64(self.low)
        word, shift = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        value = self.lows[word] >> shift
        value |= np.where(shift > 0, self.lows[word + 1] << (U64(64) - np.maximum(shift, ONE)), U64(0))
        return value & U64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i).astype(np.uint64) << U64(self.low)) | self.lows_at(i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values i and i+1: the next one bit is mostly within the 64 bits after the first."""
        at = self._select(i, True)
        bits = self._from(at + 1)
        then = at + 1 + np.bitwise_count(~bits & (bits - ONE)).astype(np.int64)
        far = np.flatnonzero(bits == 0)
        then[far] = self._select(i[far] + 1, True)
        join = lambda p, k: ((p - k).astype(np.uint64) << U64(self.low)) | self.lows_at(k)
        return join(at, i), join(then, i + 1)

    def _range(self, x: np.ndarray, lo, hi) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First index >= x among those that share its high bits and lie in [lo, hi); the range's end."""
        h = (x >> U64(self.low)).astype(np.int64)
        first = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        bits = self._from(first + h)
        size = np.bitwise_count(bits & ~(bits + ONE)).astype(np.int64)
        full = np.flatnonzero(size == 64)
        size[full] = self._select(h[full], False) - h[full] - first[full]
        a, b = np.maximum(first, lo), np.minimum(first + size, self.n if hi is None else hi)
        a = np.minimum(a, b)
        end, want = b.copy(), x & U64((1 << self.low) - 1)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) // 2
            less = self.lows_at(mid) < want[open_]
            a[open_[less]], b[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[a[open_] < b[open_]]
        return a, end, want

    def successor(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None) -> np.ndarray:
        """Index of the first value >= x, searched within [lo, hi)."""
        return self._range(x, lo, hi)[0]

    def find(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None) -> np.ndarray:
        """Index of x within [lo, hi), or -1."""
        if not self.n:
            return np.full(len(x), -1)
        out = np.full(len(x), -1)
        at, end, want = self._range(x, lo, hi)
        there = np.flatnonzero(at < end)
        there = there[self.lows_at(at[there]) == want[there]]
        out[there] = at[there]
        return out


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-byte codes and a codebook of 256 levels: the values themselves where they are few, else
    geometric steps from the least to the largest.  Every value is rounded down."""
    book = np.unique(values)
    if len(book) > 256:
        book = np.geomspace(book[0], book[-1], 256)
        book[0] = values.min()
    code = np.maximum(np.searchsorted(book, values, "right") - 1, 0)
    return code.astype(np.uint8), book.astype(np.float64)


def _open(uri: str, path: str):
    fs, root = pafs.FileSystem.from_uri(uri)
    return fs, f"{root.rstrip('/')}/{path}"


def save(uri: str, path: str, arrays: dict[str, np.ndarray], meta: dict) -> None:
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (str(a.dtype), len(a), at)
        at += (a.nbytes + 7) // 8 * 8
    text = json.dumps({"arrays": head, "meta": meta}).encode()
    text += b" " * (-len(text) % 8)
    fs, name = _open(uri, path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name) as f:
        f.write(np.array([len(text)], np.int64).tobytes() + text)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def load(uri: str, path: str) -> tuple[dict[str, np.ndarray], dict]:
    fs, name = _open(uri, path)
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(name, np.uint8, "r")
    else:
        with fs.open_input_file(name) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int(raw[:8].view(np.int64)[0])
    head = json.loads(raw[8 : 8 + size].tobytes())
    base = 8 + size
    out = {k: raw[base + at : base + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in head["arrays"].items()}
    return {k: np.asarray(v) for k, v in out.items()}, head["meta"]


def _with(arrays: dict, meta: dict, name: str, values: np.ndarray, universe: int) -> None:
    own, parts = EliasFano.pack(values, universe)
    meta[name] = own
    for k, p in zip(("lows", "high", "ranks", "zeros"), parts):
        arrays[f"{name}.{k}"] = p


def _sequence(arrays: dict, meta: dict, name: str) -> EliasFano:
    return EliasFano(meta[name]["n"], meta[name]["low"], *[arrays[f"{name}.{k}"] for k in ("lows", "high", "ranks", "zeros")])


def packed_counts(count: np.ndarray) -> dict[str, np.ndarray]:
    """Exact counts in a byte each; the few from 255 on are listed beside."""
    over = np.flatnonzero(count >= 255)
    return {"count": np.minimum(count, 255).astype(np.uint8), "over": over, "many": count[over].astype(np.int64)}


def counts_at(arrays: dict[str, np.ndarray], i: np.ndarray) -> np.ndarray:
    out = arrays["count"][i].astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = arrays["many"][np.searchsorted(arrays["over"], i[big])]
    return out


class Shard:
    """One memory-mapped file of a level."""

    def __init__(self, uri: str, path: str):
        self.arrays, m = load(uri, path)
        self.keys = _sequence(self.arrays, m, "keys")
        self.v, self.size = m.get("v", 0), sum(a.nbytes for a in self.arrays.values())
        if self.v:
            self.contexts, self.pointers = _sequence(self.arrays, m, "contexts"), _sequence(self.arrays, m, "pointers")

    def children(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, context number) of each (context, word), -1 where absent; contexts ascend, so each
        distinct one is looked up once."""
        head = np.concatenate([[True], context[1:] != context[:-1]])
        run = np.cumsum(head) - 1
        own = self.contexts.find(context[head].astype(np.uint64))
        lo = np.zeros(len(own), np.int64)
        hi = np.zeros(len(own), np.int64)
        there = np.flatnonzero(own >= 0)
        a, b = self.pointers.pair(own[there])
        lo[there], hi[there] = a.astype(np.int64), b.astype(np.int64)
        c, node = own[run], np.full(len(context), -1)
        at = np.flatnonzero(c >= 0)
        if len(at):
            node[at] = self.keys.find(c[at].astype(np.uint64) * U64(self.v) + word[at].astype(np.uint64), lo[run[at]], hi[run[at]])
        return node, c


def shard_of(context: np.ndarray, word: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each n-gram: by its context, of the ``hot`` contexts also by its word."""
    key = mix(context.astype(np.uint64))
    if len(hot):
        spread = hot[np.minimum(np.searchsorted(hot, context), len(hot) - 1)] == context
        key = np.where(spread, mix(key + word.astype(np.uint64) + ONE), key)
    return (key % U64(shards)).astype(np.int64)


def by_number(which: np.ndarray, n: int) -> np.ndarray:
    """Stable order of numbers below n; those of 16 bits are sorted by radix."""
    return np.argsort(which.astype(np.uint16) if n <= 1 << 16 else which, kind="stable")


@dataclass
class Level:
    """Addresses of a level: one path a shard ("" where empty) and the number of its first node."""

    uri: str
    paths: list[str]
    base: np.ndarray
    hot: np.ndarray  # contexts spread over the shards (level 1: none), with what they leave over
    hot_left: np.ndarray
    _open: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def shard(self, i: int) -> Shard:
        """Mapped files stay open; where a store cannot be mapped, up to REMOTE_BYTES are kept."""
        if i not in self._open:
            new = Shard(self.uri, self.paths[i])
            if not self.uri.startswith("file:") and sum(x.size for x in self._open.values()) + new.size > REMOTE_BYTES:
                self._open.clear()
            self._open[i] = new
        return self._open[i]

    def _grouped(self, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = by_number(which, len(self.paths))
        cut = np.flatnonzero(np.diff(which[order])) + 1
        for part in np.split(order, cut) if len(order) else []:
            if self.paths[which[part[0]]]:
                yield int(which[part[0]]), part

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (-1: unknown) and counts of hashes."""
        ids, count = np.full(len(h), -1), np.zeros(len(h), np.int64)
        width = U64((1 << 64) // len(self.paths) + 1) if len(self.paths) > 1 else None
        for s, part in self._grouped((h // width).astype(np.int64) if width else np.zeros(len(h), np.int64)):
            sh = self.shard(s)
            i = sh.keys.find(h[part])
            ok = i >= 0
            ids[part[ok]] = i[ok] + self.base[s]
            count[part[ok]] = counts_at(sh.arrays, i[ok])
        return ids, count

    def find(self, context: np.ndarray, word: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node or -1, discounted probability, left-over mass of the context).

        Repeated pairs are looked up once and in ascending order, which keeps the searches local.
        """
        pairs, back = np.unique(context * v + word, return_inverse=True)
        node, d, left = np.full(len(pairs), -1), np.zeros(len(pairs)), np.ones(len(pairs))
        if self.paths:
            context = pairs // v
            word = pairs - context * v
            for s, part in self._grouped(shard_of(context, word, self.hot, len(self.paths))):
                sh = self.shard(s)
                i, c = sh.children(context[part], word[part])
                ok, known = i >= 0, c >= 0
                node[part[ok]] = i[ok] + self.base[s]
                d[part[ok]] = sh.arrays["book"][sh.arrays["code"][i[ok]]]
                left[part[known]] = sh.arrays["left_book"][sh.arrays["left"][c[known]]]
            if len(self.hot):
                k = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
                hit = self.hot[k] == context
                left[hit] = self.hot_left[k[hit]]
        return node[back], d[back], left[back]


@dataclass
class Model:
    total: int
    types: int
    levels: list[Level]

    def tokens(self, w: Words, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes with the end tokens in place, and the n+1 row boundaries."""
        first = w.first + np.arange(len(w.first))
        h = np.empty(first[-1], np.uint64)
        h[np.arange(len(w.hash)) + w.row] = w.hash
        h[first[1:] - 1] = END
        return h, first

    def nodes(self, h: np.ndarray, first: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For levels 2 .. depth: (node, d, left) of the n-gram that ends at each token.

        A row begins with one end token as context and no further back: rows never meet.
        """
        ids = self.ids
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        end = self.end
        before = np.empty(len(h), np.int64)
        before[1:] = ids[:-1]
        before[place == 0] = end
        for n in range(2, depth + 1):
            here, d, left = np.full(len(h), -1), np.zeros(len(h)), np.ones(len(h))
            at = np.flatnonzero((before >= 0) & (place >= n - 2))
            known = ids[at] >= 0  # an unknown word has no node, but its context leaves mass over
            node, p, left[at] = self.levels[n - 1].find(before[at], np.maximum(ids[at], 0), self.types)
            here[at[known]], d[at[known]] = node[known], p[known]
            yield here, d, left
            before = np.concatenate([[-1], here[:-1]]) if len(here) else here
            before[place == 0] = -1

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Sets the ids of the tokens; returns their counts."""
        distinct, back = np.unique(h, return_inverse=True)
        ids, count = self.levels[0].words(distinct)
        self.ids = ids[back]
        e = np.searchsorted(distinct, END)
        self.end = int(ids[e]) if e < len(distinct) and distinct[e] == END else -1
        return count[back]


def squeezed(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, without the planes that are all zero."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    used = int(np.flatnonzero(planes.any(1)).max(initial=0)) + 1
    return bytes([used]) + planes[:used].tobytes()


def opened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view(np.int64)


class _Tally:
    """Counts of keys, merged whenever the pending keys outgrow ``limit``."""

    def __init__(self, limit: int = 2_000_000):
        self.keys, self.counts, self.pending, self.limit = [], [], 0, limit

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> bool:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.pending += len(keys)
        return self.pending > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pending:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k, c = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts, self.pending = [], [], 0
        order = np.argsort(k, kind="stable")  # merges the sorted runs
        k, c = k[order], c[order]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[head], np.add.reduceat(c, head)


def _words(training: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, m = _Tally(), Model(0, 0, [])
        for batch in batches:
            for s in slices(batch, limit=SLICE):
                if tally.add(m.tokens(Words(s, fold=True), s)[0]):
                    k, c = tally.take()
                    yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(c)], ["h", "n"])
        k, c = tally.take()
        yield pa.RecordBatch.from_arrays([pa.array(signed(k.astype(np.uint64))), pa.array(c)], ["h", "n"])

    return training.select("text").mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


_MADE = "shard long, path string, rows long, once long, twice long, big array<long>, counts array<long>"


def _made(shard: int, path: str, count: np.ndarray, limit: int) -> pa.RecordBatch:
    """What the driver learns of a shard: its size, counts of counts, and the nodes beyond ``limit`` tokens."""
    big = np.flatnonzero(count > limit)
    lists = [pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in (big, count[big])]
    return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([path]), pa.array([len(count)]), pa.array([int((count == 1).sum())]), pa.array([int((count == 2).sum())]), *lists], ["shard", "path", "rows", "once", "twice", "big", "counts"])


@dataclass
class _Parts:
    """The shards of a level as they were made."""

    paths: list[str]
    base: np.ndarray
    discount: float
    hot: np.ndarray
    hot_count: np.ndarray

    @classmethod
    def of(cls, made: DataFrame, shards: int) -> _Parts:
        rows = {r["shard"]: r for r in made.collect()}
        sizes = [rows[i]["rows"] if i in rows else 0 for i in range(shards)]
        base = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        once, twice = (sum(r[c] for r in rows.values()) for c in ("once", "twice"))
        big = sorted((int(base[i]) + k, n) for i, r in rows.items() for k, n in zip(r["big"], r["counts"]))
        return cls([rows[i]["path"] if i in rows else "" for i in range(shards)], base, once / (once + 2 * twice) if once and twice else DISCOUNT, np.array([k for k, _ in big], np.int64), np.array([n for _, n in big], np.int64))


def _first_level(words: DataFrame, types: int, uri: str, name: str) -> _Parts:
    """Write the words' shards, cut by equal ranges of the hash."""
    shards = types // SHARD_ROWS + 1
    width, limit = (1 << 64) // shards + 1, HOT

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            shard = (h // U64(width)).astype(np.int32) if shards > 1 else np.zeros(len(h), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("h"), batch.column("n")], ["shard", "h", "n"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            t = pa.Table.from_batches(rows)
            h, n = t.column("h").to_numpy().view(np.uint64), t.column("n").to_numpy()
            order = np.argsort(h)
            arrays, meta, path = packed_counts(n[order]), {}, f"{name}/{uuid.uuid4().hex}"
            _with(arrays, meta, "keys", h[order], 1 << 64)
            save(uri, path, arrays, meta)
            yield _made(int(t.column("shard")[0].as_py()), path, n[order], limit)

    dealt = words.select("h", "n").mapInArrow(lean(number), "shard int, h long, n long").repartitionById(shards, F.col("shard"))
    return _Parts.of(dealt.mapInArrow(lean(write), _MADE), shards)


def _count_level(training: DataFrame, model: Model, n: int, hot: np.ndarray, uri: str, name: str) -> _Parts:
    """Count the n-grams and write their shards, with exact counts."""
    shipped = training.sparkSession.sparkContext.broadcast((model, hot))
    shards, limit = model.total // SHARD_TOKENS + 1, HOT

    def blocks(tally: _Tally, v: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = tally.take()
        where = shard_of(keys // v, keys % v, hot, shards)
        order = by_number(where, shards)
        keys, counts, where = keys[order], counts[order], where[order]
        cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
        for lo in range(0, len(cut) - 1, 256):
            ends = list(zip(cut[lo : lo + 257], cut[lo + 1 : lo + 257]))
            parts = [[squeezed(np.diff(keys[a:b], prepend=0)) for a, b in ends], [squeezed(counts[a:b]) for a, b in ends]]
            yield pa.RecordBatch.from_arrays([pa.array(where[[a for a, _ in ends]].astype(np.int32)), *[pa.array(x, pa.binary()) for x in parts]], ["shard", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (m, hot), tally = shipped.value, _Tally()
        for batch in batches:
            for s in slices(batch, limit=SLICE):
                h, first = m.tokens(Words(s, fold=True), s)
                m.look_up(h)
                place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
                if n == 2:
                    before = np.concatenate([[m.end], m.ids[:-1]])
                    before[place == 0] = m.end
                    ok = np.ones(len(h), bool)
                else:
                    *_, (node, _, _) = m.nodes(h, first, n - 1)
                    before = np.concatenate([[-1], node[:-1]])
                    ok = place >= n - 2
                if tally.add(before[ok] * m.types + m.ids[ok]):
                    yield from blocks(tally, m.types, hot)
        yield from blocks(tally, m.types, hot)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (m, _), tally, shard = shipped.value, _Tally(), None
        for batch in batches:
            for s, keys, counts in zip(*[batch.column(c).to_pylist() for c in ("shard", "keys", "counts")]):
                shard = s
                if tally.add(np.cumsum(opened(keys)), opened(counts)):
                    tally.add(*tally.take())
                    tally.limit = max(tally.limit, 2 * tally.pending)
        if shard is None:
            return
        keys, counts = tally.take()
        context = keys // m.types
        begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        own, number = context[begin], np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
        arrays, meta, path = packed_counts(counts), {"v": m.types}, f"{name}/{uuid.uuid4().hex}"
        _with(arrays, meta, "contexts", own.astype(np.uint64), int(own[-1]) + 1)
        _with(arrays, meta, "pointers", np.append(begin, len(keys)).astype(np.uint64), len(keys) + 1)
        _with(arrays, meta, "keys", (number * m.types + keys - context * m.types).astype(np.uint64), len(own) * m.types)
        save(uri, path, arrays, meta)
        yield _made(shard, path, counts, limit)

    dealt = training.select("text").mapInArrow(lean(count), "shard int, keys binary, counts binary").repartitionById(shards, F.col("shard"))
    return _Parts.of(dealt.mapInArrow(lean(merge), _MADE), shards)


def _quantise(spark: SparkSession, parts: _Parts, hot: np.ndarray, hot_count: np.ndarray, uri: str, name: str) -> Level:
    """Replace the counts of a level's shards by codes of smoothed probabilities; nothing is shuffled."""
    shipped = spark.sparkContext.broadcast((parts, hot, hot_count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, hot, hot_count = shipped.value
        for batch in batches:
            for i in batch.column("id").to_pylist():
                if not parts.paths[i]:
                    continue
                arrays, meta = load(uri, parts.paths[i])
                count = counts_at(arrays, np.arange(len(arrays["count"])))
                own = _sequence(arrays, meta, "contexts")
                context = own.get(np.arange(own.n)).astype(np.int64)
                begin = _sequence(arrays, meta, "pointers").get(np.arange(own.n)).astype(np.int64)
                total = np.add.reduceat(count, begin)
                k = np.minimum(np.searchsorted(hot, context), max(len(hot) - 1, 0))
                spread = np.flatnonzero(hot[k] == context) if len(hot) else np.zeros(0, np.int64)
                total[spread] = hot_count[k[spread]]
                d = (count - parts.discount) / np.repeat(total, np.diff(np.append(begin, len(count))))
                kept = np.add.reduceat(d, begin)
                arrays = {x: a for x, a in arrays.items() if "." in x}
                arrays["code"], arrays["book"] = quantised(d)
                arrays["left"], arrays["left_book"] = quantised(np.maximum(1 - kept, 1e-12))
                path = f"{name}/{uuid.uuid4().hex}"
                save(uri, path, arrays, meta)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([path]), pa.array([context[spread]], pa.list_(pa.int64())), pa.array([kept[spread]], pa.list_(pa.float64()))], ["shard", "path", "hot", "kept"])

    shards = len(parts.paths)
    made = spark.range(0, shards, 1, min(shards, 2048)).mapInArrow(lean(run), "shard long, path string, hot array<long>, kept array<double>").collect()
    paths, kept = [""] * shards, dict.fromkeys(hot.tolist(), 0.0)
    for r in made:
        paths[r["shard"]] = r["path"]
        for c, x in zip(r["hot"], r["kept"]):
            kept[c] += x
    return Level(uri, paths, parts.base, hot, np.array([max(1 - kept[c], 1e-12) for c in hot.tolist()]))


def fit(training: DataFrame, order: int = ORDER) -> Model:
    """Count, smooth and write the trie of the texts; the model holds only its shards' addresses."""
    spark = training.sparkSession
    uri, name = shared_dir(spark).rstrip("/"), f"trie-{uuid.uuid4().hex}"
    none = np.zeros(0, np.int64)
    words = stored(_words(training), "words")
    total, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = _first_level(words, types, uri, f"{name}/1")
    discard(words)
    model = Model(total, types, [Level(uri, parts.paths, parts.base, none, none.astype(float))])
    for n in range(2, order + 1 if types else 2):
        counted = _count_level(training, model, n, parts.hot, uri, f"{name}/{n}-counts")
        model.levels.append(_quantise(spark, counted, parts.hot, parts.hot_count, uri, f"{name}/{n}"))
        remove(spark, f"{uri}/{name}/{n}-counts")
        parts = counted
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with n_tokens, n_known, base_score (add-one unigrams) and score, in log10."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = schema_with(rows, keep, "n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for s in slices(batch, "_text", SLICE):
                h, first = m.tokens(Words(s, fold=True), s)
                count = m.look_up(h)
                base = (count + 1) / (m.total + m.types + 1)
                p = base
                for _, d, left in m.nodes(h, first, len(m.levels)):
                    p = d + left * p
                cols = [np.diff(first), np.add.reduceat(count > 0, first[:-1], dtype=np.int64), np.full(s.n, m.total), np.add.reduceat(np.log10(base), first[:-1]), np.add.reduceat(np.log10(p), first[:-1])]
                yield pa.RecordBatch.from_arrays([*[s.rows.column(c) for c in keep], *[pa.array(c) for c in cols]], schema.names)

    return rows.mapInArrow(lean(run), schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket_of(doc_id, 7) == 2, F.lit(False))


def report(docs: DataFrame, order: int = ORDER) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(rows.filter(~held_out(F.col("doc_id"))), order)
    return score(rows.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
