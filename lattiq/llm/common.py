"""Vectorised text primitives and small Spark helpers shared by the operators.

Texts are handled as Arrow string buffers: one uint8 array per slice of rows, with the rows'
offsets, so that tokenising and hashing are numpy passes rather than per-word Python.  A slice holds
at most ``SLICE_BYTES`` of text (or one document, when a single document is longer), which bounds
the memory of a Python worker whatever the Arrow batch size is.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1_000_000
U64 = np.uint64
MASK64 = (1 << 64) - 1

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SYMBOL = (_BYTE, _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1))
_BASES = tuple((b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))
_pow: dict[int, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept per process and grown when needed."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = _pow[base] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Slice:
    """Some rows of a batch: ``data`` has their UTF-8 bytes, row i is ``data[off[i]:off[i+1]]``."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray):
        self.rows, self.data, self.off, self.n = rows, data, off, len(off) - 1

    def column(self, name: str) -> list:
        return self.rows.column(name).to_pylist()

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a batch into slices of at most ``limit`` text bytes; null texts count as empty."""
    arr = batch.column(column)
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    if not len(arr):
        return
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, len(arr))
        yield Slice(batch.slice(lo, hi - lo), raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


class Words:
    """Maximal runs of bytes outside ``separators``, never across rows, with 64-bit hashes.

    ``start``/``end`` are byte offsets into the slice, ``row`` is the row of each word, ``first``
    has n+1 entries: the words of row i are ``first[i]:first[i+1]``.  Equal words have equal hashes.
    """

    def __init__(self, s: Slice, separators: np.ndarray = WHITE, fold: bool = False):
        data = LOWER[s.data] if fold else s.data
        self.bytes = data
        inside = ~separators[data]
        n = len(data)
        if n:
            before = np.empty(n, bool)
            before[0], before[1:] = False, inside[:-1]
            heads = s.off[:-1][s.off[:-1] < n]
            before[heads] = False
            self.start = np.flatnonzero(inside & ~before)
            after = np.empty(n, bool)
            after[-1], after[:-1] = False, inside[1:]
            tails = s.off[1:][s.off[1:] > 0] - 1
            after[tails] = False
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, s.off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(s.n), self.count)
        self.hash = self._hash(data)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        return span_hash(data, self.start, self.end)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, variant: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial prefix sum, shifted back to the span's start.  The
    two variants are independent of each other."""
    prefix, back = _prefix(_SYMBOL[variant][data], variant)
    return mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64))


def _prefix(symbols: np.ndarray, variant: int) -> tuple[np.ndarray, np.ndarray]:
    n, (base, inverse) = len(symbols), _BASES[variant]
    prefix = np.zeros(n + 1, np.uint64)
    if n:
        np.cumsum(symbols * powers(base, n), out=prefix[1:], dtype=np.uint64)
    return prefix, powers(inverse, n + 1)


def rolling(symbols: np.ndarray, k: int, variant: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive 64-bit symbols, for positions 0 .. len(symbols)-k."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix, back = _prefix(symbols, variant)
    return mix((prefix[k:] - prefix[:-k]) * back[:n])


def byte_symbols(data: np.ndarray, variant: int = 0) -> np.ndarray:
    return _SYMBOL[variant][data]


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes, for positions 0 .. len(h)-k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mul = U64((0xD6E8FEB86659FD93 + 2 * seed) | 1)
    out = np.full(n, U64(seed * 2 + 1), np.uint64)
    for j in range(k):
        out = out * mul + h[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w consecutive values, by doubling."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def sha(parts: bytes) -> str:
    return hashlib.sha256(parts).hexdigest()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; without one, only a local session can go on."""
    set_ = spark.conf.get("spark.checkpoint.dir", "")
    if not set_:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        set_ = "file://" + tempfile.mkdtemp(prefix="lattiq-")
        spark.conf.set("spark.checkpoint.dir", set_)
    return set_


BATCH_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches, and so the memory of both their ends, within BATCH_BYTES (or one row)."""
    if not 0 < int(spark.conf.get(_ARROW, "67108864").rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(_ARROW, str(BATCH_BYTES))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a table into the shared folder and read it back.  The shuffle files of the
    write are dropped at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def lean(run):
    """A batch function that gives free memory back to the system at the end of a task: workers are
    reused, and what an earlier step left allocated would add to the needs of the next."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)

    return wrapped


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` once everything derived from them is stored itself."""
    for table in tables:
        remove(table.sparkSession, table._stored_at)


def keyed(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text: rows that share a doc_id but not the text have different rids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bounded_sample(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each label value, chosen by a hash of doc_id (and text).

    Only one count per label value reaches the driver; small classes are kept whole.  The choice
    depends on the rows alone, so a recomputed task picks the same ones.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().toLocalIterator()}
    span = 1 << 30
    rate = F.lit(0)
    names = [c for c in ("doc_id", "text") if c in rows.columns]
    for value, n in sorted(counts.items(), key=str):
        rate = F.when(F.col(label) == F.lit(value), F.lit(span if n <= per_class else span * per_class // n)).otherwise(rate)
    return rows.filter(F.pmod(F.xxhash64(*names, F.lit(17)), F.lit(span)) < rate)


def labelled_texts(docs: DataFrame, marks: DataFrame, per_class: int) -> tuple[DataFrame, dict]:
    """(doc_id, text, label) of a bounded sample of the marks (doc_id, label), and all labels' counts.

    The sample is drawn from the marks alone, about ``per_class`` a label value, so the side that is
    broadcast has a known bound and the documents are not shuffled.
    """
    total = {r[0]: r[1] for r in marks.groupBy("label").count().toLocalIterator()}
    chosen = bounded_sample(marks.select("doc_id", "label"), "label", per_class).collect()
    small = docs.sparkSession.createDataFrame(chosen, marks.select("doc_id", "label").schema)
    return docs.join(F.broadcast(small), "doc_id").select("doc_id", "text", "label"), total


FILTER_BITS = 1 << 26


def possible(docs: DataFrame, ids: DataFrame, key: str = "doc_id", then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """Rows of docs whose ``key`` may be in ids: all that are, and few others, without moving texts.
    A batch function ``then`` with result ``schema`` goes on with them in the same worker.

    A Bloom filter of ids (about 16 bits each, at most FILTER_BITS in all, so what is broadcast is
    bounded) is or-ed together on the executors and applied where the documents are read.  More ids
    than the filter can tell apart only let more rows through; callers join exactly afterwards.  Two
    Python operators in one task would take two workers, which the executor keeps and later steps fill.
    """
    spark = docs.sparkSession
    n = ids.count()
    bits = min(FILTER_BITS, 1 << max(12, (16 * n).bit_length()))
    place = F.explode(F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.pmod(F.xxhash64(key, k), F.lit(bits)))).alias("p")
    words = ids.select(place).groupBy(F.floor(F.col("p") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("b"))
    table = np.zeros(bits // 32, np.uint32)
    got = words.toPandas() if n else None
    if got is not None:
        table[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    shipped = spark.sparkContext.broadcast(table)
    keyed = docs.select("*", F.array(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(4)]).alias("_places"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        for batch in batches:
            at = batch.column("_places").flatten().to_numpy().reshape(-1, 4)
            hit = ((t[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(1)
            yield batch.drop_columns(["_places"]).filter(pa.array(hit))

    if then is None:
        return keyed.mapInArrow(lean(chosen), docs.schema)
    return keyed.mapInArrow(lean(lambda batches: then(chosen(batches))), schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def schema_with(rows: DataFrame, keep: list[str] | tuple[str, ...], more: str) -> T.StructType:
    """The schema of ``keep`` columns of rows, followed by the columns of a DDL string."""
    return T.StructType([*rows.select(*keep).schema.fields, *T.StructType.fromDDL(more).fields])
