"""Document quality: random-indexing vectors pooled per document, then a two-layer numpy network.

Tokens are letter/digit runs, symbol runs, each with a case shape.  Every token belongs to one of
``CELLS`` cells by its hash and has a sparse random index vector (``DIM`` dimensions, two +-1
entries).  A cell's context vector is the sum of the index vectors of the tokens up to ``REACH``
places away, accumulated over all documents of the corpus: each partition adds up its own table,
and the tables are summed in two levels, so what moves is a fixed number of bytes a partition.  A
document is the mean and the spread of its tokens' unit context vectors joined with their index
vectors.  A network with one hidden layer is trained by Adam on a bounded sample (about
``PER_CLASS`` labelled rows of each class, documented parameter); on a fifth of them, kept apart,
a temperature is fitted, which calibrates the probabilities at the labelled rows' class balance.

Edge cases: texts without tokens (null and empty included) pool to the zero vector and are scored
like any other; with no labelled rows, or one class only, every score is that class's rate (0
without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Slice, Words, bucket_of, labelled_texts, lean, mix, schema_with, sigmoid, slices

CELLS, DIM, REACH = 1 << 13, 32, 2
PER_CLASS = 3000
HIDDEN, EPOCHS, BATCH, RATE = 32, 60, 128, 0.01
THRESHOLD = 0.3
PARTS = 8

_KIND = np.zeros(256, np.uint8)  # 0 white space, 1 word byte, 2 symbol
_KIND[0x21:0x80] = 2
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
_NOT_WORD, _NOT_SYMBOL = _KIND != 1, _KIND != 2
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


def tokens(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): token hashes in text order and the n+1 row boundaries."""
    word, symbol = Words(s, _NOT_WORD, fold=True), Words(s, _NOT_SYMBOL)
    capitals = np.concatenate([[0], np.cumsum(_UPPER[s.data])])
    ups = capitals[word.end] - capitals[word.start]
    shape = np.minimum(ups, 2).astype(np.uint64)
    start = np.concatenate([word.start, symbol.start])
    h = np.concatenate([mix(word.hash + shape), mix(symbol.hash ^ U64(0x5BD1E995))])
    order = np.argsort(start, kind="stable")
    return h[order], np.searchsorted(start[order], s.off)


_r = np.random.default_rng(41)
_PLACE = _r.integers(0, DIM, (CELLS, 2))
_SIGN = _r.choice([-1.0, 1.0], (CELLS, 2))
INDEX = np.zeros((CELLS, DIM), np.float32)
np.add.at(INDEX, (np.arange(CELLS)[:, None], _PLACE), _SIGN)


def _contexts(cell: np.ndarray, row: np.ndarray, table: np.ndarray) -> None:
    """Add to each cell the index vectors of its neighbours within the same row."""
    flat = np.zeros(CELLS * DIM)
    for d in range(1, REACH + 1):
        same = row[d:] == row[:-d]
        left, right = cell[:-d][same], cell[d:][same]
        for a, b in ((left, right), (right, left)):
            for j in range(2):
                flat += np.bincount(a * DIM + _PLACE[b, j], weights=_SIGN[b, j], minlength=CELLS * DIM)
    table += flat.reshape(CELLS, DIM)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """CELLS x DIM unit context vectors, from every document."""
    share = CELLS // PARTS * DIM

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, salt, seen = np.zeros((CELLS, DIM)), 0, False
        for batch in batches:
            for s in slices(batch):
                h, first = tokens(s)
                cell = (h % U64(CELLS)).astype(np.int64)
                salt, seen = (salt * 31 + int(h[:1].sum() % U64(1 << 31))) % (1 << 31), True
                _contexts(cell, np.repeat(np.arange(s.n), np.diff(first)), table)
        if seen:
            flat = table.astype(np.float32).ravel()
            parts = [flat[i * share : (i + 1) * share].tobytes() for i in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([salt % 64] * PARTS, pa.int32()), pa.array(parts, pa.binary())], ["part", "salt", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(sums, np.float32)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], ["part", "sums"])

    spread = docs.select("text").mapInArrow(lean(local), "part int, salt int, sums binary").repartition(64, "salt", "part")
    table = np.zeros((PARTS, share), np.float64)
    for r in spread.select("part", "sums").mapInArrow(lean(add), "part int, sums binary").toLocalIterator():
        table[r["part"]] += np.frombuffer(r["sums"], np.float32)
    vectors = table.reshape(CELLS, DIM)
    norm = np.sqrt((vectors**2).sum(1, keepdims=True))
    return (vectors / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(s: Slice, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the token vectors of each row, and the log token count."""
    h, first = tokens(s)
    cell = (h % U64(CELLS)).astype(np.int64)
    out = np.zeros((s.n, 4 * DIM + 1), np.float32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        n = np.diff(first)[full][:, None]
        for k, table in enumerate((vectors, INDEX)):
            x = table[cell]
            mean = np.add.reduceat(x, first[full], axis=0) / n
            square = np.add.reduceat(x * x, first[full], axis=0) / n
            out[full, 2 * k * DIM : (2 * k + 1) * DIM] = mean
            out[full, (2 * k + 1) * DIM : (2 * k + 2) * DIM] = np.sqrt(np.maximum(square - mean**2, 0))
        out[full, -1:] = np.log1p(n) / 4
    return out


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    offset: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.spread
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x).astype(np.float64) / self.temperature + self.offset)


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> Model:
    rng = np.random.default_rng(3)
    fold = rng.permutation(len(y)) % 5 == 0
    if len(set(y[fold].tolist())) < 2 or len(set(y[~fold].tolist())) < 2:
        fold = np.zeros(len(y), bool)
    centre, spread = x[~fold].mean(0), x[~fold].std(0) + 1e-3
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z, target, w = ((x - centre) / spread)[~fold], y[~fold], weight[~fold]
    for _ in range(EPOCHS):
        order = rng.permutation(len(target))
        for lo in range(0, len(order), BATCH):
            b = order[lo : lo + BATCH]
            a = np.maximum(z[b] @ p[0] + p[1], 0)
            d = w[b] * (sigmoid(a @ p[2] + p[3]) - target[b]) / len(b)
            back = np.outer(d, p[2]) * (a > 0)
            grads = [z[b].T @ back + 1e-3 * p[0], back.sum(0), a.T @ d + 1e-3 * p[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    out = Model(vectors, centre.astype(np.float32), spread.astype(np.float32), p[0].astype(np.float32), p[1].astype(np.float32), p[2].astype(np.float32), float(p[3][0]), 1.0, 0.0)
    held = fold if fold.any() else np.ones(len(y), bool)
    z, yy, ww = out.logit(x[held]).astype(np.float64), y[held], weight[held]
    grid = [(t, (ww * np.logaddexp(0, np.where(yy > 0, -z, z) / t)).sum()) for t in np.geomspace(0.25, 8, 61)]
    out.temperature = float(min(grid, key=lambda g: g[1])[0])
    return out


def _features(rows: DataFrame, vectors: np.ndarray, keep: list[str], extra) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast((vectors, extra))
    rows = rows.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = shipped.value
        for batch in batches:
            for s in slices(batch, "_text"):
                x = pooled(s, v)
                if model is None:
                    cols = [pa.array(list(x), pa.list_(pa.float32()))]
                else:
                    p = model(x)
                    cols = [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*[s.rows.column(c) for c in keep], *cols], names)

    out = schema_with(rows, keep, "x array<float>" if extra is None else "score double, predicted int")
    names = out.names
    return rows.mapInArrow(lean(run), out)


def _constant(rate: float, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), rate)


def fit(docs: DataFrame, marks: DataFrame, per_class: int = PER_CLASS):
    """(word vectors, scoring function of pooled vectors)."""
    vectors = word_vectors(docs)
    texts, total = labelled_texts(docs, marks.filter(F.col("label").isin(0, 1)), per_class)
    sample = _features(texts, vectors, ["doc_id", "label"], None)
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["label"]))
    y = np.array([r["label"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        rate = float(total.get(1, 0) / max(1, sum(total.values())))
        return vectors, partial(_constant, rate)
    x = np.array([r["x"] for r in rows], np.float32)
    weight = np.where(y > 0, total[1] / y.sum(), total[0] / (len(y) - y.sum()))
    model = _train(x, y, weight / weight.mean(), vectors)
    model.vectors = np.zeros(0)
    return vectors, model.score


def predict(docs: DataFrame, fitted, keep: list[str]) -> DataFrame:
    vectors, score = fitted
    return _features(docs, vectors, keep, score)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket_of(doc_id, 5) == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    fitted = fit(rows, marks)
    return predict(rows.withColumn("held_out", held_out(F.col("doc_id"))), fitted, ["doc_id", "held_out"])
