"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased letter runs.  The vocabulary is the set of terms whose document frequencies
differ significantly between the two classes of the sample (chi-square at least ``CHI2``); their
inverse document frequencies are counted over all documents.  The examples' unit vectors are stored as
postings in blocks of ``BLOCK`` examples, each term with its largest weight per block.  A query
bounds every block by the sum of its weights times the block maxima, scores blocks from the highest
bound down, and stops when no remaining bound can reach the K-th best cosine, so the neighbours are
exact.  Their votes, weighted by cosine, are turned into a probability by a logistic fit on the
examples' own leave-one-out votes at the class balance of the labelled rows; the neighbours are the
evidence.

The sample is bounded: about ``PER_CLASS`` labelled rows of each class (documented parameter).

Edge cases: a text without vocabulary terms (null and empty texts included) has no neighbours and
gets the calibrated rate of such examples; with no labelled rows, or with one class only, every
score is that class's rate (0 without any); ties between examples go to the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Slice, Words, bucket_of, labelled_texts, lean, schema_with, sigmoid, signed, slices

PER_CLASS = 1500
MAX_TERMS = 4096
CHI2 = 20.0
K = 25
BLOCK = 64
THRESHOLD = 0.3

LETTERS = np.ones(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = False


def terms_of(s: Slice) -> Words:
    return Words(s, LETTERS, fold=True)


@dataclass
class BlockMaxIndex:
    """Postings of unit example vectors: for each block and term, local example numbers and weights."""

    vectors: list[tuple[np.ndarray, np.ndarray]]
    n_terms: int
    bound: np.ndarray = field(init=False)
    postings: list[dict[int, tuple[np.ndarray, np.ndarray]]] = field(init=False)

    def __post_init__(self) -> None:
        blocks = (len(self.vectors) + BLOCK - 1) // BLOCK
        self.bound = np.zeros((self.n_terms, blocks), np.float64)
        lists: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(blocks)]
        for e, (terms, weights) in enumerate(self.vectors):
            for t, w in zip(terms.tolist(), weights.tolist()):
                lists[e // BLOCK].setdefault(t, []).append((e % BLOCK, w))
        self.postings = [{t: (np.array([e for e, _ in x]), np.array([w for _, w in x])) for t, x in b.items()} for b in lists]
        for b, own in enumerate(self.postings):
            for t, (_, w) in own.items():
                self.bound[t, b] = w.max()

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine, ties to the smaller number."""
        upper = weights @ self.bound[terms]
        found_e, found_c, floor = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-upper, kind="stable"):
            if upper[b] <= 0 or (len(found_e) >= k and upper[b] < floor - 1e-12):
                break
            dots = np.zeros(BLOCK)
            own = self.postings[b]
            for t, w in zip(terms.tolist(), weights.tolist()):
                if t in own:
                    e, v = own[t]
                    dots[e] += w * v
            at = np.flatnonzero(dots > 0)
            at = at[at + b * BLOCK != skip]
            found_e = np.concatenate([found_e, at + b * BLOCK])
            found_c = np.concatenate([found_c, dots[at]])
            if len(found_e) > k:
                top = np.lexsort((found_e, -np.round(found_c, 12)))[:k]
                found_e, found_c = found_e[top], found_c[top]
            floor = found_c.min() if len(found_e) >= k else 0.0
        order = np.lexsort((found_e, -np.round(found_c, 12)))
        return found_e[order], found_c[order]


@dataclass
class Model:
    vocab: np.ndarray  # sorted term hashes
    idf: np.ndarray
    index: BlockMaxIndex
    label: np.ndarray
    ids: np.ndarray
    slope: float
    intercept: float
    empty: float
    cache: dict = field(default_factory=dict)

    def vector(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector over the vocabulary: term numbers and weights."""
        if not len(self.vocab):
            return np.zeros(0, np.int64), np.zeros(0)
        k = np.searchsorted(self.vocab, hashes)
        k[k == len(self.vocab)] = 0
        terms, tf = np.unique(k[self.vocab[k] == hashes], return_counts=True)
        w = (1 + np.log(tf)) * self.idf[terms] if len(terms) else np.zeros(0)
        norm = np.sqrt((w * w).sum())
        return terms, w / norm if norm else w

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        e, c = self.index.nearest(terms, weights, K, skip)
        w = c * c
        return (float((w * self.label[e]).sum() / w.sum()) if len(e) else float("nan")), e, c

    def score(self, hashes: np.ndarray) -> tuple[float, list[int], list[float]]:
        terms, weights = self.vector(hashes)
        if not len(terms):
            return self.empty, [], []
        key = (terms.tobytes(), weights.tobytes())
        if key not in self.cache:
            if len(self.cache) > 50_000:
                self.cache.clear()
            raw, e, c = self.vote(terms, weights)
            p = self.empty if raw != raw else float(sigmoid(np.array(self.slope * raw + self.intercept)))
            self.cache[key] = (p, self.ids[e[:5]].tolist(), c[:5].tolist())
        return self.cache[key]


def _weighted_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    a = b = 0.0
    w = w / w.mean() if len(w) else w
    for _ in range(50):
        p = sigmoid(a * x + b)
        g = np.array([(w * (y - p) * x).sum() - 0.1 * a, (w * (y - p)).sum()])
        h = w * p * (1 - p) + 1e-9
        m = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        d = np.clip(np.linalg.solve(m, g), -2, 2)
        a, b = a + d[0], b + d[1]
    return float(a), float(b)


def _sampled_terms(sample: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """(doc_id, label, term hashes) of every sampled row, in doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch):
                w = terms_of(s)
                h = [signed(w.hash[a:b]) for a, b in zip(w.first, w.first[1:])]
                yield pa.RecordBatch.from_arrays([s.rows.column("doc_id"), s.rows.column("label"), pa.array(h, pa.list_(pa.int64()))], ["doc_id", "label", "terms"])

    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text").mapInArrow(lean(run), "doc_id long, label int, terms array<long>").collect()
    return sorted(((r[0], r[1], np.array(r[2], np.int64).view(np.uint64)) for r in rows), key=lambda r: (r[0], r[1], len(r[2])))


def document_frequencies(docs: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each vocabulary term occurs, and the number of documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.value
        df, n = np.zeros(len(v) + 1, np.int64), 0
        for batch in batches:
            for s in slices(batch):
                n += s.n
                w = terms_of(s)
                if len(v):
                    k = np.searchsorted(v, w.hash)
                    k[k == len(v)] = 0
                    hit = v[k] == w.hash
                    pairs = np.unique(w.row[hit] * (len(v) + 1) + k[hit])
                    df += np.bincount(pairs % (len(v) + 1), minlength=len(v) + 1)
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    counted = docs.select("text").mapInArrow(lean(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(len(vocab) + 1, np.int64)
    for r in counted:
        out[r["term"]] = r["df"]
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, marks: DataFrame, per_class: int = PER_CLASS) -> Model:
    """docs: all (doc_id, text); marks: (doc_id, label) rows that may be learned from."""
    sample, total = labelled_texts(docs, marks.filter(F.col("label").isin(0, 1)), per_class)
    rows = _sampled_terms(sample)
    y = np.array([r[1] for r in rows], float)
    prior = total.get(1, 0) / max(1, sum(total.values()))
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), BlockMaxIndex([], 0), y, np.zeros(0, np.int64), 0.0, 0.0, float(prior))
    sets = [np.unique(r[2]) for r in rows]
    terms, where = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in sets])
    pos = np.bincount(where, weights=y[doc], minlength=len(terms))
    neg = np.bincount(where, minlength=len(terms)) - pos
    n1, n0 = y.sum(), len(y) - y.sum()
    num = (n1 + n0) * (pos * (n0 - neg) - neg * (n1 - pos)) ** 2
    chi = num / np.maximum((pos + neg) * (n1 + n0 - pos - neg) * n1 * n0, 1)
    best = np.lexsort((terms, -chi))[:MAX_TERMS]
    vocab = np.sort(terms[best[chi[best] >= CHI2]])
    df, n = document_frequencies(docs, vocab)
    m = Model(vocab, np.log((1 + n) / (1 + df)) + 1, BlockMaxIndex([], len(vocab)), y, np.array([r[0] if r[0] is not None else -1 for r in rows]), 0.0, 0.0, float(prior))
    vectors = [m.vector(r[2]) for r in rows]
    m.index = BlockMaxIndex(vectors, len(vocab))
    weight = np.where(y > 0, total.get(1, 0) / n1, total.get(0, 0) / n0)
    raw = np.array([m.vote(*v, skip=i)[0] if len(v[0]) else np.nan for i, v in enumerate(vectors)])
    none = np.isnan(raw)
    m.empty = float(((weight * y)[none].sum() + prior) / (weight[none].sum() + 1))
    m.slope, m.intercept = _weighted_logistic(raw[~none], y[~none], weight[~none])
    return m


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with score, predicted, and the nearest examples (doc_ids and cosines)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = schema_with(rows, keep, "score double, predicted int, evidence array<bigint>, cosines array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for s in slices(batch, "_text"):
                w = terms_of(s)
                out = [m.score(w.hash[a:b]) for a, b in zip(w.first, w.first[1:])]
                p = np.array([o[0] for o in out])
                yield pa.RecordBatch.from_arrays(
                    [*[s.rows.column(c) for c in keep], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                    [*keep, "score", "predicted", "evidence", "cosines"],
                )

    return rows.mapInArrow(lean(run), schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket_of(doc_id, 4) == 2, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    model = fit(rows, marks)
    return predict(rows.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
