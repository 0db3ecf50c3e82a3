"""Language identification with error-correcting output codes.

Every language gets a binary codeword; one binary n-gram classifier per code bit tells the languages
with a 1 from those with a 0.  A bit's classifier is additive over byte bigrams and trigrams of the
lower-cased text (log ratios of smoothed n-gram frequencies), averaged over the text and scaled by
a one-dimensional logistic fit.  Decoding adds, for each language, the logistic losses of the bits
against its codeword, weighted by each bit's accuracy, and takes the smallest; a narrow gap to the
runner-up flags the text as ambiguous.

The classifiers are fitted on a bounded sample: about ``PER_LANGUAGE`` rows of each language
(documented parameter), whole texts.  Prediction streams every document once; nothing is shuffled.

Edge cases: null text and texts without a letter give ``und`` with score 0; rows of null lang are
never learned from; with a single known language every text with a letter gets it with score 1;
with none, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Slice, bounded_sample, bucket_of, lean, schema_with, sigmoid, slices

PER_LANGUAGE = 400
CELLS = 1 << 16
AMBIGUOUS = 0.75
SLICE = 250_000
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1 bits: the exhaustive code up to 7 classes, else the best of seeded random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = [[1 if c == 0 else (b >> (c - 1)) & 1 for c in range(n)] for b in range(2 ** (n - 1) - 1)]
        return np.array(bits).T * 2.0 - 1
    width, rng, best, top = int(np.ceil(8 * np.log2(n))), np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, width)) * 2.0 - 1
        gap = (width - (code @ code.T - 2 * width * np.eye(n)).max()) if n > 1 else width
        if gap > top and (np.abs(code.sum(0)) < n).all():
            best, top = code, gap
    return best


def gram_cells(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers of the bigram and the trigram at every byte; CELLS where the row ends before."""
    b = LOWER[s.data].astype(np.uint32)
    two, three = np.full(len(b), CELLS, np.uint32), np.full(len(b), CELLS, np.uint32)
    if len(b) > 1:
        two[:-1] = b[:-1] << 8 | b[1:]
    if len(b) > 2:
        three[:-2] = ((two[:-2] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    for back in (1, 2):
        ends = s.off[1:] - back
        ends = ends[ends >= s.off[:-1]]
        if back == 1:
            two[ends] = CELLS
        three[ends] = CELLS
    return two, three


def row_sums(values: np.ndarray, s: Slice) -> np.ndarray:
    """Sums of consecutive rows of ``values`` for each text (zero for empty texts)."""
    out = np.zeros((s.n, values.shape[1]), np.float64)
    full = np.flatnonzero(np.diff(s.off))
    if len(full):
        out[full] = np.add.reduceat(values, s.off[full], axis=0)
    return out


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    two: np.ndarray  # CELLS+1 x bits, the last row zero
    three: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    weight: np.ndarray

    def margins(self, s: Slice) -> np.ndarray:
        two, three = gram_cells(s)
        total = row_sums(self.two[two] + self.three[three], s)
        return total / np.maximum(np.diff(s.off), 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of the softmax over negative losses, and the ambiguity flag."""
        z = margins * self.scale + self.shift
        loss = np.stack([(self.weight * np.logaddexp(0, -z * c)).sum(1) for c in self.code], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        score = p[np.arange(len(p)), best]
        return best, score, score < AMBIGUOUS


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a ridge-penalised one-dimensional logistic fit by Newton steps."""
    sd = x.std() or 1.0
    a, b = 0.0, 0.0
    for _ in range(30):
        p = sigmoid(a * x / sd + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * x / sd).sum() - 0.01 * a, (y - p).sum() - 0.01 * b])
        h = np.array([[(w * x * x).sum() / sd**2 + 0.01, (w * x).sum() / sd], [(w * x).sum() / sd, w.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -4, 4)
        a, b = a + step[0], b + step[1]
    return a / sd, b


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on (doc_id, text, lang) rows; n-gram counts are summed per language on the executors."""
    sample = bounded_sample(labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang"), "lang", per_language)
    rows = sample.select("lang", "text").toPandas().sort_values(["lang", "text"])
    langs = sorted(rows["lang"].unique())
    code = codewords(len(langs))
    counts = np.zeros((2, len(langs), CELLS + 1))
    held = []
    for i, lang in enumerate(langs):
        for batch in pa.Table.from_pandas(rows[rows["lang"] == lang][["text"]], preserve_index=False).to_batches():
            for s in slices(batch):
                for k, cells in enumerate(gram_cells(s)):
                    counts[k, i] += np.bincount(cells, minlength=CELLS + 1)
                held.append((i, s))
    counts[:, :, CELLS] = 0
    tables = []
    for k in range(2):
        p = (counts[k] + 0.5) / (counts[k].sum(1, keepdims=True) + 0.5 * CELLS)
        bits = [np.log(p[c > 0].mean(0)) - np.log(p[c < 0].mean(0)) for c in code.T]
        w = np.stack(bits, 1).astype(np.float32) if bits else np.zeros((CELLS + 1, 0), np.float32)
        w[CELLS] = 0
        tables.append(w)
    m = Model(langs, code, tables[0], tables[1], np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    if code.shape[1]:
        x = np.concatenate([m.margins(s) for _, s in held])
        y = np.concatenate([np.full(s.n, i) for i, s in held])
        for b in range(code.shape[1]):
            hit = (code[y, b] > 0).astype(float)
            m.scale[b], m.shift[b] = _logistic(x[:, b], hit)
            m.weight[b] = max(0.05, 2 * ((m.scale[b] * x[:, b] + m.shift[b] > 0) == hit).mean() - 1)
    return m


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of docs with lang_pred, score and ambiguous for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    schema = schema_with(rows, keep, "lang_pred string, score double, ambiguous boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for s in slices(batch, "_text", SLICE):
                letter = np.array(s.column("_letter"), bool)
                if m.langs:
                    best, score, unsure = m.decode(m.margins(s))
                else:
                    best, score, unsure, letter = np.zeros(s.n, int), np.zeros(s.n), np.ones(s.n, bool), np.zeros(s.n, bool)
                names = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
                cols = [s.rows.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(unsure | ~letter)], [*keep, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(lean(run), schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket_of(doc_id, 4) == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(rows.filter(~held_out(F.col("doc_id"))))
    return predict(rows.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
