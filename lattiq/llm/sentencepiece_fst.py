"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model file: the normaliser (dummy prefix, white-space rules,
space to U+2581), the pieces (a trie whose leaves emit ids), and byte fallback (a character no piece
spells emits its UTF-8 bytes' ids).  They are composed lazily with each input, and the encoding is
the shortest path in the tropical semiring.

* Unigram models: an arc's weight is the negative log probability of its piece.
* BPE models: merging has no additive weights, but its results are exactly the paths in which every
  two neighbouring pieces p, q are stable, that is, merging the string pq gives p, q again.  The
  transducer therefore remembers the last piece, an arc p -> q has weight 1 when the pair is stable
  and infinity otherwise, and the path of finite weight is unique.  Unknown characters take part in
  no merge, so every pair with one of them is stable.  Should no finite path exist (a model whose
  own pieces do not merge to themselves), the merges are carried out directly.

No piece holds a space mark after another character, so the input is cut there: the pieces of equal
chunks are equal, and a bounded cache of chunks saves repeated composition.

Edge cases: null text has null ids and null decoded text; empty text has no ids; any text is encoded
whole; decoding gives back the normalised text, equal to the input except that U+2581 is a space.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, schema_with

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE, PAIRS = 120_000, 300_000  # a generation; entries of about 250 and 130 bytes, two generations: 138 MB a worker
FALLBACK = 1e6
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4


class Transducer:
    """Compiled from the pieces of a model; picklable."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, prefix: bool, collapse: bool):
        self.bpe, self.prefix, self.collapse = bpe, prefix, collapse
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.weight = [-s for _, s, _ in pieces]
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.spelled = [p.replace(MARK, " ").encode() if kind in (NORMAL, USER) else bytes([int(p[3:5], 16)]) if kind == BYTE else b"" for p, _, kind in pieces]
        self.text = [p for p, _, _ in pieces]
        cuttable = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self._cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if cuttable else re.compile(r"(?s).+")
        self._fresh()

    def _fresh(self) -> None:
        # A node's "" is the longest piece on the way to it, and ``shorter`` the next one below a piece; last
        # comes byte fallback (-2) where no piece is one character, and then none (-3).  The three entries
        # at the lists' ends are those of -3, -2 and -1.
        self.trie: dict = {"": -2}
        self.size = [*map(len, self.text), 0, 1, 0]
        self.shorter = [-3] * len(self.size)
        for p in sorted(filter(None, self.ids), key=len):
            node = self.trie
            for c in p:
                above = node[""]
                node = node.setdefault(c, {"": above})
            node[""] = i = self.ids[p]
            self.shorter[i] = above if len(p) > 1 else -3
        self.deepest = max(map(len, self.ids), default=0)
        self._stable: dict[int, bool] = {}
        self._stable_old: dict[int, bool] = {}
        self._chunks_old: dict[str, array] = {}
        self._edge: dict[int, tuple | None] = {}
        self._chunks: dict[str, array] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("trie", "size", "shorter", "deepest", "_edge", "_stable", "_stable_old", "_chunks", "_chunks_old")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    @classmethod
    def load(cls, path: str = MODEL) -> Transducer:
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n, t = m.normalizer_spec, m.trainer_spec
        if n.precompiled_charsmap or t.treat_whitespace_as_suffix or t.model_type not in (1, 2):
            raise ValueError("only identity-normalised unigram and BPE models are supported")
        return cls([(p.piece, p.score, p.type) for p in m.pieces], t.model_type == 2, n.add_dummy_prefix, n.remove_extra_whitespaces)

    def normalise(self, text: str) -> str:
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.prefix else "") + text).replace(" ", MARK)

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging as defined: always the best-scored neighbouring pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.weight[k] < best):
                    best, at = self.weight[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, p: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """While p is merged: its right-edge and left-edge symbols, each with the weight of the merge
        that ends it (infinite for p itself).  None if p does not merge to itself."""
        if p not in self._edge:
            parts, right, left = list(self.text[p]), [], []
            while len(parts) > 1:
                found = [(self.weight[k], i) for i in range(len(parts) - 1) if (k := self.ids.get(parts[i] + parts[i + 1])) is not None]
                if not found:
                    break
                w, i = min(found)
                if i == len(parts) - 2:
                    right.append((parts[-1], w))
                if i == 0:
                    left.append((parts[0], w))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            inf = float("inf")
            self._edge[p] = ([*right, (parts[0], inf)], [*left, (parts[0], inf)]) if len(parts) == 1 else None
        return self._edge[p]

    def stable(self, p: int, q: int) -> bool:
        """No merge across the border comes before the merges that build p and q.  Merges happen in
        the order of their weights, leftmost first, so two edge symbols meet unless one has gone."""
        key = p << 32 | q
        known = self._stable.get(key)
        if known is None and (known := self._stable_old.get(key)) is not None:
            self._keep("_stable", key, known, PAIRS)
        if known is None:
            a, b = self._edges(p), self._edges(q)
            known = a is not None and b is not None
            if known:
                ids, weight = self.ids, self.weight
                known = not any((k := ids.get(x + y)) is not None and weight[k] < until_x and weight[k] <= until_y for x, until_x in a[0] for y, until_y in b[1])
            self._keep("_stable", key, known, PAIRS)
        return known

    def _keep(self, name: str, key, value, most: int) -> None:
        """Remember in the young generation; when it is full it becomes the old one, whose entries
        come back as they are met, so that frequent ones stay."""
        young = getattr(self, name)
        if len(young) >= most:
            setattr(self, f"{name}_old", young)
            young = {}
            setattr(self, name, young)
        young[key] = value

    def _fallback(self, char: str) -> list[int]:
        return [self.byte.get(b, self.unknown) for b in char.encode()] if self.byte else [self.unknown]

    def shortest_path(self, chunk: str) -> array:
        """Ids of the lightest path of the composition with a chunk."""
        out = self._only_path(chunk) if self.bpe else self._relaxed(chunk)
        if out is None:
            out = [k for part in self.merge(chunk) for k in ([self.ids[part]] if part in self.ids else [b for c in part for b in self._fallback(c)])]
        return array("i", out)

    def _arcs(self, chunk: str, i: int) -> list[tuple[int, int]]:
        """(piece, end) of the pieces that start at i, short to long; piece -2 is byte fallback."""
        out, node = [], self.trie
        for c in chunk[i : i + self.deepest]:
            if c not in node:
                break
            node = node[c]
        q = node[""]
        while q != -3:
            out.append((q, i + self.size[q]))
            q = self.shorter[q]
        return out[::-1]

    def _only_path(self, chunk: str) -> list[int] | None:
        """The path of finite weight.  There is at most one, so states are expanded depth first,
        longest piece first, and the first complete path is the shortest."""
        if chunk in self.ids:
            return [self.ids[chunk]]
        n, known, stable, trie, size, shorter, deepest = len(chunk), self._stable, self.stable, self.trie, self.size, self.shorter, self.deepest
        path: list[int] = []
        dead: set[tuple[int, int]] = set()
        p, i = -1, 0  # the state: the last piece and where it ends
        while i < n:
            node = trie
            for c in chunk[i : i + deepest]:
                if c not in node:
                    break
                node = node[c]
            q = node[""]
            while True:
                if q == -3:
                    if not path:
                        return None
                    dead.add((p, i))
                    q = path.pop()
                    i -= size[q]
                    p = path[-1] if path else -1
                elif p < 0 or q < 0:
                    if not dead or (q, i + size[q]) not in dead:
                        break
                else:
                    ok = known.get(p << 32 | q)
                    if (stable(p, q) if ok is None else ok) and (not dead or (q, i + size[q]) not in dead):
                        break
                q = shorter[q]
            path.append(q)
            p, i = q, i + size[q]
        if -2 not in path:
            return path
        out, i = [], 0
        for q in path:
            if q >= 0:
                out.append(q)
            else:
                out += self._fallback(chunk[i])
            i += size[q]
        return out

    def _relaxed(self, chunk: str) -> list[int]:
        """Shortest path by relaxing positions in order; byte fallback costs more than any piece."""
        n = len(chunk)
        dist = [0.0] + [float("inf")] * n
        last, back = [0] * (n + 1), [0] * (n + 1)
        for i in range(n):
            for q, j in self._arcs(chunk, i):
                w = dist[i] + (self.weight[q] if q >= 0 else FALLBACK)
                if w < dist[j]:
                    dist[j], last[j], back[j] = w, q, i
        out, at = [], n
        while at:
            out += [last[at]] if last[at] >= 0 else self._fallback(chunk[back[at]])[::-1]
            at = back[at]
        return out[::-1]

    def encode(self, text: str) -> array:
        out = array("i")
        for chunk in self._cut.findall(self.normalise(text)):
            ids = self._chunks.get(chunk)
            if ids is None:
                ids = self._chunks_old.get(chunk)
                if ids is None:
                    ids = self.shortest_path(chunk)
                if len(chunk) <= 64:
                    self._keep("_chunks", chunk, ids, CACHE)
            out += ids
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ids, n_pieces and the decoded text for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(Transducer.load(model))
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = schema_with(rows, keep, "ids array<int>, n_pieces long, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column("_text").to_pylist()
                ids = [None if x is None else t.encode(x) for x in texts]
                flat, sizes = array("i"), [0 if x is None else len(x) for x in ids]
                for x in ids:
                    if x is not None:
                        flat += x
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)), mask=pa.array([x is None for x in ids]))
                decoded = [None if x is None else t.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists, pa.array(sizes, pa.int64()), pa.array(decoded, pa.string())], [*keep, "ids", "n_pieces", "decoded"])

    return rows.mapInArrow(lean(run), schema)


def report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document: ids, their number, digests of text and decoded text, and whether they agree."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.sha2(F.translate("text", MARK, " ").cast("binary"), 256).alias("text_sha256"))
    out = encode(rows, model, ("doc_id", "text_sha256"))
    digest = F.sha2(F.col("decoded").cast("binary"), 256)
    return out.select("doc_id", "n_pieces", "ids", digest.alias("decoded_sha256"), digest.eqNullSafe(F.col("text_sha256")).alias("round_trip"))
