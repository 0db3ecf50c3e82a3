"""Word confidences and word distributions from token pieces, as Column expressions.

A candidate's tokens come as parallel arrays.  Words are runs of pieces from one word mark to the
next; every result is null unless it lines up with the normalised words of the candidate's text, so
that a confidence never belongs to another word.  All passes are linear in the number of pieces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import n_words, once, words

# The word-start marks of SentencePiece and of byte-level BPE.
SENTENCE_MARK = "▁"
BYTE_MARK = "Ġ"
LEAST_P = 1e-4


def _zip(pieces: Column, **others: Column) -> Column:
    """array<struct<piece, ...>> of the parallel arrays, without null pieces."""
    rows = F.arrays_zip(pieces.alias("piece"), *[c.alias(n) for n, c in others.items()])
    names = ["piece", *others]
    rows = F.transform(rows, lambda x: F.struct(*[x[n].alias(n) for n in names]))
    return F.filter(rows, lambda x: x["piece"].isNotNull())


def _groups(rows: Column, marks: str) -> Column:
    """The rows cut before each piece that begins with a mark; the first row always begins a word."""

    def cut(have: Column) -> Column:
        heads = F.filter(F.transform(have, lambda x, i: F.when((i == 0) | F.substring(x["piece"], 1, 1).isin(*marks), i)), lambda i: i.isNotNull())
        return once(heads, lambda at: F.transform(at, lambda s, j: F.slice(have, s + 1, F.coalesce(F.get(at, j + 1), F.size(have)) - s)))

    return once(rows, cut)


def _mean(group: Column, name: str) -> Column:
    return F.aggregate(group, F.lit(0.0), lambda s, x: s + x[name].cast("double")) / F.size(group)


def _spoken(group: Column, marks: str) -> Column:
    """A word's text: its pieces joined, leading marks as spaces."""
    return F.array_join(F.transform(group, lambda x: F.regexp_replace(x["piece"], f"^[{marks}]+", " ")), "")


def _says(group: Column) -> Column:
    """Whether a SentencePiece word normalises to anything: it has a letter, digit or underscore (the mark
    is none of them)."""
    return F.exists(group, lambda x: F.rlike(x["piece"], F.lit(r"[\p{L}\p{N}_]")))


def _lined_up(out: Column, text: Column) -> Column:
    return once(out, lambda o: F.when(F.size(o) == n_words(text), o))


def sentence_confidences(pieces: Column, confs: Column, text: Column, special: list[str]) -> Column:
    """Mean confidence of each word of a SentencePiece candidate.

    Special pieces are left out first.  Words that normalise to nothing have no place; no pieces at
    all, or another number of words than the text has, gives null.
    """
    rows = F.filter(_zip(pieces, conf=confs), lambda x: ~x["piece"].isin(*special))
    said = F.filter(_groups(rows, SENTENCE_MARK), _says)
    return F.when(F.size(rows) > 0, _lined_up(F.transform(said, lambda g: _mean(g, "conf")), text))


def byte_confidences(pieces: Column, confs: Column, text: Column) -> Column:
    """Mean confidence of each word of a byte-level BPE (or SentencePiece) candidate; a run of
    pieces that normalises to several words gives its mean to each of them."""
    marks = BYTE_MARK + SENTENCE_MARK
    means = F.transform(_groups(_zip(pieces, conf=confs), marks), lambda g: once(_mean(g, "conf"), lambda m: F.transform(words(_spoken(g, marks)), lambda _: m)))
    return F.when(F.size(pieces) > 0, _lined_up(F.flatten(means), text))


def word_distributions(pieces: Column, ids: Column, top_ids: Column, top_p: Column, text: Column, special: list[str]) -> Column:
    """For each word the id of its first token and that token's alternatives: ids and probabilities
    (4 places) of at least ``LEAST_P``; null where the words do not line up."""
    rows = F.filter(_zip(pieces, id=ids, tops=top_ids, ps=top_p), lambda x: ~x["piece"].isin(*special))

    def first(g: Column) -> Column:
        head = F.element_at(g, 1)
        kept = F.filter(F.transform(head["tops"], lambda t, i: F.struct(t.alias("id"), F.get(head["ps"], i).alias("p"))), lambda x: x["p"] >= LEAST_P)
        return once(kept, lambda k: F.struct(head["id"].alias("first"), k["id"].alias("ids"), F.transform(k["p"], lambda p: F.round(p, 4)).alias("p")))

    said = lambda own: F.transform(F.filter(_groups(own, SENTENCE_MARK), _says), first)
    return once(rows, lambda own: F.when(F.size(own) > 0, _lined_up(said(own), text)))
