"""Text normalisation, tokens, and edit distance over word lists, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str) -> Column:
    """Lower-case, delete everything but letters, digits, underscore and white space, and split.

    Empty text has no words; apostrophes are deleted, not spaced.
    """
    clean = F.regexp_replace(F.lower(col(text)), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")


def normalize(text: Column | str) -> Column:
    return F.array_join(words(text), " ")


def basic_words(text: Column | str) -> Column:
    """A second, more forgiving normalisation: bracketed remarks go, and every mark, symbol or
    punctuation sign becomes a space (so an apostrophe splits a word).  Compatibility forms of
    letters are left as they are."""
    said = F.regexp_replace(F.lower(col(text)), r"[<\[][^>\]]*[>\]]", "")
    said = F.regexp_replace(said, r"\([^)]+\)", "")
    return F.filter(F.split(F.regexp_replace(said, r"[\p{M}\p{S}\p{P}]", " "), r"\s+"), lambda w: w != "")


def second_words(text: Column | str, lang: Column | str, english=None) -> Column:
    """The second normalisation by language: ``english`` (a function from Column to Column) for
    English, null where there is none, and the basic one for the others."""
    other = F.when(col(lang) != "en", basic_words(text))
    return other if english is None else F.when(col(lang) == "en", english(col(text))).otherwise(other)


def n_words(text: Column | str) -> Column:
    return F.size(words(text))


PRIVATE = "".join(map(chr, range(0xE000, 0xF900)))


def letters(ws: Column, alphabet: Column) -> Column:
    """One character a word, by its place in the alphabet: from the private-use area, and beyond its
    6,400 characters from the planes above (more than 1,000,000 words; none of them is a surrogate)."""

    def far(n: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(n - len(PRIVATE) + 65536), 8, "0")), "UTF-32")

    def code(w: Column) -> Column:
        return once(F.array_position(alphabet, w).cast("int"), lambda n: F.when(n <= len(PRIVATE), F.substring(F.lit(PRIVATE), n, F.lit(1))).otherwise(far(n)))

    return F.array_join(F.transform(ws, code), "")


def word_distance(a: Column | str, b: Column | str) -> Column:
    """Unit-cost Levenshtein distance of two word arrays.

    Both lists are spelled over their common alphabet (by interpreted lambdas) so that the built-in
    string distance can be used.
    """
    a, b = col(a), col(b)
    return once(F.array_distinct(F.concat(a, b)), lambda alphabet: F.levenshtein(letters(a, alphabet), letters(b, alphabet)))


def once(value: Column, body) -> Column:
    """body(value) with value evaluated once a row: written into a lambda it would be once an element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wer(edits: Column | str, ref_len: Column | str, hyp_len: Column | str) -> Column:
    """Word error rate of one pair; an empty reference counts 0 or 1."""
    e, r, h = col(edits), col(ref_len), col(hyp_len)
    return F.when(r == 0, F.when(h == 0, 0.0).otherwise(1.0)).otherwise(e / r)


def char_similarity(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def order_key(uid: Column | str, salt: str) -> Column:
    """A hash order that a salt fixes."""
    return F.crc32(F.concat(F.lit(salt + "|"), col(uid)).cast("binary"))


def utterance_seed(base: int, uid: Column | str, arm: Column | str) -> Column:
    key = F.crc32(F.concat_ws("|", col(uid), col(arm)).cast("binary"))
    return F.lit(base).cast("long").bitwiseXOR(key).bitwiseAND(F.lit(0x7FFFFFFF))


def safe_name(uid: Column | str) -> Column:
    u = col(uid)
    tail = F.format_string("%06x", F.crc32(u.cast("binary")).bitwiseAND(F.lit(0xFFFFFF)))
    return F.concat_ws("-", F.substring(F.regexp_replace(u, r"[^A-Za-z0-9._-]", "_"), 1, 120), tail)


def half_of(cluster: Column | str) -> Column:
    """0 or 1, by a hash of the cluster: all its utterances are in one half."""
    return F.crc32(col(cluster).cast("string").cast("binary")) % 2


def model_key(model: Column | str, precision: Column | str) -> Column:
    """The model, with its precision where one is set."""
    p = col(precision)
    return F.when(F.coalesce(p, F.lit("")) == "", col(model)).otherwise(F.concat_ws("@", col(model), p))


def keep_utterance(duration: Column | str, count: Column | str) -> Column:
    """The quality filter: 0.8 to 28 seconds and 1 to 75 words."""
    return col(duration).between(0.8, 28.0) & col(count).between(1, 75)


def bucket(value: Column | str, edges: list[tuple[float, float]], labels: list[str], right: bool = False, default: str | None = None) -> Column:
    """Label of the first range that holds the value: [lo, hi) or, with ``right``, (lo, hi]."""
    v, out = col(value), F.lit(default).cast("string")
    for (lo, hi), label in reversed(list(zip(edges, labels))):
        out = F.when((v > lo) & (v <= hi) if right else (v >= lo) & (v < hi), label).otherwise(out)
    return out


def duration_bucket(d: Column | str) -> Column:
    return bucket(d, [(0, 10), (10, 20), (20, 30)], ["0-10s", "10-20s", "20-30s"], default="30s+")


def length_bucket_closed(n: Column | str) -> Column:
    return bucket(n, [(0, 6), (6, 11), (11, 21)], ["1-5", "6-10", "11-20"], default="21+")


def length_bucket_cut(n: Column | str) -> Column:
    return bucket(n, [(0, 5), (5, 10), (10, 20), (20, 10**6)], ["1-5", "6-10", "11-20", "21+"], right=True)


def cluster_of(kind: Column | str, uid: Column | str) -> Column:
    """Speaker, meeting or call of an utterance id, by the data set's naming rule."""
    k, u = col(kind), col(uid)
    return (
        F.when(k == "speaker", F.substring_index(u, "-", 1))
        .when(k == "meeting", F.upper(F.regexp_extract(u, r"([A-Za-z]{2}\d{4}[a-z]?)", 1)))
        .when(k == "call", F.element_at(F.split(u, r"_S"), 1))
        .when(k == "underscore", F.substring_index(u, "_", 1))
        .when(k == "path", F.substring_index(u, "/", 1))
        .otherwise(u)
    )


def collapse_runs(path: Column | str, conf: Column | str, blank: Column | str | int) -> Column:
    """CTC collapse: array<struct<token, conf>> of runs without blanks, conf averaged over the run."""
    b = F.lit(blank) if isinstance(blank, int) else col(blank)
    steps = F.arrays_zip(col(path).alias("t"), col(conf).alias("c"))
    zero = F.filter(F.array(F.struct(F.lit(0).alias("t"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))), lambda x: F.lit(False))

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["t"].alias("t"), (last["s"] + x["1"]).alias("s"), (last["n"] + 1).alias("n"))))
        fresh = F.concat(acc, F.array(F.struct(x["0"].cast("int").alias("t"), x["1"].cast("double").alias("s"), F.lit(1).alias("n"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["t"] == x["0"]), longer).otherwise(fresh)

    steps = F.transform(steps, lambda x: F.struct(x["t"].alias("0"), x["c"].alias("1")))
    runs = F.aggregate(steps, zero, add)
    return F.transform(F.filter(runs, lambda r: r["t"] != b), lambda r: F.struct(r["t"].alias("token"), (r["s"] / r["n"]).alias("conf")))
