"""Evaluation texts that occur in training texts, word for word or with other numbers, names and units."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.common import cut, small

#: Consecutive words that make a passage.
WINDOW = 12
#: Plain words that a window must have for a copy with other slots to count.
LITERAL = 6
#: Windows of evaluation texts up to which their hashes go to every task; beyond, all windows of the corpus are joined.
MOST_HASHES = 2_000_000
#: Words of identifiers up to which they go to every task; beyond, each text is joined with those that it holds.
MOST_NAMES = 100_000
#: Words for numbers and units, fixed values.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split())
UNITS = frozenset("ms sec secs second seconds min mins minute minutes hour hours day days week weeks month months year years byte bytes kb mb gb tb kib mib gib percent mm cm km meter meters metre metres mile miles kg mg gram grams dollar dollars euro euros".split())

_WORD = re.compile(r"[^\W_]+")
_BREAKS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})
_CHUNK = re.compile(r"[^\W_]+(?:[_.][^\W_]+)*")
_ENDS = re.compile(r"""[.!?:;\n"'()\[\]<>*#-]""")
_ODD = re.compile(r"[^\x00-\x7f]")
#: An odd factor and its inverse modulo 2**64, which takes a window's place out of its hash.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(text: str) -> list[str]:
    """Runs of letters and digits, without format characters, in NFKC and without case."""
    if _ODD.search(text):
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = text.lower()
    return text.translate(_BREAKS).split() if text.isascii() else _WORD.findall(text)


def slot(word: str, names: frozenset[str]) -> str | None:
    """The typed placeholder of a word, None for a plain one. It depends on the word alone."""
    if word.isdigit() or word in NUMBERS:
        return "<number>"
    if word in UNITS:
        return "<unit>"
    if word in names or not (word.isalpha() or word.isdigit()):
        return "<name>"
    return None


@lru_cache(1 << 17)
def _chunk(c: str, names: frozenset[str]) -> tuple[list[tuple[str, str | None]], bool, bool]:
    """(words and their slots, whether it is a name by form, whether it is one if it doesn't start a sentence)."""
    w = [(x, slot(x, names)) for x in words(c)]
    rest = any(k != "<number>" for _, k in w)
    return w, rest and ("_" in c or "." in c or any(map(str.isupper, c[1:]))), rest and c[0].isupper() and len(c) > 1


def template(text: str, names: frozenset[str]) -> list[str]:
    """Plain words, and slots as their type and words: a run of words of one type is one slot, whatever their number.

    Names are also told by form: joined by _ or ., letters mixed with digits, capitals inside a word, or a capital first
    letter anywhere but at the start of a sentence.
    """
    if _ODD.search(text):
        text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    out, last, end = [], None, 0
    for m in _CHUNK.finditer(text):
        w, odd, capital = _chunk(m.group(), names)
        named = odd or (capital and end and _ENDS.search(text, end, m.start()) is None)
        end = m.end()
        for x, k in w:
            if named:
                k = "<name>"
            if k and k == last:
                out[-1] += "_" + x
            else:
                out.append(k + x if k else x)
            last = k
    return out


def _hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little") | 1


class _Hasher:
    """Rolling hashes of windows of templates; remembers the hashes of words, as many as are in use at a time."""

    def __init__(self, names: frozenset[str]) -> None:
        self.names, self.known = names, {}

    def of(self, w: list[str]) -> np.ndarray:
        """Of words, or of templates."""
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        out = [known.get(x) or known.setdefault(x, _hash(x[: x.index(">") + 1] if x[0] == "<" else slot(x, self.names) or x)) for x in w]
        return np.array(out, np.uint64)

    @staticmethod
    def windows(h: np.ndarray, size: int) -> np.ndarray:
        """A hash for each window of that many words."""
        if len(h) < size:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.append(np.uint64(1), np.full(len(h) - 1, _FACTOR)))
            total = np.append(np.uint64(0), np.cumsum(h * power))
            back = np.cumprod(np.append(np.uint64(1), np.full(len(h) - size, _INVERSE)))
            return (total[size:] - total[:-size]) * back + np.uint64(size)


def _hashers(names: frozenset[str] | None):
    """The hasher of a text: one for all, or one by the text's own names."""
    one = None if names is None else _Hasher(names)
    return lambda own: one if one is not None else _Hasher(frozenset(own if own is not None else ()))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sorted(set(words(t))) for t in b.column("text").to_pylist()]
        rows = np.repeat(b.column("_row").to_numpy(), [len(w) for w in found])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([x for w in found for x in w], pa.string())], names=["_row", "w"])


def _named(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts (.., text) with names, those of their words that are in names (w). A row holds no more than its text does."""
    x = cut(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
    held = x.select("_row", "text").mapInArrow(_words_of, "_row long, w string").join(names, "w").groupBy("_row").agg(F.collect_set("w").alias("names"))
    return x.join(held, "_row", "left").drop("_row")


def _case_windows(names: frozenset[str] | None, size: int, merged: bool = False):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashers = _hashers(names)
        for p in batches:
            rows = []
            for q, text, own in zip(p["query_id"], p["text"], p["names"]):
                hasher = hashers(own)
                w = template(text, hasher.names) if merged else words(text)
                if w:
                    n = min(size, len(w))
                    rows += [(q, n, int(np.uint64(x).view(np.int64)), " ".join(w[i : i + n])) for i, x in enumerate(_Hasher.windows(hasher.of(w), n))]
            yield pd.DataFrame(rows, columns=["query_id", "n", "hash", "passage"])

    return run


def _text_windows(names: frozenset[str] | None, lengths: list[int], hashes: np.ndarray | None, merged: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _hashers(names)
        for b in batches:
            doc, size, mark, passage = [], [], [], []
            for i, t, own in zip(b.column("doc_id"), b.column("text"), b.column("names")):
                hasher = hashers(own.as_py())
                w = template(t.as_py(), hasher.names) if merged else words(t.as_py())
                h = hasher.of(w)
                for n in lengths:
                    x = _Hasher.windows(h, n).view(np.int64)
                    if hashes is None:
                        at = range(len(x))
                    elif len(x):
                        place = np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)
                        at = np.flatnonzero(hashes[place] == x).tolist()
                    else:
                        at = []
                    seen = dict.fromkeys((int(x[j]), " ".join(w[j : j + n])) for j in at)
                    doc += [i.as_py()] * len(seen)
                    size += [n] * len(seen)
                    mark += [k for k, _ in seen]
                    passage += [s for _, s in seen]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(size, pa.int32()), pa.array(mark, pa.int64()), pa.array(passage, pa.string())], names=["doc_id", "n", "hash", "passage"])

    return run


def _consistent(names: frozenset[str] | None):
    """Whether two windows agree in all plain words and their slots map one to one. Without names for all, each side's own."""

    def same(a: pd.Series, b: pd.Series, of_a: pd.Series, of_b: pd.Series) -> pd.Series:
        out = []
        for x, y, own, other in zip(a, b, of_a, of_b):
            there, back, plain, good = {}, {}, 0, True
            one = names if names is not None else frozenset(own if own is not None else ())
            two = names if names is not None else frozenset(other if other is not None else ())
            for v, w in zip(x.split(" "), y.split(" ")):
                s, t = (v[: v.find(">") + 1] or slot(v, one), w[: w.find(">") + 1] or slot(w, two))
                if s != t or (s is None and v != w) or (s is not None and (there.setdefault(v, w) != w or back.setdefault(w, v) != v)):
                    good = False
                    break
                plain += s is None
            out.append(good and plain >= LITERAL)
        return pd.Series(out, dtype=bool)

    return same


def _joined(docs: DataFrame, texts: DataFrame, names: frozenset[str] | None, known: DataFrame, window: int, merged: bool) -> DataFrame:
    """(doc_id, query_id, n, passage, asked, verbatim, consistent): windows of both sides that have the same hash."""
    wanted = cut(texts.mapInPandas(_case_windows(names, window, merged), "query_id string, n int, hash long, passage string").distinct(), "case-windows")
    lengths = sorted(r[0] for r in wanted.select("n").distinct().collect())  # at most `window` of them
    marks = wanted.select("hash").distinct().limit(MOST_HASHES + 1)
    marks = np.sort(np.array([r[0] for r in marks.collect()], np.int64))
    hashes = marks if len(marks) <= MOST_HASHES else None
    held = docs.mapInArrow(_text_windows(names, lengths, hashes, merged), "doc_id long, n int, hash long, passage string")
    both = held.join(small(wanted.withColumnRenamed("passage", "asked")), ["n", "hash"])
    same = F.col("passage") == F.col("asked")
    both = cut(both.select("doc_id", "query_id", "n", "passage", "asked", same.alias("verbatim")).distinct(), "leaks")
    if names is not None:
        none = F.lit(None).cast("array<string>")
        return both.withColumn("consistent", F.pandas_udf(_consistent(names), "boolean")("asked", "passage", none, none))
    for side in ("asked", "passage"):
        of = _named(both.select(F.col(side).alias("text")).distinct(), known)
        both = both.join(of.select(F.col("text").alias(side), F.col("names").alias(f"{side}_names")), side, "left")
    return both.withColumn("consistent", F.pandas_udf(_consistent(None), "boolean")("asked", "passage", "asked_names", "passage_names"))


def leaked_cases(documents: DataFrame, cases: DataFrame, window: int = WINDOW, merged: bool = False) -> DataFrame:
    """(doc_id, query_id, verbatim, windows): documents that hold a passage of an evaluation text, and which.

    A passage is `window` consecutive words of the text, or all of a shorter one. Numbers, units and names (words of
    identifiers in the evaluation material, or of letters mixed with digits) are replaced by typed placeholders; windows
    of templates are joined by hash and then compared word by word: verbatim if all words are equal, else a re-parameterised copy if
    the slots map one to one and enough plain words are left (short texts count only verbatim). windows: distinct windows.

    With `merged`, windows of `template` are joined as well: names are also told by form, slots of any number of words match,
    and texts shorter than a window are tried with other slots. Their windows are counted too.

    The evaluation set's window hashes and names go to every task if they are few (checked), and only windows of the corpus
    with such a hash leave their task; otherwise all windows, or all words, are joined by a shuffle, with the same result. Null or empty texts on either side give
    nothing; a repeated row counts once, and texts under several ids are reported for each.
    """
    known = cut(cases.select(F.explode(F.split(F.lower(F.concat_ws(" ", "target_entity_id", "target_entity_name", "file_path")), r"[^\p{L}\p{N}]+")).alias("w")).where("length(w) > 2").distinct(), "names")
    few = known.limit(MOST_NAMES + 1).count() <= MOST_NAMES
    names = frozenset(r[0] for r in known.collect()) if few else None
    own = (lambda d: d.withColumn("names", F.lit(None).cast("array<string>"))) if few else (lambda d: _named(d, known))
    texts = own(cases.select(F.col("query_id").cast("string").alias("query_id"), F.col("query_text").alias("text")).where("query_id is not null and length(text) > 0").distinct())
    docs = own(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and length(text) > 0"))
    both = _joined(docs, texts, names, known, window, False)
    exact = both.where("verbatim").select("doc_id", "query_id", "verbatim", "passage")
    other = both.where(f"not verbatim and n = {window}").where("consistent").select("doc_id", "query_id", "verbatim", "passage")
    if merged:
        more = _joined(docs, texts, names, known, window, True).where("not verbatim").where("consistent")
        plain = F.translate(F.regexp_replace("passage", "<[a-z]+>", ""), "_", " ")
        other = other.unionByName(more.select("doc_id", "query_id", "verbatim", plain.alias("passage")))
    return exact.unionByName(other).groupBy("doc_id", "query_id").agg(F.max("verbatim").alias("verbatim"), F.countDistinct("passage").alias("windows"))
