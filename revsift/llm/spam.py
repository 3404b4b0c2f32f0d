"""Keyword-stuffed pages, bare link lists and piles of product tags, by how neighbouring words go together."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.common import cut, dataset, partitions, qualified, shared_dir, small

#: Bytes of texts whose words and pairs are counted, and scored, together.
CHUNK_BYTES = 16 << 20
#: A line is judged by its information from so many words on, and counts for so many at most when lines are counted by it. Bins of a line's mean information, in bits, and beyond
#: which no line is a salad whatever the corpus.
LINE, WEIGHT, BINS, MOST_BITS = 5, 50, np.arange(-8, 10.01, 0.25), 3.5
#: What is added to a pair's count and to the count that chance would give it.
PRIOR = 0.5
#: A collocation is repeated if it occurs so often in the page and at so many times its rate elsewhere; dominant, if it
#: also makes up this share of the page's pairs.
TIMES, LIFT, DOMINANT, DOMINANT_LIFT = 3, 100.0, 0.03, 300.0
#: Texts up to which a pair's counts in others are bounded, and by how much for each.
FEW, EACH = 6, 3
#: Share of a page's words in such lines that makes it spam, and the fewest words that a page is judged by.
SHARE, FEWEST = 0.5, 12

_WORD = re.compile(r"[^\W_]+|\x01")
_TAG = re.compile(r"""<(?:a\b[^<>]*?\bhref=["']?([^"'<>\s]*)[^<>]*|/?[a-z][^<>\n]*)>""")
#: Lines of code, tables, logs and headings: they have other pairs than sentences, and are no case.
_CODE = re.compile(
    r"^\s*(?:@|def |class |async |return\b|import |from \S+ import|(?:if|for|while|with|elif) .*:\s*$|else:|try:|except\b|raise\b|pass\s*$|assert\b)|^\s*[\w.\[\]]+\s*[-+*/|]?=\s*\S"
    r"|\w\([^()]*\)\s*[:;,]?\s*$|[;{}]\s*$|^\s*\|.*\|\s*$|^#+ |\d\d:\d\d:\d\d|^\s*(?:[-+]{3}|@@)"
)
_KEEP = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum() and c != "\x01"})
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Code of a line's end; words have higher ones.
_END = 1


def _tokens(text: str) -> list[str]:
    """Words in lower case, those of links too, markup aside, and \\x01 for a line's end."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    t = text.lower()
    if "<" in t:
        t = _TAG.sub(lambda m: f" {m[1] or ''} ", t)
    if "\x01" in t:
        t = t.replace("\x01", " ")
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = t.replace("\n", " \x01 ")
    return t.translate(_KEEP).split() if t.isascii() else _WORD.findall(t)


class _Codes(dict):
    """Numbers of words from 2, and their hashes by number, as many as are in use."""

    def __init__(self) -> None:
        self.start()

    def start(self) -> None:
        self.clear()
        self["\x01"] = _END
        self.hashes = [0, 0]

    def __missing__(self, word: str) -> int:
        self.hashes.append(int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
        self[word] = n = len(self.hashes) - 1
        return n


def _coded(texts: list[str], codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each token, index of the text of each, hashes by number); each text ends with a line's end."""
    if len(codes) > 2_000_000:
        codes.start()
    flat: list[int] = []
    ends = []
    for t in texts:
        flat += map(codes.__getitem__, _tokens(t))
        flat.append(_END)
        ends.append(len(flat))
    return np.array(flat, np.int32), np.repeat(np.arange(len(texts), dtype=np.int64), np.diff([0, *ends])), np.array(codes.hashes, np.uint64)


def _pairs(code: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of words followed by a word of their line, keys of these pairs)."""
    word = code > _END
    at = np.flatnonzero(word[:-1] & word[1:])
    with np.errstate(over="ignore"):
        left = (hashes * _FACTOR) ^ (hashes >> np.uint64(31))
        key = (left[code[at]] + hashes[code[at + 1]]) * _MIX
    return at, key ^ (key >> np.uint64(29))


def _sorted_runs(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of the runs of equal keys of one text in that order)."""
    with np.errstate(over="ignore"):
        both = (key ^ (doc.view(np.uint64) * _MIX)) * _FACTOR
    order = np.argsort(both)
    both = both[order]
    return order, np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, int)


def _chunks(most: int):
    """Adds the chunk of each text: texts of one partition that follow each other, of `most` bytes about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            ends = size + np.cumsum(pc.binary_length(b.column("text")).to_numpy().astype(np.int64))
            size = int(ends[-1]) if len(ends) else size
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + ends // most, pa.int64())], names=[*b.schema.names, "chunk"])

    return run


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Texts of one chunk at a time, as far as they follow each other."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        of = b.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and of[lo] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = of[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, key, n, texts) of words and pairs, and the number of all words as key 0 of words 1. Each of a text's copies
    counts for its share."""
    codes = _Codes()
    for t in _by_chunk(batches):
        chunk = t.column("chunk")[0].as_py()
        share = 1.0 / t.column("copies").to_numpy()
        code, doc, hashes = _coded(t.column("text").to_pylist(), codes)
        at, pair = _pairs(code, hashes)
        words = np.flatnonzero(code > _END)
        for key, of in ((hashes[code[words]], doc[words]), (pair, doc[at])):
            if not len(key):
                continue
            order, starts = _sorted_runs(key, of)
            n, key, of = np.diff(np.append(starts, len(key))), key[order[starts]], of[order[starts]]
            order = np.argsort(key)
            key, part = key[order], share[of[order]]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total = (np.add.reduceat(n[order] * part, first), np.add.reduceat(part, first))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), chunk)), pa.array(key[first].view(np.int64)), *(pa.array(x) for x in total), pa.array(np.zeros(len(first), np.int32))], names=["chunk", "key", "n", "texts", "words"])
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([0]), pa.array([float(share[doc[words]].sum())]), pa.array([2.0]), pa.array([1], pa.int32())], names=["chunk", "key", "n", "texts", "words"])


class _Table:
    """Corpus counts by key, and in how many texts; a key that isn't there occurs in one text only."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, texts: np.ndarray) -> None:
        order = np.argsort(keys)
        # one more, so that a search for any key stays within
        self.keys, self.n, self.texts = np.append(keys[order], np.iinfo(np.int64).max), np.append(n[order], 0), np.append(texts[order], 0)

    def get(self, key: np.ndarray) -> np.ndarray:
        key = key.view(np.int64)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.n[at], 0)

    def elsewhere(self, key: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Counts outside of texts that have own of each key. Of few other texts each counts at most EACH: a page that was
        taken over with small changes has all the pairs of the first one, as often."""
        key = key.view(np.int64)
        at = np.searchsorted(self.keys, key)
        there = self.keys[at] == key
        n, texts = np.where(there, self.n[at] - own, 0), self.texts[at]
        return np.maximum(np.where(texts <= FEW, np.minimum(n, EACH * (texts - 1)), n), 0)


def score(texts: list[str], table: _Table, total: int, codes: _Codes) -> tuple[np.ndarray, ...]:
    """Of each text: (words, words in lines of dominant collocations, mean information of its pairs, words in lines of repeated
    collocations by bin of information, words in other lines of LINE words or more, or short ones together, by bin, code and the
    like aside), and for all texts together words in such lines by bin, of a line WEIGHT at most.

    A pair's information is taken from its counts outside of the page itself, so a page can't vouch for its own collocations by
    repeating them. It is the logarithm of its count by the count that chance would give it, PRIOR added to both: an unseen
    pair of rare words says nothing, an unseen one of common words says that they don't go together.
    """
    code, doc, hashes = _coded(texts, codes)
    line = np.concatenate([[0], np.cumsum(code == _END)[:-1]])
    lines = int(line[-1]) + 1 if len(line) else 0
    line_doc = doc[code == _END]
    word = np.flatnonzero(code > _END)
    words_in = np.bincount(line[word], minlength=lines)
    doc_words = np.bincount(doc[word], minlength=len(texts))
    at, key = _pairs(code, hashes)
    order, starts = _sorted_runs(key, doc[at])
    runs = np.diff(np.append(starts, len(key)))
    own, elsewhere = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    own[order] = np.repeat(runs, runs)
    elsewhere[order] = np.repeat(table.elsewhere(key[order[starts]], runs), runs)
    used = np.unique(code[word])
    known = np.zeros(len(hashes), np.int64)
    known[used] = table.get(hashes[used])
    mine = known[code]
    lone = word[mine[word] == 0]  # words of one text only
    order, starts = _sorted_runs(hashes[code[lone]], doc[lone])
    runs = np.diff(np.append(starts, len(lone)))
    mine[lone[order]] = np.repeat(runs, runs)
    chance = mine[at].astype(float) * mine[at + 1] / max(total, 1)
    bits = np.log2((elsewhere + PRIOR) / (chance + PRIOR))
    # short lines that follow each other are judged together, as lists have a few words a line
    short = words_in < LINE
    run = np.cumsum(np.concatenate([[True], ~(short[1:] & short[:-1]) | (line_doc[1:] != line_doc[:-1])])) - 1 if lines else np.zeros(0, int)
    pairs = np.bincount(run[line[at]], minlength=lines)
    pmi = (np.bincount(run[line[at]], bits, minlength=lines) / np.maximum(pairs, 1))[run]
    long = (np.bincount(run, words_in, minlength=lines) >= LINE)[run] & (pairs > 0)[run]
    lift = own / np.maximum(doc_words[doc[at]], 1) * max(total, 1)
    again = (own >= TIMES) & (lift > LIFT * elsewhere)
    heavy = (own >= TIMES + 1) & (own >= DOMINANT * doc_words[doc[at]]) & (lift > DOMINANT_LIFT * elsewhere)

    def covered(which: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(code), bool)
        hit[at[which]] = True
        hit[at[which] + 1] = True
        return np.bincount(line[hit], minlength=lines) / np.maximum(words_in, 1)

    stuffed = (covered(heavy) >= 0.4) & (words_in >= 3)
    repeated = ~stuffed & (covered(again) >= 0.5) & (words_in >= 2)
    plain = ~stuffed & ~repeated & long & (pmi < MOST_BITS)
    first = np.searchsorted(line_doc, np.arange(len(texts)))
    for d in np.unique(line_doc[plain]).tolist():
        kept = re.split(r"\r\n|\r|\n", texts[d])
        for i in (first[d] + np.flatnonzero(plain[first[d] : first[d] + len(kept)])).tolist():
            plain[i] = not _CODE.search(kept[i - first[d]])
    bins = len(BINS) - 1
    bin_ = np.clip(np.searchsorted(BINS, pmi, side="right") - 1, 0, bins - 1)
    by = lambda m: np.bincount(line_doc[m] * bins + bin_[m], words_in[m], minlength=len(texts) * bins).reshape(len(texts), bins).astype(np.int32)
    spread = np.bincount(doc[at], bits, minlength=len(texts)) / np.maximum(np.bincount(doc[at], minlength=len(texts)), 1)
    return doc_words.astype(np.int64), np.bincount(line_doc[stuffed], words_in[stuffed], minlength=len(texts)).astype(np.int64), spread, by(repeated), by(plain), np.bincount(bin_[long], np.minimum(words_in[long], WEIGHT), minlength=bins)


def cuts(words: np.ndarray) -> tuple[int, int]:
    """(bins below the valley, bins below the split) of words by bin of their line's information: the split divides them into two
    classes that differ least within (Otsu), and the valley is the bin with the fewest words between the classes' means."""
    middle = (BINS[:-1] + BINS[1:]) / 2
    w, m = np.cumsum(words), np.cumsum(words * middle)
    if not len(w) or w[-1] <= 0:
        return 0, 0
    between = (m[-1] * w / w[-1] - m) ** 2 / np.maximum(w * (w[-1] - w), 1e-9)
    split = int(np.argmax(between[:-1]))
    low, high = m[split] / max(w[split], 1e-9), (m[-1] - m[split]) / max(w[-1] - w[split], 1e-9)
    smooth, inside = np.convolve(words, np.ones(3) / 3, "same"), np.flatnonzero((middle > low) & (middle < high))
    valley = int(inside[np.argmin(smooth[inside])]) if len(inside) else split
    most = int(np.searchsorted(BINS, MOST_BITS))
    return min(valley + 1, most), min(max(split, valley) + 1, most)


_SCORED = ["doc_id", "words", "stuffed", "pmi", "repeated", "plain", "lines"]


def _scored(uri: str, total: int):
    """A chunk's texts with the corpus counts of its own words and pairs, which are next to each other below the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = _Codes(), dataset(uri)
        for t in _by_chunk(batches):
            k = counts.to_table(columns=["key", "n", "texts"], filter=pc.field("chunk") == t.column("chunk")[0].as_py(), use_threads=False)
            key, at = np.unique(k.column("key").to_numpy(), return_index=True)
            table = _Table(key, *(k.column(c).to_numpy()[at] for c in ("n", "texts")))
            words, stuffed, pmi, repeated, plain, all_ = score(t.column("text").to_pylist(), table, total, codes)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(BINS) - 1).cast(pa.list_(pa.int32())) for x in (repeated, plain)]
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(words), pa.array(stuffed), pa.array(pmi), *lists, pa.nulls(len(words), pa.list_(pa.int64()))], names=_SCORED)
            none = [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array([all_.astype(np.int64)], pa.list_(pa.int64()))], names=_SCORED)

    return run


def spam_pages(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, words, spam_words, pmi, is_spam) of every page with a text.

    Words and pairs of neighbours within a line are counted over all texts of the corpus, exact copies once (each for its
    share), as else the pairs of a much copied page would look like language. A page is read line by line: lines whose pairs carry
    little information are word salads, keyword and link lists or product tags, and lines of pairs that the page has far more
    often than the corpus are stuffed. What is little is told by the corpus: its lines' information has two peaks, and the
    valley between them divides (`cuts`). Lines of code, tables, logs and headings are then taken out by a check of their form.
    A page is spam if most of its words are in lines that are left; pages of a few words never are. pmi is the page's mean
    information, in bits. In a corpus of one kind of lines only the division is arbitrary.

    Texts are written in chunks of a bounded size (a longer text is a chunk of its own). A chunk's words and pairs are added
    up before they are moved; the corpus counts of those that occur in two texts or more (others have no count outside of
    their page) are joined back to the chunks that hold them, and a task reads just its chunk's. Nothing is broadcast but
    the digests of repeated texts, if they are few (checked). Null and empty texts are left out; repeated rows are judged
    each; a null doc_id stays null.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5("text")).alias("way")).where("length(text) > 0")
    copied = cut(docs.groupBy("way").agg(F.count("*").alias("copies")).where("copies > 1"), "copied")
    own = docs.join(small(copied), "way", "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"))
    own = cut(own.mapInArrow(_chunks(chunk_bytes), "doc_id long, text string, copies long, chunk long"), "texts")
    keys = cut(own.select("text", "copies", "chunk").mapInArrow(_count, "chunk long, key long, n double, texts double, words int"), "keys")
    total = int(round(keys.where("words = 1").agg(F.sum("n")).first()[0] or 0))
    keys = keys.where("words = 0")
    counts = keys.groupBy("key").agg(F.round(F.sum("n")).cast("long").alias("n"), F.round(F.sum("texts")).cast("long").alias("texts")).where("texts > 1")
    held = keys.select("chunk", "key").join(counts, "key").repartition(partitions(spark), "chunk").sortWithinPartitions("chunk")
    path = qualified(spark, f"{shared_dir(spark)}/revsift-chunk-counts-{uuid4().hex}")
    held.write.parquet(path)
    kinds = "doc_id long, words long, stuffed long, pmi double, repeated array<int>, plain array<int>, lines array<long>"
    scored = cut(own.select("doc_id", "text", "chunk").mapInArrow(_scored(path, total), kinds), "scored")
    words = np.zeros(len(BINS) - 1)
    for r in scored.where("lines is not null").select(F.posexplode("lines").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row for each bin
        words[r["i"]] = r["n"]
    valley, split = cuts(words)
    below = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0).cast("long"), lambda t, v: t + v)
    spam = F.col("stuffed") + below("repeated", split) + below("plain", valley)
    scored = scored.where("words is not null").select("doc_id", "words", spam.alias("spam_words"), "pmi")
    return scored.withColumn("is_spam", (F.col("words") >= FEWEST) & (F.col("spam_words") > SHARE * F.col("words")))
