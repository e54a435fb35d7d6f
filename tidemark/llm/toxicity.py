"""Toxicity of noisy text: noisy-channel deobfuscation, then a score of the restored text.

Words written to evade a filter become character lattices: a digit or sign may stand for letters, a run of one
letter for one or two, and letters spelled one by one join to words. A Viterbi search finds the reading that is
likeliest under a trigram model of characters and the channel's costs. Only words that the channel can have
made have more than one reading, so only they are searched. Raw and restored words are scored together. Signs at
the ends of a word may be punctuation or letters: such a text is read without them, with all of them, and with those
that the search keeps, and the highest score counts.

The character model counts every trigram of every text. The features of labelled documents (words under 4
characters, and the first 4 to 7 characters of others, by whether one word has them or more) are counted by label
in how many documents they occur; a feature's weight is the lower end of the Wilson interval (``Z``) for the share
of toxic ones among documents that have it, so that rare features need no separate cut. A text's score is its
highest weight, and the base rate at least. Copies would make each word of a toxic text look toxic; so of labelled texts whose least
shingle hash is the same one counts, and documents that have a feature of the highest weights are left out when
the other features are counted, in a second pass over labelled documents. Counts are pre-aggregated in each task. The model that goes to the executors is 2**18
floats and all features of a weight of ``LEAST`` or more; over ``MOST_FEATURES`` of them are reported.

Defined cases: null and empty texts get the base rate (at most ``MOST_BASE``). Labels that are null are not
learned from; with several labels for an id the document counts as toxic if one says so. Without labels, all
score 0. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import logging
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .langid import letters
from .simhash import shingle_hashes

#: What signs may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Cost of reading a sign as a letter, of a blank kept between spelled letters, (a gain) of a doubled letter, and of leaving out a sign at an end.
SIGN_COST, BLANK_COST, DOUBLE_COST, END_COST = 0.5, 1.0, -2.0, 3.0
Z, LEAST, MOST_BASE, THRESHOLD = 3.5, 0.15, 0.2, 0.3
#: Features of this share of the highest weight explain their documents, which then say nothing of others.
STRONG = 0.8
#: A classifier of more features is reported, as driver and executors hold it.
MOST_FEATURES = 200_000
PREFIXES = (4, 5, 6, 7)
#: Label rows up to this number are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_LABELS = 2_000_000
#: Features that a task holds before it sends them on.
HELD = 150_000

_EDGE = string.punctuation + "…“”„«»¿–—·•"
#: Signs at the ends of words that are never letters.
_PLAIN = "".join(c for c in _EDGE if c not in SIGNS)
_RUN = re.compile(r"([^\W\d_])\1\1+")
_CLASSES = 64
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """For each code point: 0 if no letter, 1 to 26 for a to z, else one of 37 classes by rule."""
    global _classes
    if _classes is None:
        codes = np.arange(0x110000)
        _classes = np.where(letters(), 27 + codes % 37, 0).astype(np.int32)
        _classes[97:123] = np.arange(1, 27)
    return _classes


def of(char: str) -> int:
    return int(classes()[ord(char)])


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of class trigrams over lower-cased texts, each between blanks; places with no letter but the first count not."""
    line = "  ".join(x.lower() for x in texts if x)
    c = classes()[np.frombuffer(f"  {line}  ".encode("utf-32-le", "replace"), np.uint32)]
    key = (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:]
    return np.bincount(key[(c[1:-1] > 0) | (c[2:] > 0)], minlength=_CLASSES**3)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), trigrams interpolated with bigrams and single characters."""
    tri = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype(np.float64)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    part = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1)
    return np.log(0.8 * part(tri) + 0.15 * part(bi)[None] + 0.05 * (0.99 * part(uni) + 0.01 / _CLASSES)[None, None]).astype(np.float32)


def lattice(word: str, spelled: bool = False, loose: bool = False) -> list[list[tuple[str, float]]]:
    """For each place of an obfuscated word, what it may stand for, and the cost; ``loose``: signs at its ends may be left out."""
    out: list[list[tuple[str, float]]] = []
    at = 0
    first, last = (len(word) - len(word.lstrip(_EDGE)), len(word.rstrip(_EDGE))) if loose else (0, len(word))
    while at < len(word):
        c, n = word[at], 1
        while at + n < len(word) and word[at + n] == c:
            n += 1
        at += n
        if c in SIGNS:
            out.append([(x * k, SIGN_COST * n + DOUBLE_COST * (k > 1) * (n > 2)) for x in SIGNS[c] for k in ((n,) if n < 3 else (1, 2))])
            if at <= first or at > last:
                out[-1].append(("", END_COST))
        elif not c.isalpha():
            out.append([("", 0.0), (" ", BLANK_COST)] if spelled or c.isspace() else [("", 0.0)])
        else:
            out.append([(c * n, 0.0)] if n < 3 else [(c, 0.0), (c * 2, DOUBLE_COST)])
    return out


def viterbi(places: list[list[tuple[str, float]]], lm: np.ndarray) -> str:
    """The likeliest reading of a lattice; of equal ones, the first in order of code points."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in [*places, [(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, said) in states.items():
            for what, price in options:
                x, y, total = a, b, cost + price
                for c in what:
                    z = of(c)
                    total -= float(lm[x, y, z])
                    x, y = y, z
                here = (total, said + what)
                if (x, y) not in new or here < new[x, y]:
                    new[x, y] = here
        states = new
    return min(states.values())[1].strip()


def bare(word: str) -> str:
    return word if word.isalpha() else word.strip(_EDGE)


def ended(word: str) -> str | None:
    """The word with the signs at its ends that may be letters, if it has such signs and a letter."""
    if word.isalpha():
        return None
    out = word.strip(_PLAIN)
    return out if out and (out[0] in _EDGE or out[-1] in _EDGE) and any(map(str.isalpha, out)) else None


def suspects(low: str, tokens: list[str]) -> Iterator[tuple[str, bool, bool]]:
    """Words of a lower-cased text that the channel can have made, whatever signs at their ends are.

    (word, whether spelled letter by letter, whether of a word with signs at its ends that may be letters)
    """
    codes = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
    runs = bool(len(codes) > 2 and ((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]) & letters()[codes[2:]]).any())
    for w in set(tokens):
        if w.isalpha():
            if runs and len(w) > 2 and _RUN.search(w):
                yield w, False, False
        else:
            inner = bare(w)
            if not inner.isalpha() and any(map(str.isalpha, inner)) or runs and _RUN.search(inner):
                yield inner, False, ended(w) is not None
    single = [len(w) == 1 or len(w) == 2 and not w.isalnum() for w in tokens]
    start = None
    for i, one in enumerate([*single, False]):
        if one and start is None:
            start = i
        elif not one and start is not None:
            if i - start >= 3:
                yield " ".join(tokens[start:i]), True, False
            start = None


class Reader:
    """Restores words, and keeps what it has restored while that is little."""

    def __init__(self, lm: np.ndarray) -> None:
        self.lm, self.kept = lm, {}

    def restore(self, word: str, spelled: bool, loose: bool = False) -> str:
        found = self.kept.get((word, loose))
        if found is None:
            found = viterbi(lattice(word, spelled, loose), self.lm)
            if len(self.kept) > 50_000:
                self.kept.clear()
            if len(word) <= 64:
                self.kept[word, loose] = found
        return found

    def words(self, text: str | None) -> list[set[str]]:
        """Distinct words of a text, raw and restored, for each reading of signs at their ends.

        Without them, with all of them, and with those that the search keeps; only the first if no word has signs
        there that may be letters. A word has one form in each, so that its forms don't count as several words.
        """
        low = (text or "").lower()
        tokens = low.split()
        ends = {w: kept for w in set(tokens) if (kept := ended(w))}
        same, cut = set(map(bare, set(tokens) - ends.keys())), set(map(bare, ends))
        for word, spelled, of_end in suspects(low, tokens):
            (cut if of_end else same).update(self.restore(word, spelled).split())
        kept = [{x for w in ends.values() for x in self.restore(w, False, loose).split()} for loose in (False, True)] if ends else []
        return [same | x for x in (cut, *kept)]


def features(words: Iterable[str]) -> set[str]:
    """Words under 4 characters as they are; beginnings of the others, marked if two or more words share them.

    A beginning is either marked or not: what a single word says is told from documents with just one.
    """
    out = {f"={w}" for w in words if 0 < len(w) < PREFIXES[0]}
    for n in PREFIXES:
        once: set[str] = set()
        more: set[str] = set()
        for w in words:
            if len(w) >= n:
                start = w[:n]
                if start in once:
                    more.add(start)
                else:
                    once.add(start)
        out |= once - more
        out.update(f"{x}+" for x in more)
    return out


class Model:
    def __init__(self, lm: np.ndarray, weights: dict[str, float], base: float) -> None:
        self.lm, self.weights, self.base = lm, weights, base
        self.starts = {x[:4] for x in weights if x[0] != "="} | {x[1:] for x in weights if x[0] == "="}
        self.reader = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"reader": None}

    def score(self, text: str | None) -> float:
        if self.reader is None:
            self.reader = Reader(self.lm)
        starts = self.starts
        found: set[str] = set()
        for reading in self.reader.words(text) if starts else ():
            found |= features([w for w in reading if w[:4] in starts])
        return max(self.base, *(self.weights.get(x, 0.0) for x in found), 0.0)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn the character model from all rows, and weights from labelled rows that are not held out."""
    label = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).select(F.col("doc_id").alias("__of"), "toxic")
    near = F.broadcast if labels.count() <= BROADCAST_LABELS else lambda x: x
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    same = F.col("doc_id") == F.col("__of")
    learned = own.where(~common.held_out(F.col("doc_id"))).join(near(label), same).select("doc_id", "toxic", _least_shingle(F.col("text")).alias("sign"))
    one = common.cut(learned.groupBy("sign", "toxic").agg(F.min("doc_id").alias("__of")).select("__of", "toxic"))
    known = own.join(near(one), same, "left").select("text", "toxic")
    first, base, grams = _counted(known, None)
    lm = language_model(grams)
    strong = {k: w for k, w in first.items() if w >= STRONG * max(first.values())}
    rest, *_ = _counted(known.where("toxic is not null"), Model(lm, strong, 0.0))
    return Model(lm, strong | {k: w for k, w in rest.items() if k not in strong}, min(MOST_BASE, base))


def _least_shingle(text: Column) -> Column:
    """A sign that copies of a text share, and most near copies."""

    @F.arrow_udf("long")
    def least(column: pa.Array) -> pa.Array:
        return pa.array([int(h.min().view(np.int64)) if len(h := shingle_hashes(x, 5)) else 0 for x in common.strings(column)], pa.int64())

    return least(text)


def _counted(known: DataFrame, skip: Model | None) -> tuple[dict[str, float], float, np.ndarray]:
    """Weights, base rate and trigram counts of rows (text, toxic or null), but for labelled ones that ``skip`` has a feature of."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = np.zeros(_CLASSES**3, np.int64), {}

        def rows(keys: list, gram: np.ndarray, toxic: list, n: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(gram, pa.int32()), pa.array(toxic, pa.int64()), pa.array(n, pa.int64())], ["feature", "gram", "toxic", "n"])

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(sums)
            for at in range(0, len(keys), 10_000):
                part = keys[at : at + 10_000]
                yield rows(part, np.zeros(len(part), np.int32), [sums[k][0] for k in part], [sums[k][1] for k in part])
            sums.clear()

        for batch in batches:
            for part in common.slices(batch):
                texts = part.column(0).to_pylist()
                grams += trigram_counts(texts)
                for value, toxic in zip(texts, part.column(1).to_pylist(), strict=True):
                    if toxic is not None and not (skip and skip.score(value)):
                        for f in {"", *features(set(map(bare, set((value or "").lower().split()))))}:
                            if f in sums:
                                sums[f][0] += toxic
                                sums[f][1] += 1
                            else:
                                sums[f] = [int(toxic), 1]
                if len(sums) > HELD:
                    yield from out()
        yield from out()
        found = np.flatnonzero(grams)
        for at in range(0, len(found), 10_000):
            part = found[at : at + 10_000]
            yield rows([None] * len(part), part, [0] * len(part), grams[part].tolist())

    # features of fewer than two toxic documents have a weight under LEAST whatever else they are in
    counts = common.cut(known.mapInArrow(count, "feature string, gram int, toxic long, n long").groupBy("feature", "gram").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where("feature is null or feature = '' or toxic >= 2"))
    z = Z * Z
    p, n = F.col("toxic") / F.col("n"), F.col("n")
    low = (p + z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)
    weights = {x.feature: float(x.w) for x in counts.where("feature <> ''").select("feature", low.alias("w")).where(F.col("w") >= LEAST).collect()}
    if len(weights) > MOST_FEATURES:
        logging.getLogger(__name__).warning("%d features are kept, more than %d: the driver and each Python worker hold them", len(weights), MOST_FEATURES)
    base = counts.where("feature = ''").select(p).first()
    grams = np.zeros(_CLASSES**3, np.int64)
    got = counts.where("feature is null").select("gram", "n").toArrow()
    grams[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return weights, float(base[0]) if base else 0.0, grams


def toxicity(model: Model, text: Column) -> Column:
    """Double column: how likely a text is toxic, 0 to 1."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array([model.score(x) for x in common.strings(column)], pa.float64())

    return score(text)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from labels of those that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), toxicity(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is under ``THRESHOLD``, with all their columns.

    Null and empty texts have the base rate and stay. Repeated rows and rows of one id are each scored by their own
    text; labels go by id, so rows without one are scored but not learned from. A text is held whole by one task. Empty
    tables give empty tables, and without labels all documents stay.
    """
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(toxicity(model, F.col("text")) < THRESHOLD)
