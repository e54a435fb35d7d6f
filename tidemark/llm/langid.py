"""Language identification by mixture inference.

Each learned language has a distribution over hashed character trigrams. A document is a mixture of them:
expectation-maximisation finds the proportions, and the set of languages is the one whose log-likelihood,
less ``PENALTY`` x log(trigrams) for each language beyond the first, is highest.

Training counts every row that it is given, in one pass: tasks send one row per language and bucket, so
what is shuffled is bounded by tasks x languages x 2**BITS. The model (languages x 2**BITS floats) goes to
the executors with the function.

Defined cases: null text, empty text and text without a letter give ``und`` and score 0; rows without a
language or text are not learned from; with nothing to learn from every document is ``und``. Repeated rows
count as often as they occur. Equal proportions go to the language whose name sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 13
#: Steps of expectation-maximisation over all languages, and then over each tried set.
STEPS, SET_STEPS = 8, 15
#: Languages of a smaller share after the first steps are not tried.
LEAST_SHARE = 0.05
#: For each language beyond the first, times the logarithm of the number of trigrams. Overlapping trigrams
#: repeat evidence, so this is above the 0.5 of independent observations.
PENALTY = 3.0
RESULT = "struct<lang:string,score:double,languages:string>"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's trigrams with a letter in the middle; all else reads as a blank."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    alpha = letters()[codes]
    codes = codes * alpha
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    mixed *= np.uint32(0x27D4EB2F)
    mixed >>= np.uint32(32 - BITS)
    counts = np.bincount(mixed[alpha[1:-1]], minlength=1 << BITS)
    found = counts.nonzero()[0]
    return found, counts[found]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Learn from all rows of ``docs`` that have both: the languages in order, and probabilities[bucket, language]."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, counts in sums.items():
                found = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(counts[found])], ["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for name, value in zip(common.strings(batch.column(0)), common.strings(batch.column(1)), strict=True):
                found, n = trigrams(value)
                if len(found):
                    sums.setdefault(name, np.zeros(1 << BITS, np.int64))[found] += n
                    if len(sums) > 64:
                        yield from out()
        yield from out()

    rows = docs.select(F.col(lang).cast("string"), F.col(text).cast("string")).toDF("lang", "text").where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((1 << BITS, len(names)), 0.5)
    place = {name: i for i, name in enumerate(names)}
    of = np.array([place[x] for x in counts.column("lang").to_pylist()], np.int64)
    if names:
        np.add.at(table, (counts.column("bucket").to_numpy(), of), counts.column("n").to_numpy())
        table /= table.sum(axis=0)
    return names, table.astype(np.float32)


def proportions(likely: np.ndarray, counts: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """EM for the shares of one document's languages, and its log-likelihood. likely[trigram, language]."""
    share, size = start, counts.sum()
    for _ in range(steps):
        new = share * (likely.T @ (counts / np.maximum(likely @ share, 1e-30))) / size
        moved, share = np.abs(new - share).max(), new
        if moved < 1e-3:
            break
    return share, float(counts @ np.log(np.maximum(likely @ share, 1e-30)))


def choose(likely: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The shares of one document under the set of languages of the highest penalised likelihood."""
    order = [k for k in np.argsort(-shares, kind="stable") if shares[k] >= LEAST_SHARE] or [int(np.argmax(shares))]
    best, most = shares, -np.inf
    for n in range(1, len(order) + 1):
        start = np.zeros(len(shares), np.float32)
        start[order[:n]] = 1 / n
        found, value = proportions(likely, counts, start, SET_STEPS if n > 1 else 1)
        value -= PENALTY * (n - 1) * np.log(counts.sum() + 1)
        if value <= most:
            break
        best, most = found, value
    return best


def infer(names: list[str], table: np.ndarray, text: str | None) -> tuple[str, float, str]:
    """(language, its share, all languages of the chosen set, comma-joined) of a text."""
    found, counts = trigrams(text) if names else ((), ())
    if not len(found):
        return "und", 0.0, ""
    likely, counts = table[found], counts.astype(np.float32)
    share, _ = proportions(likely, counts, np.full(len(names), 1 / len(names), np.float32), STEPS)
    if (share >= LEAST_SHARE).sum() > 1:
        share = choose(likely, counts, share)
    top = int(np.argmax(share))
    return names[top], float(min(1.0, share[top] / max(share.sum(), 1e-30))), ",".join(x for x, s in zip(names, share, strict=True) if s >= LEAST_SHARE)


def identify(model: tuple[list[str], np.ndarray], text: Column) -> Column:
    """Column of ``RESULT`` for a text column; ``score`` is the share of the predicted language."""
    names, table = model

    @F.arrow_udf(RESULT)
    def language(column: pa.Array) -> pa.Array:
        rows = [infer(names, table, x) for x in common.strings(column)]
        return pa.array([dict(zip(("lang", "score", "languages"), x, strict=True)) for x in rows], pa.struct([("lang", pa.string()), ("score", pa.float64()), ("languages", pa.string())]))

    return language(text)


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~common.held_out(F.col("doc_id"))))
    got = docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), identify(model, F.col("text")).alias("found"))
    return got.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.languages").alias("languages"))


#: Documents whose main language has a smaller share are rejected by the stage.
STAGE_SHARE = 0.5


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a main language: not ``und``, and a share of ``STAGE_SHARE`` or more; with all their columns.

    Null and empty texts and those without a letter go. Repeated rows and rows of one id go by their own text; rows
    without an id are learned from. A text is held whole by one task. Empty tables give empty tables; where there is
    nothing to learn from, nothing has a language.
    """
    model = fit(docs.where(~common.held_out(F.col("doc_id"))))
    tag = "__tidemark_language"
    return docs.withColumn(tag, identify(model, F.col("text"))).where((F.col(f"{tag}.lang") != "und") & (F.col(f"{tag}.score") >= STAGE_SHARE)).drop(tag)
