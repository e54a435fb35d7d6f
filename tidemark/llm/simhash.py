"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits, each the majority over a text's word shingles. Fingerprints link at ``DISTANCE`` (2)
or fewer differing bits. Cut in two halves, at least one half of a linked pair differs by at most one bit; so
every fingerprint is indexed, for each half and each of its 32 bits, under that half with that one bit blanked.
Linked fingerprints meet under an equal key, and are verified on all bits.

Only distinct fingerprints are indexed: copies cost one row. The index is dealt out by key, sorted within
partitions and read as a stream; a key's run is compared in memory in blocks if it has at most ``RUN`` rows, and
gives a spanning forest of its links rather than all pairs. Longer runs go on, whole, to an exact second way:
under such a key only the blanked bit and the other half can differ, so each fingerprint is keyed once more for
each pair of these 33 bits with both blanked (528 keys); all under one such key link with each other, and a
link to the smallest stands for all. Both ways keep every connection, so components are exact.

Defined cases: a null, empty or blank text has the fingerprint 0, linked like any other; fewer words than a
shingle are one shingle. Rows without an id have a fingerprint, take part in links, and never name a component
(a component of such rows alone has none). Repeated rows are one node and come out as often as they went in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, DISTANCE, SEED, RUN = 3, 2, 42, 4096
#: White space of the contract, all of it one byte in UTF-8.
BLANKS = b" \t\n\v\f\r"


def shingle_hashes(text: str | None, width: int = WORDS) -> np.ndarray:
    """XXH64 (seed ``SEED``) of each run of ``width`` words, with A-Z lower-cased and one blank between words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: splits at BLANKS alone, lowers A-Z alone
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - width + 1].tolist()
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit number: a bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, width: int = WORDS) -> Column:
    """Long column: the SimHash of a text column."""

    @F.arrow_udf("long")
    def simhash(column: pa.Array) -> pa.Array:
        return pa.array([majority(shingle_hashes(x, width)) for x in common.strings(column)], pa.int64())

    return simhash(text)


def variants(fps: np.ndarray) -> np.ndarray:
    """keys[fingerprint, 64]: for each bit, its half with that bit blanked, and which half and bit it is."""
    bits = np.arange(64, dtype=np.uint64)
    half = (fps[:, None] >> (bits & np.uint64(32))) & np.uint64(0xFFFFFFFF)
    return (half & ~(np.uint64(1) << (bits & np.uint64(31)))) | (bits << np.uint64(32))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the given distinct fingerprints as all links within ``DISTANCE`` do."""
    left, out = np.arange(len(fps)), []
    while len(left):  # breadth first: what is reached leaves the rest, so each meets each reached one once at most
        reach, left = left[:1], left[1:]
        while len(reach) and len(left):
            near = np.bitwise_count(fps[reach[:256], None] ^ fps[None, left]) <= DISTANCE
            hit = near.any(axis=0)
            out += zip(fps[reach[near.argmax(axis=0)[hit]]].view(np.int64).tolist(), fps[left[hit]].view(np.int64).tolist(), strict=True)
            reach, left = np.concatenate([reach[256:], left[hit]]), left[~hit]
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, 4096):
            fps = part.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(variants(fps).ravel().view(np.int64)), pa.array(np.repeat(fps, 64).view(np.int64))], ["key", "fp"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b): links; b null for a row of a run that is too long here. Reads rows in order of key."""
    keys, fps, sent = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

    def rows(key: list, a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"])

    def passed(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64)), pa.nulls(len(keys), pa.int64())], ["key", "a", "b"])

    def whole(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        out: list[tuple[int, int]] = []
        two = starts[sizes == 2]  # most runs: no loop for them
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= DISTANCE] if len(two) else two
        if len(near):
            yield rows(keys[near].tolist(), fps[near].view(np.int64).tolist(), fps[near + 1].view(np.int64).tolist())
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if n > RUN:
                yield passed(keys[at : at + n], fps[at : at + n])
            else:
                out += forest(fps[at : at + n])
        if out:
            yield rows([0] * len(out), [a for a, _ in out], [b for _, b in out])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        more = int(np.searchsorted(keys, sent, "right")) if sent is not None else 0
        if more:  # the rest of a long run, whatever its size
            yield passed(keys[:more], fps[:more])
            keys, fps = keys[more:], fps[more:]
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if last:
            yield from whole(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
        if len(keys) > RUN:  # the open run is long already: it need not be held
            yield passed(keys, fps)
            sent, keys, fps = keys[0], keys[:0], fps[:0]
    if len(keys):
        yield from whole(keys, fps)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a long run under its key, with each two of the 33 bits blanked that can differ there."""
    for batch in batches:
        for key, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64), strict=True):
            bit = key >> 32
            free = np.array([bit, *(range(32) if bit >= 32 else range(32, 64))], np.uint64)
            i, j = np.triu_indices(33, 1)
            hub = fp & ~(np.uint64(1) << free[i]) & ~(np.uint64(1) << free[j])
            yield pa.RecordBatch.from_arrays([pa.array(hub.view(np.int64)), pa.array((free[i] * np.uint64(64) + free[j]).astype(np.int32)), pa.array(np.full(len(i), fp).view(np.int64))], ["hub", "bits", "fp"])


def links(fps: DataFrame, column: str = "fp", tables: common.Tables | None = None) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints just as all pairs within ``DISTANCE`` bits do. Reads one of ``tables``."""
    tables = tables or common.Tables(fps.sparkSession)
    index = fps.select(F.col(column).cast("long").alias("fp")).distinct().mapInArrow(_index, "key long, fp long")
    found = tables.cut(index.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "key long, a long, b long").distinct())
    stars = found.where("b is null").mapInArrow(_stars, "hub long, bits int, fp long")
    least = stars.groupBy("hub", "bits").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").drop("z")
    rest = stars.join(least, ["hub", "bits"]).select("a", F.col("fp").alias("b")).where("a <> b")
    return found.where("b is not null").select("a", "b").unionByName(rest).distinct()


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of ``docs``. Other columns of ``docs`` are not read."""
    rows = common.cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text).cast("string"), width).alias("fp")))
    one = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = common.components(links(one.select("fp")))
    # the least id of each component of fingerprints; those without a link are components by themselves
    at = one.join(labels, one.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    ids = at.groupBy("label").agg(F.min("least").alias("component_id"))
    named = at.join(ids, "label").select(F.col("fp").alias("of"), "component_id")
    return rows.join(named, rows.fp == named.of).select("doc_id", "fp", "component_id")


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = cluster(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
