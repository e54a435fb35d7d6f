"""Benchmark decontamination by greedy string tiling.

Words of documents and of benchmark items become numbers; Karp-Rabin hashes of ``LEAST`` (5) words are the
seeds that a document must share with an item. For each such pair, running Karp-Rabin matching marks longest
matches first, none overlapping another in the document or the item, down to ``LEAST`` words. The share of the
item's words under tiles is its coverage, whatever the order of the tiles, so reordered passages are found.
From ``COVERAGE`` on, the document is contaminated by the item.

The benchmark is a stated set: its words and seeds go to the executors in blocks of at most ``BLOCK_CHARS``
characters (its size is asked for first), and all documents meet each block once; of several blocks each one's
results are written before the next is read, so the driver holds one. Documents are never shuffled,
and a document's work is bounded by its own length and the items whose seeds it holds.

Defined cases: null and empty texts share nothing, and items without a word are not found. An item of fewer than
``LEAST`` words is found where all of it stands in one piece; the pipeline's stage leaves such items out, as they
can't be told from chance. Repeated documents give repeated rows; repeated items with one id give one row, the
highest coverage. Items without an id are searched, and reported with a null id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST, COVERAGE, FIRST = 5, 0.5, 20
#: Characters of benchmark text on one executor at a time.
BLOCK_CHARS = 16_000_000
RESULT = "array<struct<item_id:long,n_tiles:int,covered:int,item_words:int,coverage:double>>"
_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("n_tiles", pa.int32()), ("covered", pa.int32()), ("item_words", pa.int32()), ("coverage", pa.float64())]))

#: ASCII that is neither letter nor digit separates words.
_SPACES = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()


def hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2**64, of each window of ``width`` numbers."""
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * _BASE + ids[k : k + n]
    return out


def rolling(ids: list[int], free: list[bool], width: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of each window of ``width`` unmarked numbers, by rolling the hash on."""
    base, mask, drop, h, n = int(_BASE), (1 << 64) - 1, pow(int(_BASE), width, 1 << 64), 0, 0
    for i, x in enumerate(ids):
        if not free[i]:
            h = n = 0
            continue
        h, n = (h * base + x) & mask, n + 1
        if n > width:
            h = (h - ids[i - width] * drop) & mask
        if n >= width:
            yield i - width + 1, h


def tile(doc: list[int], item: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, length), by running Karp-Rabin. Numbers below 1 match nothing."""
    free_d, free_i = [x > 0 for x in doc], [x > 0 for x in item]
    out: list[tuple[int, int, int]] = []
    width = max(least, FIRST)
    while True:
        where: dict[int, list[int]] = defaultdict(list)
        for at, h in rolling(doc, free_d, width):
            where[h].append(at)
        found = []
        for j, h in rolling(item, free_i, width):
            for i in where.get(h, ()):
                if i and j and doc[i - 1] == item[j - 1] and free_d[i - 1] and free_i[j - 1]:
                    continue  # part of a match that began before
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n >= width:
                    found.append((-n, i, j))
        longest = -min(found)[0] if found else 0
        if longest > 2 * width:
            width = longest
            continue
        queue = defaultdict(list)
        for n, i, j in found:
            queue[-n].append((i, j))
        for n in range(longest, width - 1, -1):
            for i, j in sorted(queue.pop(n, ())):
                start = None
                for k in range(n + 1):  # what is still unmarked of the match
                    open_ = k < n and free_d[i + k] and free_i[j + k]
                    if open_ and start is None:
                        start = k
                    elif not open_ and start is not None:
                        if k - start == n:
                            out.append((i, j, n))
                            free_d[i : i + n] = free_i[j : j + n] = [False] * n
                        elif k - start >= width:
                            queue[k - start].append((i + start, j + start))
                        start = None
        if width <= least:
            return out
        width = max(least, width // 2)


class Index:
    """Words and seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int = LEAST, short: bool = True) -> None:
        """``short``: also items of fewer than ``least`` words, whole."""
        self.least, self.ids, self.items, self.number = least, [], [], {}
        self.short: dict[tuple[int, ...], list[int | None]] = defaultdict(list)
        seeds, owners = [], []
        for item_id, text in items:
            found = words(text)
            if len(found) < least:
                if found and short:
                    self.short[tuple(self.number.setdefault(w, len(self.number) + 1) for w in found)].append(item_id)
                continue
            line = [self.number.setdefault(w, len(self.number) + 1) for w in found]
            h = np.unique(hashes(np.array(line, np.uint64), least))
            seeds.append(h)
            owners.append(np.full(len(h), len(self.items)))
            self.ids.append(item_id)
            self.items.append(line)
        seeds = np.concatenate([np.zeros(0, np.uint64), *seeds])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners = seeds[order], np.concatenate([np.zeros(0, np.int64), *owners])[order]

    def match(self, text: str | None, coverage: float = COVERAGE) -> list[dict]:
        get = self.number.get
        ids = np.array([get(w, 0) for w in words(text)], np.uint64)
        best: dict[int | None, dict] = {}
        self._match(ids, coverage, best)
        if self.short:
            line = ids.tolist()
            for width in {len(x) for x in self.short}:
                for x in {tuple(line[i : i + width]) for i in range(len(line) - width + 1)} & self.short.keys():
                    best |= {i: {"item_id": i, "n_tiles": 1, "covered": width, "item_words": width, "coverage": 1.0} for i in self.short[x] if best.get(i, {"coverage": 0})["coverage"] < 1}
        return [best[k] for k in sorted(best, key=lambda x: (x is None, x or 0))]

    def _match(self, ids: np.ndarray, coverage: float, best: dict[int | None, dict]) -> None:
        """Items of ``least`` words or more."""
        if len(ids) < self.least or not len(self.seeds):
            return
        known = np.convolve(ids == 0, np.ones(self.least, np.int64), "valid") == 0
        at = np.flatnonzero(known)
        if not len(at):
            return
        h = hashes(ids, self.least)[at]
        lo, hi = np.searchsorted(self.seeds, h), np.searchsorted(self.seeds, h, "right")
        hit = hi > lo
        if not hit.any():
            return
        at, lo, hi = at[hit], lo[hit], hi[hit]
        owner = np.concatenate([self.owners[a:b] for a, b in zip(lo, hi, strict=True)])
        start = np.repeat(at, hi - lo)
        for item in np.unique(owner):
            line = self.items[item]
            mine = np.zeros(len(ids) + 1, np.int64)
            np.add.at(mine, start[owner == item], 1)
            np.add.at(mine, start[owner == item] + self.least, -1)
            under = np.cumsum(mine[:-1]) > 0
            # only words under a seed can be under a tile; -1 parts what isn't next to each other
            place = np.flatnonzero(under)
            if len(np.intersect1d(ids[place], np.array(line, np.uint64))) == 0:
                continue
            part: list[int] = []
            for k, p in enumerate(place.tolist()):
                if k and p != place[k - 1] + 1:
                    part.append(-1)
                part.append(int(ids[p]))
            tiles = tile(part, line, self.least)
            covered = sum(n for *_, n in tiles)
            if covered >= coverage * len(line) and covered > best.get(self.ids[item], {"covered": -1})["covered"]:
                best[self.ids[item]] = {"item_id": self.ids[item], "n_tiles": len(tiles), "covered": covered, "item_words": len(line), "coverage": covered / len(line)}


def matcher(index: Index, text: Column, coverage: float = COVERAGE) -> Column:
    """Column of ``RESULT``: the items of a block that contaminate a text."""

    @F.arrow_udf(RESULT)
    def tiled(column: pa.Array) -> pa.Array:
        return pa.array([index.match(x, coverage) for x in common.strings(column)], _TYPE)

    return tiled(text)


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", short: bool = True) -> Iterator[tuple[Index, bool]]:
    """The benchmark in blocks of a bounded number of characters, dealt by a hash of ids; and whether there are several."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // BLOCK_CHARS) or 1
    for k in range(parts):
        block = rows.where(F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.col("text"))), F.lit(parts)) == k) if parts > 1 else rows
        yield Index([tuple(x) for x in block.collect()], short=short), parts > 1


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, n_tiles, covered, item_words, coverage): documents and items from ``COVERAGE`` on."""
    out = None
    for index, several in blocks(benchmark):
        found = docs.select(F.col(doc_id).alias("doc_id"), matcher(index, F.col(text).cast("string")).alias("m")).select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")
        found = common.cut(found) if several else found
        out = found if out is None else out.unionByName(found)
    return out


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents, with the benchmark items that they hold."""
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; all others keep all their columns.

    Null and empty texts stay. Repeated rows and rows of one id go by their own text. A text is held whole by one task.
    Items of under ``LEAST`` words are not looked for. Empty tables give empty tables.
    """
    for index, several in blocks(common.table(spark, sf_dir, "benchmark"), short=False):
        docs = docs.where(F.size(matcher(index, F.col("text").cast("string"))) == 0)
        docs = common.cut(docs) if several else docs
    return docs
