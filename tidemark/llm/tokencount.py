"""Edit-aware token counts: a segment tree of pre-token blocks for each document.

A byte-pair encoder never joins characters across pre-tokens, so a text's count is the sum over its pre-tokens.
The leaves of a document's tree are blocks of whole pre-tokens of about ``BLOCK`` characters, inner nodes sum
characters and tokens. An edit finds its leaves by character sums, is written into them, and only these and one
leaf at either side (whose pre-tokens the edit may have changed) are encoded again; sums above are updated.

What an edit writes is cut into blocks again, so leaves stay near ``BLOCK`` characters; where there are more of them
than leaves that they take the place of, sums are made anew from the leaves', without encoding.

Blocks are cut before a single blank between two non-blanks: a pre-token starts there whatever stands before,
and that stays true for cuts that an edit and its neighbour leaves do not touch.

A tree is kept as the lengths and counts of its leaves (:func:`trees`, a column that can be written beside the text);
:func:`counts` goes on from it and encodes nothing but what edits touch.

The vocabulary's file is sent to executors by Spark where :func:`send` was called, else read from its folder.

Defined cases: null and empty texts count 0; edits are clipped to the text as it then is, and a null edit list
has none; a null edit does nothing, a null start or stop is 0, a null replacement deletes. Repeated rows are counted
each. A text without such a blank is one leaf. A text and its tree are held whole by one task. A tree that is null or
doesn't fit the text's length is made anew.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cache
from itertools import accumulate

import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 512
#: Folder of the tokenizer's files, and the file.
FOLDER, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EDITS = "array<struct<start:int,stop:int,text:string>>"
RESULT = "struct<before:long,after:long,edits:long,encoded:long,chars:long>"
_TYPE = pa.struct([(x, pa.int64()) for x in ("before", "after", "edits", "encoded", "chars")])

TREE = "array<struct<chars:int,tokens:int>>"
_LEAF = pa.struct([("chars", pa.int32()), ("tokens", pa.int32())])
_CUT = re.compile(r"(?<=\S) (?=\S)")


def send(spark: SparkSession, folder: str = FOLDER, ranks: str = RANKS) -> None:
    """Have Spark bring the vocabulary's file to every executor."""
    spark.sparkContext.addFile(f"{folder}/{ranks}")


@cache
def encoder(folder: str = FOLDER, ranks: str = RANKS) -> tiktoken.Encoding:
    sent = SparkFiles.get(ranks) if SparkFiles._is_running_on_worker else ""
    with open(sent if sent and os.path.exists(sent) else f"{folder}/{ranks}", "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def blocks(text: str, size: int = BLOCK) -> list[str]:
    out, start = [], 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]] if text[start:] else out


class Counted:
    """A document with the token counts of its blocks, open to edits."""

    def __init__(self, text: str | None, encode, size: int = BLOCK, tree: list[tuple[int, int]] | None = None) -> None:
        """``tree``: (characters, tokens) of each leaf as :meth:`tree` gave them for this text."""
        self.encode, self.encoded, self.size, text = encode, 0, size, text or ""
        if tree is not None and sum(chars for chars, _ in tree) == len(text):
            ends = [0, *accumulate(chars for chars, _ in tree)]
            self._lay([(text[a:b], tokens) for a, b, (_, tokens) in zip(ends, ends[1:], tree, strict=False)])
        else:
            self._lay([(x, len(encode(x))) for x in blocks(text, size)])

    def _lay(self, leaves: list[tuple[str, int]]) -> None:
        """Make the tree of leaves whose counts are known."""
        self.width = 1
        while self.width < len(leaves):
            self.width *= 2
        leaves = leaves + [("", 0)] * (self.width - len(leaves))
        self.leaves = [x for x, _ in leaves]
        self.chars, self.tokens = [0] * self.width + [len(x) for x, _ in leaves], [0] * self.width + [n for _, n in leaves]
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def tree(self) -> list[tuple[int, int]]:
        return [(len(x), n) for x, n in zip(self.leaves, self.tokens[self.width :], strict=True) if x]

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _count(self, leaf: str) -> int:
        self.encoded += len(leaf)
        return len(self.encode(leaf)) if leaf else 0

    def _set(self, first: int, last: int, text: str) -> None:
        """Put a text, cut into blocks, in place of the leaves from first to last."""
        new = [(x, self._count(x)) for x in blocks(text, self.size)]
        if len(new) > last - first + 1:
            known = list(zip(self.leaves, self.tokens[self.width :], strict=True))
            self._lay([x for x in [*known[:first], *new, *known[last + 1 :]] if x[0]])
            return
        for i in range(first, last + 1):
            leaf, tokens = new[i - first] if i - first < len(new) else ("", 0)
            node = self.width + i
            if not leaf and not self.leaves[i]:
                continue
            self.leaves[i], self.chars[node], self.tokens[node] = leaf, len(leaf), tokens
            while node > 1:
                node //= 2
                self._sum(node)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the place of its first."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, start: int, stop: int, text: str | None) -> None:
        """Put ``text`` in place of the characters from ``start`` to before ``stop``."""
        n = self.length
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        if not n:
            if text:
                self._set(0, 0, text)
            return
        first, at = self._leaf(min(start, n - 1))
        last, end = self._leaf(min(max(stop - 1, start), n - 1))
        stop_at = end + len(self.leaves[last])
        # context: the whole leaf before and the one after
        if at:
            first, at = self._leaf(at - 1)
        if stop_at < n:
            last, end = self._leaf(stop_at)
        old = "".join(self.leaves[first : last + 1])
        self._set(first, last, old[: start - at] + (text or "") + old[stop - at :])


def trees(text: Column, folder: str = FOLDER, ranks: str = RANKS) -> Column:
    """Column of ``TREE``: the leaves of a text's tree, to be kept with it."""

    @F.arrow_udf(TREE)
    def counted(texts: pa.Array) -> pa.Array:
        encode = encoder(folder, ranks).encode_ordinary
        return pa.array([[{"chars": chars, "tokens": tokens} for chars, tokens in Counted(x, encode).tree()] for x in common.strings(texts)], pa.list_(_LEAF))

    return counted(text)


def counts(text: Column, edits: Column, tree: Column | None = None, folder: str = FOLDER, ranks: str = RANKS) -> Column:
    """Column of ``RESULT``: tokens before and after the edits, and how many characters these had encoded again."""

    @F.arrow_udf(RESULT)
    def counted(texts: pa.Array, edits: pa.Array, kept: pa.Array) -> pa.Array:
        encode, out = encoder(folder, ranks).encode_ordinary, []
        for value, changes, leaves in zip(common.strings(texts), common.strings(edits), common.strings(kept), strict=True):
            doc = Counted(value, encode, tree=None if leaves is None else [(x["chars"], x["tokens"]) for x in leaves])
            before, n = doc.count, 0
            for x in changes or ():
                if x is not None:
                    doc.edit(x["start"] or 0, x["stop"] or 0, x["text"])
                    n += 1
            out.append({"before": before, "after": doc.count, "edits": n, "encoded": doc.encoded, "chars": doc.length})
        return pa.array(out, _TYPE)

    return counted(text, edits, F.lit(None).cast(TREE) if tree is None else tree)


def made_edits(doc_id: Column, text: Column) -> Column:
    """Three edits of a text, at places that its id gives: a deletion, an insertion and a replacement."""
    n = F.coalesce(F.length(text), F.lit(0))
    at = lambda k: F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(k)), n + 1).cast("int")
    edit = lambda start, stop, new: F.struct(start.alias("start"), stop.cast("int").alias("stop"), new.alias("text"))
    return F.array(edit(at(1), at(1) + 40, F.lit("")), edit(at(2), at(2), F.concat(F.lit("in"), F.substring(text, 1, 30))), edit(at(3), at(3) + 7, F.lit("  changed 2 words\n"))).cast(EDITS)


def op4_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, before and after three edits, the latter from the tree of the former."""
    send(spark)
    text = F.col("text").cast("string")
    kept = common.table(spark, sf_dir, "documents").select("doc_id", "text", trees(text).alias("tree"))
    found = kept.select("doc_id", counts(text, made_edits(F.col("doc_id"), text), F.col("tree")).alias("c"))
    return found.select("doc_id", F.col("c.before").alias("tokens_before"), F.col("c.after").alias("tokens_after"), F.col("c.edits").alias("n_edits"), F.col("c.encoded").alias("chars_encoded"), F.col("c.chars").alias("chars_after"))
