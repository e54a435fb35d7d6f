"""Near copies of whole texts: SimHash links, and all pairs whose sets of five-word shingles are similar by 0.8.

SimHash's deletion variants (:func:`simhash.links`) link fingerprints of five-word shingles that differ in 2 bits at
most. Fingerprints of texts with a Jaccard similarity of 0.8 differ in 4 to 14 bits, out of that index's reach, so an
exact join finds those, without caps, samples or rounds:

1. A text is the set of its shingles' hashes. Texts with equal sets are one text from here on.
2. In the order of hashes, of two similar sets with n shingles each the first ``n - ceil(0.8 n) + l`` have ``l`` in
   common (:func:`lengths`, l is about n / 10). A text's shingles there are its prefix. Only shingles in two prefixes
   count, and a text with fewer of them than any similar one would share is done: most texts are.
3. The rest of a prefix is ordered by how often a shingle occurs, rarest first, and its last ``l - 1`` go: by the same
   argument two similar texts still share one, and the shingles of common lines and passages are mostly gone.
4. Texts that share a shingle with at most ``FEW`` others are paired with these (fitting sizes only), and each pair is
   verified by its whole sets.
5. Texts under a more frequent shingle are not paired. They are joined to groups by their shingles, each text in one
   group, and a group is dealt out in chunks of about ``CHUNK`` shingles. A chunk gives a spanning forest of its
   links: texts reached drop out, so what it returns grows with its texts. For a group of several chunks each also gets
   the group's ``HUBS`` texts; then only texts outside the group's largest component are compared with all chunks.

A task holds two chunks at most, or a chunk and ``HUBS`` texts. Nothing is collected to the driver.

Sets and rows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, simhash

WORDS, SIMILARITY = 5, Fraction(4, 5)
P, Q = SIMILARITY.as_integer_ratio()
#: Texts that a shingle pairs with each other; under others texts are joined to groups.
FEW = 32
#: Shingles of the texts that a task gets from each side, and texts that all chunks of a group get.
CHUNK, HUBS = 1 << 20, 64
_ROW = "__tidemark_row"


def least_common(n):
    """Shingles that a set of ``n`` has in common with any similar one, at least. Of numbers, arrays and columns."""
    return (n * P + (Q - 1)) // Q if not isinstance(n, Column) else F.floor((n * P + (Q - 1)) / Q)


def lengths(n: int) -> tuple[int, int]:
    """Length of a prefix, and how many of its shingles are in a similar set's prefix at least.

    Sets with n and m shingles have x >= ``least_common`` of either in common. A prefix of n - least_common(n) + l(n)
    leaves out least_common(n) - l(n), so of the x it has the first l(n) or more; so has the other's prefix its first
    l(m), and the first min(l(n), l(m)) are in both. As m >= least_common(n), that is l(least_common(n)) at least.
    """
    least = least_common(n)
    return min(n, n - least + 1 + n // 10), 1 + least // 10


def need(n: Column) -> Column:
    """The second of :func:`lengths`."""
    return F.lit(1) + F.floor(least_common(n) / 10)


def _sketch(text: Column) -> Column:
    kind = pa.struct([("n", pa.int32()), ("sign", pa.int64()), ("fp", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n:int,sign:long,fp:long,prefix:array<long>>")
    def sketch(column: pa.Array) -> pa.Array:
        n, sign, fp, ends, parts = [], [], [], [0], [np.zeros(0, np.uint64)]
        for x in common.strings(column):
            hashes = simhash.shingle_hashes(x, WORDS)
            distinct = np.unique(hashes)
            n.append(len(distinct))
            sign.append(xxhash.xxh64_intdigest(distinct.tobytes(), simhash.SEED))
            fp.append(simhash.majority(hashes))
            parts.append(distinct[: lengths(len(distinct))[0]])
            ends.append(ends[-1] + len(parts[-1]))
        prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(np.array(sign, np.uint64).view(np.int64)), pa.array(fp, pa.int64()), prefix], fields=list(kind))

    return sketch(text)


def _shingles(text: Column) -> Column:
    @F.arrow_udf("array<long>")
    def shingles(column: pa.Array) -> pa.Array:
        return pa.array([np.unique(simhash.shingle_hashes(x, WORDS)).view(np.int64) for x in common.strings(column)], pa.list_(pa.int64()))

    return shingles(text)


def _row(docs: DataFrame) -> Column:
    """Hash of a row's columns (but maps and the like, which have none), with nulls told apart."""
    names = [common.named(f.name) for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant", "void"))]
    return F.xxhash64(*names, F.concat(*[F.when(x.isNull(), "0").otherwise("1") for x in names]))


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of sets whose links connect just as those of all similar pairs do. Texts reached leave the inverted index."""
    sizes = np.array([len(x) for x in sets], np.int64)
    shingles, place = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    of = np.split(place, np.cumsum(sizes)[:-1])
    order = np.argsort(place, kind="stable")
    tokens, owners = place[order], np.repeat(np.arange(len(sets)), sizes)[order]
    left, indexed, out = np.ones(len(sets), bool), len(sets), []

    def starts_and_counts() -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(tokens, minlength=len(shingles))
        return np.cumsum(counts) - counts, counts

    starts, counts = starts_and_counts()
    for root in range(len(sets)):
        reached = [root] if left[root] else []
        left[root] = False
        while reached and (n := int(left.sum())):
            if 2 * n < indexed:
                keep = left[owners]
                tokens, owners, indexed = tokens[keep], owners[keep], n
                starts, counts = starts_and_counts()
            one = reached.pop()
            many = counts[of[one]]
            at = np.repeat(starts[of[one]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            shared = np.bincount(owners[at], minlength=len(sets))
            hit = np.flatnonzero(left & ((P + Q) * shared >= P * (sizes + sizes[one])) & (sizes > 0))
            left[hit] = False
            reached += hit.tolist()
            out += [(one, x) for x in hit.tolist()]
    return out


def _forest(table: pa.Table) -> pa.Table:
    """Links (a, b) of a task's rows (rid, set)."""
    rids, at = np.unique(table.column("rid").to_numpy(), return_index=True)
    column = table.column("set").combine_chunks()
    found = forest([column[i].values.to_numpy() for i in at.tolist()])
    return pa.table({"a": pa.array([int(rids[i]) for i, _ in found], pa.int64()), "b": pa.array([int(rids[j]) for _, j in found], pa.int64())})


def _alive(tables: common.Tables, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(rid, n, key): the prefixes of texts that share enough of their prefix with others; steps 2 and 3.

    Copies count here, which only lets some texts more through. Keys are counted first, without their texts, so that
    a frequent key is added up before it is shuffled.
    """
    shared = tables.cut(rows.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    held = rows.select("rid", F.explode("prefix").alias("key")).join(shared, "key")
    lists = held.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys"))  # bounded by the text's length
    used = lists.join(texts.select("rid", "n"), "rid").withColumn("need", need(F.col("n")).cast("int")).where(F.size("keys") >= F.col("need"))
    out = tables.cut(used.select("rid", "n", F.explode(F.slice("keys", F.lit(1), F.size("keys") - F.col("need") + 1)).alias("k")).select("rid", "n", F.col("k.key").alias("key")))
    tables.drop(shared)
    return out


def _candidates(tables: common.Tables, alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs to verify; (rid, label, n): texts of groups."""
    per = tables.cut(alive.groupBy("key").agg(F.count("*").alias("texts"), F.min("rid").alias("hub")).where("texts > 1"))
    few = alive.join(per.where(F.col("texts") <= FEW).select("key"), "key")
    side = lambda x: few.select("key", F.col("rid").alias(x), F.col("n").alias(f"n_{x}"))
    fits = (F.col("a") < F.col("b")) & (Q * F.least("n_a", "n_b") >= P * F.greatest("n_a", "n_b"))
    pairs = tables.cut(side("a").join(side("b"), "key").where(fits).select("a", "b").distinct())
    stars = alive.join(per.where(F.col("texts") > FEW).select("key", "hub"), "key").select("rid", "hub")
    labels = common.components(stars, "hub", "rid", tables)
    labels = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())  # the smallest of a group is not a node there
    groups = tables.cut(alive.select("rid", "n").distinct().join(labels, F.col("rid") == F.col("node")).select("rid", "label", "n"))
    grouped = groups.select("rid", "label")
    apart = pairs.join(grouped.select(F.col("rid").alias("a"), F.col("label").alias("of_a")), "a", "left").join(grouped.select(F.col("rid").alias("b"), F.col("label").alias("of_b")), "b", "left")
    out = tables.cut(apart.where(~F.col("of_a").eqNullSafe(F.col("of_b")) | F.col("of_a").isNull()).select("a", "b"))
    tables.drop(per, pairs)
    return out, groups


def _sets(tables: common.Tables, docs: DataFrame, rows: DataFrame, rids: DataFrame) -> DataFrame:
    """(rid, set) of the texts named."""
    wanted = rows.join(rids, "rid").select("rid", "row", "times")
    found = _once(docs, wanted.select(F.col("row").alias(_ROW), F.col("rid").alias("__tidemark_rid"), "times"))
    return tables.cut(found.select(F.col("__tidemark_rid").alias("rid"), _shingles(F.col("text").cast("string")).alias("set")))


def _once(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose hash is in ``wanted`` (and its columns but ``times``), one of those that are there several ``times``."""
    times = "__tidemark_times"
    hit = docs.withColumn(_ROW, _row(docs)).join(wanted.withColumnRenamed("times", times), _ROW)
    if not wanted.where("times > 1").limit(1).count():
        return hit.drop(times)
    return hit.where(F.col(times) == 1).unionByName(hit.where(F.col(times) > 1).dropDuplicates([_ROW])).drop(times)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("set").alias(f"set_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where((P + Q) * shared >= P * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def _grouped(tables: common.Tables, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect the texts of each group; step 5."""

    def chunks(named: DataFrame, name: str) -> DataFrame:
        """Rows with ``name``, a text's chunk, and ``{name}s``, how many its group has."""
        per = named.groupBy("label").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias(f"{name}s"))
        return named.join(per, "label").withColumn(name, F.pmod(F.xxhash64("rid", F.lit(name)), F.col(f"{name}s")).cast("int"))

    def linked(tasks: DataFrame) -> DataFrame:
        """``tasks``: rid, label, x, y; the texts of each (label, x, y) meet."""
        return tables.cut(tasks.distinct().join(sets, "rid").groupBy("label", "x", "y").applyInArrow(_forest, "a long, b long"))

    dealt = tables.cut(chunks(groups, "chunk"))
    large = dealt.where("chunks > 1")
    some = large.join(large.groupBy("label").agg(F.count("*").alias("texts")), "label").where(F.pmod(F.xxhash64("rid", F.lit("hub")), F.greatest(F.lit(1), F.floor(F.col("texts") / HUBS))) == 0)
    hubs = some.select("rid", "label", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("x"), F.lit(0).alias("y"))
    links = linked(dealt.select("rid", "label", F.col("chunk").alias("x"), F.lit(0).alias("y")).unionByName(hubs))
    if not large.limit(1).count():
        return links
    found = common.components(links, "a", "b", tables).select(F.col("node").alias("rid"), F.col("label").alias("part"))
    parts = tables.cut(large.join(found, "rid", "left").withColumn("part", F.coalesce("part", "rid")))
    main = parts.groupBy("label", "part").agg(F.count("*").alias("texts")).groupBy("label").agg(F.max_by("part", F.struct("texts", "part")).alias("main"))
    apart = chunks(parts.join(main, "label").where("part <> main").select("rid", "label", "n", "chunks"), "side")
    queries = apart.select("rid", "label", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("x"), F.col("side").alias("y"))
    sides = apart.groupBy("label").agg(F.max("sides").alias("sides"))
    against = parts.join(sides, "label").select("rid", "label", F.col("chunk").alias("x"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("y"))
    return links.unionByName(linked(queries.unionByName(against)))


def clusters(docs: DataFrame, tables: common.Tables) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, row, times, sign): each different row of ``docs``, its hash, how often it is there and its text; and (sign, label)."""
    raw = tables.cut(docs.select("doc_id", _row(docs).alias("row"), _sketch(F.col("text").cast("string")).alias("s")).select("doc_id", "row", "s.*").withColumn("rid", F.monotonically_increasing_id()))
    rows = tables.cut(raw.groupBy("row").agg(F.count("*").alias("times"), F.min(F.struct("rid", "doc_id", "sign", "fp", "n")).alias("r")).select("row", "times", "r.*"))
    texts = tables.cut(rows.groupBy("sign").agg(F.min("rid").alias("rid"), F.max("n").alias("n")))
    alive = _alive(tables, raw.select("rid", "prefix"), texts)
    pairs, groups = _candidates(tables, alive)
    rids = pairs.select(F.explode(F.array("a", "b")).alias("rid")).unionByName(groups.select("rid")).distinct()
    sets = _sets(tables, docs, rows, tables.cut(rids))
    tables.drop(raw, alive)
    similar = tables.cut(_verified(pairs, sets)).unionByName(_grouped(tables, groups, sets))
    # texts with equal fingerprints, and with linked ones
    prints = tables.cut(rows.select("sign", "fp").distinct().join(texts.select("sign", "rid"), "sign").select("fp", "rid"))
    least = tables.cut(prints.groupBy("fp").agg(F.min("rid").alias("least")))
    near = simhash.links(least, "fp", tables)
    at = lambda x: least.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}"))
    edges = prints.join(least, "fp").select(F.col("least").alias("a"), F.col("rid").alias("b")).unionByName(near.join(at("a"), "a").join(at("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))
    labels = common.components(edges.unionByName(similar), "a", "b", tables)
    named = texts.join(labels, F.col("rid") == F.col("node"), "left").select("sign", F.coalesce("label", "rid").alias("label"))
    return rows.select("rid", "doc_id", "row", "times", "sign"), named


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one of the least id.

    Texts are of a group if a chain of links joins them: SimHash fingerprints of five-word shingles that differ in 2
    bits at most, or sets of these shingles with a Jaccard similarity of 0.8 or more. A text of under five words is
    one shingle.

    Null, empty and blank texts are copies of each other. A document without an id takes part, and stays only if none
    of its group has one. Rows that share an id but not a text are documents of their own; of rows of one id in one
    group one stays (that of the least hash), and of equal rows one. Extra columns are kept, whatever they are called.
    Empty tables give empty tables. A text is held whole by one task, as it is when it is read.
    """
    tables = common.Tables(spark)
    rows, named = clusters(docs, tables)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "times")).alias("r")
    keep = tables.cut(rows.join(named, "sign").groupBy("label").agg(first).select(F.col("r.row").alias(_ROW), "r.times"))
    tables.drop_all(keep)
    return _once(docs, keep).select(*map(common.named, docs.columns))
