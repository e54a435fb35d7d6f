"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

Every source has a target number of words; each of its documents is to be taken target / source size times.
The whole part is taken as it is. The fractional parts are rounded dependently: of a pair, mass (words times
probability) moves from one to the other, in a direction drawn so that expectations stay, until one of the two
is at 0 or 1; the other goes on to meet the next. Since mass is only moved, what a source takes differs from
its target by the one document that is left at the end.

Long documents come first, as one that is left over would miss the target by its length: those above ``LONG`` of
their source's target and ``SOME`` of its words, so at most 1 / ``SOME`` of a source. In order of size each is paired
with all that is undecided, as one unit: the document becomes integral, by its probability, and the others' probability
takes what it leaves, so expectations stay. Where that could bring the others under 0 or over ``MOST`` copies, as
it is only where little is left beside it, the document stays undecided and goes to the tree.

The other documents' pairs form a tree. Documents of a source are dealt by a hash into chunks of about ``FAN`` (a
source with a third of all rows just has more chunks), each chunk is folded, largest documents first, so that what is
left over tends to be small, and sends on one residual; ``FAN`` neighbouring chunks make one chunk of the level
above, up to a single residual for the source. It tends to be a large document; so about ``CLOSE`` documents of
all sizes are kept back from the tree, and it meets them last, in order of size, until a small one is left,
which is drawn by its probability. Levels are written to the shared folder: log(rows) / log(FAN) of them, each
smaller by that factor.

Draws are hashes of ids and of ``SEED``: reruns, partitionings and cluster sizes agree.

Defined cases: null texts have size 0 and nothing is taken of them; rows without a source form a source that
sorts last; a source without words has target 0. Repeated rows are units of their own. Rows without an id take
part like others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FAN, SEED = 64, 20
#: About so many documents of a source, drawn by hash, meet what its tree leaves over.
CLOSE = 512
#: Shares of a source's target and of its words from which on a document is long.
LONG, SOME = 0.005, 0.001
#: A word of the contract.
WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often.
MOST = 3
#: Sources up to this number are sent to all executors with their targets (under 1 MB); more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column], many: bool) -> DataFrame:
    """Add sums over the rows before each in an order: within ranges of it if there are ``many`` rows, and over the ranges' sums."""
    part = F.spark_partition_id() if many else F.lit(0)
    rows = rows.repartitionByRange(*order) if many else rows
    rows = common.cut(rows.withColumn("part", part)) if many else rows.withColumn("part", part)
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = rows.select("*", *(F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(name) for name, x in sums.items()))
    if not many:
        return got.drop("part")
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    whole = rows.groupBy("part").agg(*(F.sum(x).alias(name) for name, x in sums.items()))
    whole = whole.select("part", *(F.coalesce(F.sum(name).over(ranges), F.lit(0)).alias(f"{name}_ranges") for name in sums))
    got = got.join(F.broadcast(whole), "part")
    return got.select(*rows.drop("part").columns, *((F.col(name) + F.col(f"{name}_ranges")).alias(name) for name in sums))


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to rows (key, source_size, n): shares by the repeating weights 1, 2, 3 in order of key.

    Targets stop at ``MOST`` x the source's size. In order of limit / weight, the sources that stop come first:
    one stops if its share of what those before it leave is above its limit. One row for each source; over
    ``BROADCAST_SOURCES`` of them are summed in ranges.
    """
    many = sources.count() > BROADCAST_SOURCES
    w = _before(sources, [F.col("key")], {"rank": F.lit(1)}, many).withColumn("w", F.col("rank") % 3 + 1).withColumn("cap", MOST * F.col("source_size")).drop("rank")
    w = common.cut(_before(w, [F.col("cap") / F.col("w"), F.col("key")], {"cap_before": F.col("cap"), "w_before": F.col("w")}, many))
    size, weight = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    left = (size - F.col("cap_before")) / (weight - F.col("w_before"))
    full = w.withColumn("full", left * F.col("w") > F.col("cap"))
    rest, words = full.agg(F.sum(F.when(~F.col("full"), F.col("w"))), size - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0))).first()
    share = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.lit(float(words)) * F.col("w") / F.lit(float(rest or 1)))
    return full.select("key", "source_size", "n", F.least(share, F.col("cap").cast("double")).alias("target"))


def _uniform(*what: Column) -> Column:
    return F.xxhash64(*what, F.lit(SEED)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _unit(x: Column, p: Column) -> Column:
    return F.struct(x["size"].alias("size"), x["draw"].alias("draw"), x["doc_id"].alias("doc_id"), x["times"].alias("times"), p.alias("p"))


def _fold(units: Column, level: int) -> Column:
    """Struct (held, done) of an array of units: the one left over, and the others with p at 0 or 1."""

    def step(state: Column, b: Column) -> Column:
        a = state["held"]
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        rise = _uniform(a["draw"], b["draw"], F.lit(level)) * (up + down) < down
        first = F.when(rise, (1 - a["p"]) * a["size"] <= b["p"] * b["size"]).otherwise(a["p"] * a["size"] <= (1 - b["p"]) * b["size"])
        moved = F.when(rise, up).otherwise(-down)
        kept = F.when(first, _unit(b, b["p"] - moved / b["size"])).otherwise(_unit(a, a["p"] + moved / a["size"]))
        # if the first is settled it rose to 1 or fell to 0; the second does the reverse
        settled = F.when(first, _unit(a, F.when(rise, F.lit(1.0)).otherwise(F.lit(0.0)))).otherwise(_unit(b, F.when(rise, F.lit(0.0)).otherwise(F.lit(1.0))))
        return F.struct(kept.alias("held"), F.concat(state["done"], F.array(settled)).alias("done"))

    zero = F.struct(units[0].alias("held"), F.slice(units, 1, 0).alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), zero, step)


def _folded(units: DataFrame, level: int, *key: str) -> DataFrame:
    """One row (key, held, done) for each group of units, written to the shared folder. Largest sizes first."""
    unit = F.struct((-F.col("size")).alias("order"), "draw", "doc_id", "times", "size", "p")
    listed = F.transform(F.sort_array(F.collect_list(unit)), lambda x: _unit(x, x["p"]))
    return common.cut(units.groupBy(*key).agg(listed.alias("units")).select(*key, _fold(F.col("units"), level).alias("f")).select(*key, "f.held", "f.done"))


def rounded(units: DataFrame, most: int) -> DataFrame:
    """Decide units (key, n, size, draw, doc_id, times, p with 0 < p < 1): the same rows, p at 0 or 1.

    ``n``: a bound on the units of the key; ``most``: its maximum.
    """
    last = (F.col("n") <= CLOSE) | (F.pmod(F.xxhash64("draw", F.lit(2)), F.col("n")) < CLOSE)
    per = F.ceil(F.col("n") / FAN)
    names = ("size", "draw", "doc_id", "times", "p")
    closing = units.where(last).select("key", *names)
    level, chunks, out = 0, math.ceil(most / FAN), []
    tree = units.where(~last).select("key", per.alias("n_chunks"), F.pmod(F.xxhash64("draw", F.lit(1)), per).alias("chunk"), *names)
    while most > CLOSE:
        folded = _folded(tree, level, "key", "n_chunks", "chunk")
        out.append(folded.select("key", F.explode("done").alias("u")).select("key", "u.*"))
        closing = closing.unionByName(folded.where("n_chunks = 1").select("key", "held.*"))
        if chunks <= 1:
            break
        up = lambda x: F.floor(x / FAN)
        tree = folded.where("n_chunks > 1").select("key", up(F.col("chunk")).alias("chunk"), (up(F.col("n_chunks") - 1) + 1).alias("n_chunks"), "held.*")
        chunks, level = (chunks - 1) // FAN + 1, level + 1
    end = _folded(closing, level + 1, "key")
    got = end.select("key", F.explode("done").alias("u")).select("key", "u.*")
    got = got.unionByName(end.select("key", "held.*").withColumn("p", (_uniform(F.col("draw"), F.lit(-1)) < F.col("p")).cast("double")))
    for more in out:
        got = got.unionByName(more)
    return got


def _long(units: DataFrame) -> DataFrame:
    """One row (key, rest_target, rest_size, met) for each source with long documents; ``met``: these, ``taken`` null if undecided.

    ``units``: key, size, draw, doc_id, times and the source's target and source_size.
    """

    def step(state: Column, u: Column) -> Column:
        size, left = u["size"].cast("double"), (state["size"] - u["size"]).cast("double")
        ratio = state["target"] / state["size"]
        low = F.floor(ratio)
        copies = low + (_uniform(u["draw"], F.lit(-2)) < ratio - low).cast("long")
        # either way the others must be able to make up for it
        fits = (state["target"] - low * size <= MOST * left) & (state["target"] - (low + (ratio > low).cast("long")) * size >= 0)
        met = F.struct(*(u[x].alias(x) for x in ("doc_id", "size", "draw", "times")), F.when(fits, copies * u["size"]).cast("long").alias("taken"))
        return F.struct(F.when(fits, state["target"] - copies * size).otherwise(state["target"]).alias("target"), F.when(fits, state["size"] - u["size"]).otherwise(state["size"]).alias("size"), F.concat(state["met"], F.array(met)).alias("met"))

    listed = units.groupBy("key", "target", "source_size").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "draw", "doc_id", "times", "size"))).alias("units"))
    none = F.slice(F.transform("units", lambda x: F.struct(*(x[y].alias(y) for y in ("doc_id", "size", "draw", "times")), F.lit(None).cast("long").alias("taken"))), 1, 0)
    zero = F.struct(F.col("target").cast("double").alias("target"), F.col("source_size").cast("long").alias("size"), none.alias("met"))
    return listed.select("key", F.aggregate("units", zero, step).alias("f")).select("key", F.col("f.target").alias("rest_target"), F.col("f.size").alias("rest_size"), "f.met")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken), one for each row of ``docs``."""
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    # a key that is never null: nulls sort after all sources, whose keys start with a lower letter
    key = F.coalesce(F.concat(F.lit("a"), F.col(source).cast("string")), F.lit("b"))
    rows = common.cut(docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), key.alias("key")))
    sources = common.cut(targets(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))))
    known, most = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    sent = (lambda x: F.broadcast(x)) if known <= BROADCAST_SOURCES else (lambda x: x)
    # repeated rows are counted and told apart by number, so that draws don't depend on how rows are dealt out
    same = rows.groupBy("key", "doc_id", "size").agg(F.count("*").alias("c")).select("key", "doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("times"))
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "times", "size", "key", F.lit(SEED))
    is_long = (F.col("size") > LONG * F.col("target")) & (F.col("size") > SOME * F.col("source_size"))
    units = same.withColumn("draw", draw)
    ends = common.cut(_long(units.join(sent(sources), "key").where(is_long)))
    # what is left of a source for its other documents
    rest = F.coalesce("rest_size", "source_size")
    ratio = F.when(rest > 0, F.greatest(F.least(F.coalesce("rest_target", "target") / rest, F.lit(float(MOST))), F.lit(0.0))).otherwise(F.lit(0.0))
    left = common.cut(sources.join(ends.drop("met"), "key", "left").withColumn("ratio", ratio).drop("rest_target", "rest_size"))
    met = ends.select("key", F.explode("met").alias("u")).select("key", "u.*")
    names = ("key", "doc_id", "size", "draw", "times")
    near = sources.select("key", "target", "source_size")
    short = units.join(sent(near), "key").where(~is_long).select(*names).unionByName(met.where("taken is null").select(*names))
    short = short.join(sent(left), "key").withColumn("p", F.col("ratio") - F.floor("ratio"))
    decide = (F.col("p") > 0) & (F.col("size") > 0)
    drawn = rounded(short.where(decide).select("key", "n", "size", "draw", "doc_id", "times", "p"), most).select("key", "doc_id", "size", "p")
    plain = short.where(~decide).select("key", "doc_id", "size", F.lit(0.0).alias("p"))
    got = drawn.unionByName(plain).join(sent(left), "key").select("key", "doc_id", "size", "source_size", "target", (F.col("size") * (F.floor("ratio") + F.col("p"))).cast("long").alias("taken"))
    got = got.unionByName(met.where("taken is not null").join(sent(near), "key").select(*got.columns))
    return got.select("doc_id", F.when(F.col("key") != "b", F.substring("key", 2, 1 << 30)).alias("source"), "size", "source_size", "target", "taken")


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: a row for each document, with the words to take of it.

    Null and empty texts have size 0 and are not taken. Sources that are null are one source. Repeated rows are drawn
    each by themselves; extra columns are not read. Empty tables give empty tables.
    """
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
