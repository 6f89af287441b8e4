"""Mixing sources to target weights by a low-discrepancy schedule.

The slots 0, 1, 2, .. of the mix get the points frac(n * golden ratio), and each
point falls into a source's part of the cumulative targets. The slots of a
source are ranked; each source's documents stand in shuffled order as one line of
words, cut into blocks of the source's own length, and the slot of rank r takes
block r modulo the number of blocks. So any stretch of slots holds the sources
close to their shares, and a source is taken whole before any of it repeats. A
source has as many slots as its target fills: the last one is taken in part,
points beyond them are passed over, and slots that the points leave out follow at
the end. So each source, however small, is taken to its target rounded to words
(one at least); in whole documents (`copies`) less than one document more or less.

Only DataFrame functions are used. Running sums over a source's documents and
ranks of its slots are built from sums per bin (bounded rows) and windows inside
a bin, so a source with a third of all rows is no task of its own. The number of
slots is about the words of the mix over a block's, which grows with the input
between fixed bounds, and LEAST_SLOTS for each source that fills fewer.

Null and empty texts have size 0 and are taken 0 times; a text of any length is counted
whole and may be cut by many blocks. A null doc_id is a document like any other. A null
source is a source, the last. An empty table, or one without words, has targets 0. Repeated rows are rows
of their own, dealt anew by a number each where they are more than a thousandth of
all; ties in the shuffle are broken by doc_id, and among equal rows by place. Columns of other names are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.llm.common import copies_numbered, cut, store, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
GOLDEN = 0.6180339887498949
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 32, 1 << 16, 1 << 16
LEAST_SLOTS = 16
CELLS = 1024
CHUNK = 4096
BIN_ROWS = 256
SMALL = 100_000
WORD = "[^\\x20\\x09-\\x0D]+"


def _if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what has been counted and is small; otherwise a shuffle join."""
    return F.broadcast(df) if rows <= SMALL else df


def before(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with columns named by sums, each the sum of an expression over the rows before in that order.

    Ranges of the order are sums of their own first, so that no window holds all rows.
    """
    ranged = store(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(*[F.sum(F.expr(x)).alias(f"_{k}") for k, x in sums.items()])  # as many as partitions
    upto = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_{k}").over(upto), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(parts), "_part")
    return out.withColumns({k: F.col(f"_{k}") + F.coalesce(F.sum(F.expr(x)).over(inside), F.lit(0)) for k, x in sums.items()}).drop("_part", *[f"_{k}" for k in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, rank (from 0), source_size and target for rows of (source, source_size).

    target = min(most * size, level * weight), with the level at which the targets
    sum to share of all sizes: what resharing the excess by weight ends in.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    out = before(sizes, [F.asc_nulls_last("source")], {"rank": "1"}).withColumn("weight", w.cast("double"))
    out = out.withColumn("cap", F.col("source_size") * float(most)).withColumn("room", F.col("cap") / F.col("weight"))
    out = before(out, [F.asc("room"), F.asc("rank")], {"full": "cap", "closed": "weight"})
    total, heavy = out.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    out = out.withColumn("level", (F.lit(total * float(share)) - F.col("full")) / (F.lit(heavy) - F.col("closed")))
    level = out.agg(F.max(F.when(F.col("level") <= F.col("room"), F.col("level")))).first()[0]
    return out.select("source", F.col("rank").cast("long").alias("rank"), "source_size", F.coalesce(F.least("cap", F.lit(level).cast("double") * F.col("weight")), F.lit(0.0)).alias("target"))


def slotted(sources: DataFrame, block: int) -> DataFrame:
    """sources (of targets()) with the length of its blocks, their number, its slots, and the words of the last slot if it is taken in part."""
    out = sources.withColumn("words", F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round("target").cast("long"))).otherwise(0))
    out = out.withColumn("length", F.least(F.lit(block), F.greatest(F.lit(1), F.ceil(F.col("words") / LEAST_SLOTS))).cast("long"))
    out = out.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length"))).withColumn("over", F.coalesce(F.expr("try_mod(words, source_size)"), F.lit(0)))
    out = out.withColumn("slots", F.coalesce(F.expr("cast(try_divide(words - over, source_size) as bigint)"), F.lit(0)) * F.col("blocks") + F.ceil(F.col("over") / F.col("length")))
    return out.withColumn("tail", F.col("over") % F.col("length")).drop("words", "over")


def schedule(sources: DataFrame, n_sources: int, slots: int) -> DataFrame:
    """(rank, block, times, tail): how often the slots take each block of each source, and how many of its first words once more."""
    used = sources.where("slots > 0").select("rank", "blocks", F.col("slots").alias("need"), "tail")
    parts = before(used.select("rank", "need"), [F.asc("rank")], {"first": "need"})
    last = parts.agg(F.max("rank")).first()[0]
    parts = parts.select("rank", (F.col("first") / F.lit(slots)).alias("low"), F.when(F.col("rank") == F.lit(last), F.lit(2.0)).otherwise((F.col("first") + F.col("need")) / F.lit(slots)).alias("high"))
    cells = max(CELLS, n_sources)
    top = F.least(F.lit(cells - 1), F.floor(F.col("high") * cells))
    parts = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), top)))  # at most sources + cells rows
    n = F.col("id")
    point = (n + 0.5) * GOLDEN - F.floor((n + 0.5) * GOLDEN)
    points = sources.sparkSession.range(slots).select("id", point.alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    taken = points.join(_if_small(parts, n_sources), "cell").where("u >= low and u < high").select("id", "rank", F.floor(n / CHUNK).alias("chunk"))
    sums = taken.groupBy("rank", "chunk").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.select("rank", "chunk", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")))
    place = F.col("before") + F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("id")) - 1
    placed = taken.join(sums, ["rank", "chunk"]).select("rank", place.alias("place"))
    met = used.join(sums.groupBy("rank").agg(F.sum("n").alias("met")), "rank", "left").withColumn("met", F.coalesce("met", F.lit(0)))
    missing = met.where("met < need").select("rank", F.explode(F.sequence(F.col("met"), F.col("need") - 1)).alias("place"))
    ranked = placed.unionByName(missing).join(_if_small(used, n_sources), "rank").where("place < need")
    part = (F.col("place") == F.col("need") - 1) & (F.col("tail") > 0)
    return ranked.groupBy("rank", F.pmod("place", "blocks").alias("block")).agg(F.count_if(~part).alias("times"), F.max(F.when(part, F.col("tail")).otherwise(0)).alias("tail"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per row of docs (doc_id, source, text).

    doc_id, source, h (hash of the text), size, source_size, target, taken, and
    copies: how often the block that holds its first word is taken.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("h")))
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    n_sources, words, n_rows = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    sources = cut(slotted(targets(sizes.drop("rows"), weights, share, most), max(LEAST_BLOCK, min(MOST_BLOCK, words // BLOCKS))))
    taken = schedule(sources, n_sources, sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    bins = max(1, min(1 << 16, n_rows // BIN_ROWS))
    sources = sources.select("source", "rank", "source_size", "target", "length")
    rows = cut(copies_numbered(rows))
    rows = rows.join(_if_small(sources, n_sources), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    key = F.xxhash64("doc_id", "h", F.lit(17))
    rows = rows.withColumn("key", F.when(F.col("copy") == 0, key).otherwise(F.xxhash64("doc_id", "h", "copy", F.lit(17)))).drop("copy").withColumn("bin", F.pmod("key", F.lit(bins)))
    sums = rows.groupBy("rank", "bin").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bin", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    order = Window.partitionBy("rank", "bin").orderBy("key", "doc_id")
    placed = rows.join(sums, ["rank", "bin"]).withColumn("row", F.row_number().over(order)).withColumn("start", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    length, end = F.col("length"), F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / length), F.floor((end - 1) / length)
    cutup = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    held = cutup.join(taken, ["rank", "block"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("times", "tail")})
    low, high = F.greatest("start", F.col("block") * length), F.least(end, (F.col("block") + 1) * length)
    part = (high - low) * F.col("times") + F.greatest(F.lit(0), F.least(high, F.col("block") * length + F.col("tail")) - low)
    once_more = (F.col("start") - F.col("block") * length < F.col("tail")).cast("int")
    keys = ["doc_id", "source", "h", "size", "source_size", "target", "rank", "bin", "row", "start"]
    out = held.groupBy(*keys).agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("taken"), F.coalesce(F.max(F.when(F.col("block") == first, F.col("times") + once_more)), F.lit(0)).cast("int").alias("copies"))
    return out.select("doc_id", "source", "h", "size", "source_size", "target", "taken", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: each document stands in the mix as often as its block is taken (0, 1 or 2 times).

    Rows of the same doc_id and text share the copies of the most taken one.
    """
    plan = mix(docs).where("copies > 0").groupBy("doc_id", "h").agg(F.max("copies").alias("copies")).hint("shuffle_hash")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))
    joined = rows.join(plan, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("h")))
    return joined.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
