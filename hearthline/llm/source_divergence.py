"""Source divergence audit: sketch-prefiltered counting, then sparse pair joins.

1. A first pass adds each document's distinct terms to a count-min sketch of document
   frequencies by language: DEPTH rows of WIDTH counters, each stopped at 3, which is
   all that is asked. The tasks' sketches are merged block by block. An estimate is
   never below the true frequency, so a term with any counter below 3 can't be kept.
   What is broadcast is one bit a counter (DEPTH * WIDTH / 8 bytes, 1.5 MiB).
2. A second pass counts the terms that the sketch lets pass, exactly and by their
   text, summed up inside each Arrow batch. They are shuffled once by (lang, term),
   where the exact document frequency drops what the sketch let through wrongly.
3. A pair's value is a sum over all kept terms, most of which stand in few sources.
   With f0 for a term in neither source, the sum is V * f0, plus what each source's
   own counts change (from its histogram of counts, not its terms), plus a correction
   for terms that stand in both, the only thing that needs a join of terms.

Arithmetic is on integers throughout: shares as decimals, values as 64-bit integers
(a sum stays below (10^9 + V)^2). The result has, by definition, a row for every
ordered pair of a language's sources; groups meet through (lang), broadcast up to
SMALL groups and dealt to PLACES places beyond, so one language doesn't land in one
task. A pair join's rows are those of terms in both sources.

Null text, lang and source are ''. Texts without terms, and empty ones, still make
their group occur; a language without kept terms has pairs of value 0 and no terms; one
with a single source has no pairs. Repeated rows are documents of their own, doc_id
and further columns are left aside. Texts are read whole. Ties are ordered by item. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.llm.common import by_batch, cut, mix, record, store, table, text_bytes, tune, word_spans

LEAST = 3
RANKS = 200
DEPTH, WIDTH, BLOCK = 3, 1 << 22, 1 << 12
SMALL, PLACES = 100_000, 64
UNIT = 1_000_000_000
#: Bytes of terms once A-Z are lower-cased: a-z and everything beyond ASCII.
ALPHA = np.array([0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])


class Terms:
    """The terms of a batch of (b, lang, ...): a dictionary, each term's code and its document."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        texts = batch.column(0).to_pylist()
        data = b"\n".join([*texts, b""]).lower()
        starts, ends = word_spans(data, ALPHA)
        codes = np.frombuffer(data, np.uint8)
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(codes[ALPHA[codes]])])
        encoded = words.dictionary_encode()
        self.words, self.code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, stops), prepend=0))
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words.to_pylist()), np.uint64, len(self.words))
        langs = batch.column(1).dictionary_encode()
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.salts = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in langs.dictionary.to_pylist()], np.uint64)

    def once(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and code of each document's distinct terms."""
        return np.divmod(np.unique(self.doc * len(self.words) + self.code), max(1, len(self.words)))

    def slots(self, lang: np.ndarray, code: np.ndarray, width: int) -> Iterator[np.ndarray]:
        """The counter of each (language, term) in each row of the sketch."""
        h = mix(self.hashes[code] ^ self.salts[lang])
        for k in range(DEPTH):
            yield (mix(h + np.uint64(k)) & np.uint64(width - 1)).astype(np.int64)


def sketch(rows: DataFrame, width: int = WIDTH, least: int = LEAST) -> np.ndarray:
    """Whether each counter (DEPTH x width) reached `least`, at most 3, over all rows of (b, lang); width is a power of 2."""
    block = min(BLOCK, width)
    schema = "block int, c binary"

    def packed(found: np.ndarray) -> bytes:
        return np.bitwise_or.reduce(np.minimum(found, 3).astype(np.uint8).reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8), 1).tobytes()

    def counters(b: bytes) -> np.ndarray:
        return ((np.frombuffer(b, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((DEPTH, width), np.int32)
        for batch in batches:
            t = Terms(batch)
            doc, code = t.once()
            pair, times = np.unique(t.lang[doc] * len(t.words) + code, return_counts=True)
            lang, code = np.divmod(pair, max(1, len(t.words)))
            for row, slot in zip(found, t.slots(lang, code, width), strict=True):
                np.add.at(row, slot, times)
        blocks = found.reshape(-1, block)
        used = np.flatnonzero(blocks.any(1))
        for some in np.array_split(used, max(1, len(used) // 256)):
            if len(some):
                yield record(block=pa.array(some, pa.int32()), c=pa.array([packed(blocks[k]) for k in some], pa.binary()))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = np.minimum(sums[k] + counters(c), 3) if k in sums else counters(c)
        if sums:
            yield record(block=pa.array(list(sums), pa.int32()), c=pa.array([np.packbits(c >= least).tobytes() for c in sums.values()], pa.binary()))

    out = np.zeros((DEPTH * width // block, block), bool)
    merged = rows.select("b", "lang").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toArrow()  # a bit a counter
    for row in merged.to_pylist():
        out[row["block"]] = np.unpackbits(np.frombuffer(row["c"], np.uint8))[:block]
    return np.packbits(out.reshape(DEPTH, width), axis=1)


def counted(rows: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """lang, source, term, c and its language's c (cl) for each kept term of each group, and `first` on one row of each (lang, term)."""
    bits = rows.sparkSession.sparkContext.broadcast(sketch(rows, width, least))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        t, bits_ = Terms(batch), bits.value
        n = len(t.words)
        if not n:
            return None
        present = np.unique(t.lang[t.doc] * n + t.code)
        lang, code = np.divmod(present, n)
        passes = np.ones(len(present), bool)
        for row, slot in zip(bits_, t.slots(lang, code, width), strict=True):
            passes &= (row[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
        may = np.zeros((len(t.salts), n), bool)
        may[lang[passes], code[passes]] = True
        sources = batch.column(2).dictionary_encode()
        source = sources.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        group = t.lang * len(sources.dictionary) + source
        on = may[t.lang[t.doc], t.code]
        pair, c = np.unique(group[t.doc[on]] * n + t.code[on], return_counts=True)
        doc, code = t.once()
        on = may[t.lang[doc], code]
        _, df = np.unique(group[doc[on]] * n + code[on], return_counts=True)
        group, code = np.divmod(pair, n)
        lang, source = np.divmod(group, len(sources.dictionary))
        langs = batch.column(1).dictionary_encode().dictionary
        return record(lang=langs.take(pa.array(lang)), source=sources.dictionary.take(pa.array(source)), term=t.words.take(pa.array(code)).cast(pa.binary()), c=pa.array(c), df=pa.array(df))

    found = by_batch(rows.select("b", "lang", "source"), count, "lang string, source string, term binary, c long, df long")
    summed = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    summed = summed.withColumns({"all_df": F.sum("df").over(term), "cl": F.sum("c").over(term), "first": F.col("source") == F.min("source").over(term)})
    return store(summed.where(F.col("all_df") >= least).select("lang", "source", F.col("term").cast("string").alias("term"), "c", "cl", "first"))


def share(c, n, v) -> Column:
    """1 + floor(10^9 * (c + 1) / (n + v)), exact; 1 where nothing was counted."""
    c, n, v = (F.col(x) if isinstance(x, str) else x for x in (c, n, v))
    part = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (c + 1).cast("decimal(20,0)"), (n + v).cast("decimal(20,0)"))
    return F.when(n + v > 0, 1 + part).otherwise(1)


def gap(p, q) -> Column:
    """floor((p - q)^2 / q)."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def beside(left: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """left joined by lang to the groups; a language's rows are dealt to PLACES places where the groups aren't broadcast."""
    if small:
        return left.join(F.broadcast(groups), "lang")
    dealt = left.withColumn("place", F.pmod(F.monotonically_increasing_id(), F.lit(PLACES)))
    return dealt.join(groups.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1)))), ["lang", "place"]).drop("place")


def audit(docs: DataFrame, width: int = WIDTH, least: int = LEAST, ranks: int = RANKS, small: int = SMALL) -> DataFrame:
    """lang, source, part, item, value, rank: the sources by divergence, and the terms that stand out, for each group of docs (text, lang, source)."""
    tune(docs.sparkSession)
    names = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source")]
    terms = counted(docs.select(text_bytes(), *names), width, least)
    langs = terms.groupBy("lang").agg(F.sum("c").alias("nl"), F.sum(F.col("first").cast("long")).alias("v"))
    own = terms.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    zero = {x: F.coalesce(x, F.lit(0)).cast("long") for x in ("n", "nl", "v")}
    groups = docs.select(*names).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(zero)
    groups = cut(groups.withColumn("p0", share(F.lit(0), "n", "v")))
    few = groups.limit(small + 1).count() <= small
    keyed = terms.join(F.broadcast(groups) if few else groups, ["lang", "source"])
    keyed = keyed.select("lang", "source", "term", share("c", "n", "v").alias("p"), "p0", share("cl", "nl", "v").alias("q"))

    shown = keyed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    shown = shown.withColumn("rank", nth).where(F.col("rank") <= ranks)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    apart = F.col("source") != F.col("item")
    least_value = beside(groups, other, few).where(apart).select("lang", "source", "item", (F.col("v") * gap("p0", "q0")).alias("value"))
    bars = keyed.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    one = beside(bars, other, few).where(apart).groupBy("lang", "source", "item").agg(
        F.sum(F.col("times") * (gap("p", "q0") - gap("p0", "q0"))).alias("there"),
        F.sum(F.col("times") * (gap("q0", "p") - gap("q0", "p0"))).alias("back"),
    )
    sides = [keyed.select("lang", "term", F.col("source").alias(f"s{k}"), F.col("p").alias(f"p{k}"), F.col("p0").alias(f"z{k}")) for k in (1, 2)]
    both = sides[0].join(sides[1], ["lang", "term"]).where("s1 < s2").groupBy("lang", F.col("s1").alias("source"), F.col("s2").alias("item")).agg(
        F.sum(gap("p1", "p2") - gap("p1", "z2") - gap("z1", "p2") + gap("z1", "z2")).alias("there"),
        F.sum(gap("p2", "p1") - gap("p2", "z1") - gap("z2", "p1") + gap("z2", "z1")).alias("back"),
    )
    changes = one.unionByName(both)
    ways = F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))))
    pairs = least_value.unionByName(changes.select("lang", ways.alias("way")).select("lang", "way.*"))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", nth)
    return pairs.unionByName(shown)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
