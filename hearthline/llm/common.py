"""Helpers shared by the text operators: tables, checkpoints, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.cluster import cut, folder, released, ship

#: Odd multiplier of the rolling word hash, and the two of its finisher.
ROLL = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Bytes of a row group while it is written, one a task.
ROW_GROUP = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def store(df: DataFrame) -> DataFrame:
    """Write df as Parquet below the checkpoint folder and read it again; for wide or large results. What was shuffled for it is released."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with released(df.sparkSession):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text"):
    """The text's UTF-8 bytes; a null text gives none."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary").alias("b")


def _table(allowed) -> np.ndarray:
    return np.array([allowed(c) for c in range(256)], bool)


#: Bytes of words: all but ASCII white space; or letters, digits and everything beyond ASCII.
NO_SPACE = _table(lambda c: not (c == 0x20 or 0x09 <= c <= 0x0D))
LETTERS = _table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80)
_PIECE = 1 << 17


class _Powers:
    """Powers of a fixed odd 64-bit number and of its inverse, as many as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, _PIECE + 1)
            base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64), dtype=np.uint64)]) for x in (base, inverse))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_spans(text: bytes, kind: np.ndarray = NO_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte string begin and end."""
    on = np.zeros(len(text) + 2, np.int8)
    on[1:-1] = kind[np.frombuffer(text, np.uint8)]
    change = np.diff(on)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(texts: list[bytes], lower: bool = True, kind: np.ndarray = NO_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of each text's.

    lower: A-Z count as a-z. A word's hash is a polynomial of its bytes, taken for all words at once from
    running sums over pieces of the buffer, and finished with its length.
    """
    text = b"\n".join([*texts, b""])
    text = text.lower() if lower else text
    starts, ends = word_spans(text, kind)
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    n = np.diff(np.searchsorted(starts, stops), prepend=0)
    codes, out, k = np.frombuffer(text, np.uint8), np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        first = int(starts[k])
        m = max(k + 1, int(np.searchsorted(ends, first + _PIECE, side="right")))
        last = int(ends[m - 1])
        up, down = _powers.upto(last - first + 1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum((codes[first:last] + np.uint64(1)) * up[: last - first], out=sums[1:])
        a, b = starts[k:m] - first, ends[k:m] - first
        out[k:m] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * ROLL)
        k = m
    return out, n


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one-to-one."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a sequence of word hashes, in order."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * ROLL + h[i : len(h) - k + 1 + i]
    return mix(out + np.uint64(k))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow of a function of one batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


FILTER_BITS = 24


def known(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS, on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows of docs whose key (long columns) is in ids (a semi join).

    Most rows that have no partner are ruled out before the shuffle by a filter of
    2^bits bits, held as at most 2^(bits-6) broadcast rows of 64; it has no false
    negatives, and what passes it is joined exactly.
    """
    some, _ = sifted(docs, ids, on, bits)
    return some.join(_ids(ids, on).distinct().hint("shuffle_hash"), _keys(on), "left_semi").select("row.*")


def without(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS, on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows of docs whose key is not in ids; what the filter of known() rules out doesn't move."""
    some, rest = sifted(docs, ids, on, bits)
    return rest.select("row.*").unionByName(some.join(_ids(ids, on).distinct().hint("shuffle_hash"), _keys(on), "left_anti").select("row.*"))


def copies_numbered(rows: DataFrame, heavy: int = 1000, chunk: int = 10_000) -> DataFrame:
    """rows with `copy`: 0, but 1, 2, .. for equal rows that are more than a `heavy`-th of all, so that a hash of row and copy spreads them.

    Such rows are counted and made anew, chunk by chunk; so their numbers don't depend on
    where they stood. At most `heavy` rows are broadcast. rows should be stored.
    """
    bound = max(1, -(-rows.count() // heavy))
    many = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")).where(F.col("copies") > bound))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in rows.columns]
    others = rows.alias("r").join(F.broadcast(many.alias("m")), same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    chunks = many.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / chunk)))).repartition(*rows.columns, "chunk")
    anew = chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * chunk + 1, F.least(F.col("copies"), (F.col("chunk") + 1) * chunk))))
    return others.unionByName(anew.select(*rows.columns, "copy"))


def _keys(on: tuple[str, ...]) -> list[str]:
    return [f"k{i}" for i in range(len(on))]


def _ids(ids: DataFrame, on: tuple[str, ...]) -> DataFrame:
    return ids.select(*[F.col(c).cast("long").alias(k) for c, k in zip(on, _keys(on), strict=True)]).dropna()


def sifted(docs: DataFrame, ids: DataFrame, on: tuple[str, ...], bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (as the struct `row`, so that their names meet no other) with their keys: those that the filter of ids lets pass, and the others."""
    slot = f"pmod(xxhash64({', '.join(_keys(on))}), {1 << bits})"
    bit = f"cast({slot} & 63 as int)"
    words = _ids(ids, on).select(F.expr(f"cast(shiftright({slot}, 6) as int)").alias("word"), F.expr(f"shiftleft(1L, {bit})").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    words = cut(words)  # at most 2^(bits-6) rows
    held = docs.select(F.struct("*").alias("row"), *[F.col(c).cast("long").alias(k) for c, k in zip(on, _keys(on), strict=True)])
    passes = F.coalesce(F.expr(f"shiftright(mask, {bit}) & 1") == 1, F.lit(False))
    for k in _keys(on):
        passes = passes & F.col(k).isNotNull()
    held = held.withColumn("word", F.expr(f"cast(shiftright({slot}, 6) as int)")).join(F.broadcast(words), "word", "left").withColumn("some", passes)
    return held.where("some").select("row", *_keys(on)), held.where("not some").select("row", *_keys(on))
