"""Quality rules: hashed n-gram log-likelihood ratio of two multinomials.

Unigrams and bigrams of the words are hashed into a fixed number of buckets. One
multinomial is fitted to a trusted target (documents labelled good), one to the
raw corpus (all documents), both with additive smoothing. A document's score is
the sum of its n-grams' log ratios divided by their number, and it is kept
exactly if no base rule rejects it and the score reaches the threshold.

Counting sums buckets inside each task and shuffles one partial row per bucket
range and task; what reaches the driver is the sum, of fixed size (8 bytes per
bucket). Only texts that a fixed-size filter finds among the trusted ids move for
the target's counts. Scoring looks at each text alone, with no shuffle.

Null and empty texts have no words: base_failed, score 0, not kept. Repeated
rows count as often as they stand and get the same result. Without trusted rows
every ratio is 0 by definition. A score equal to the threshold keeps the document. A
null doc_id is judged like any other and is never trusted. An empty table gives no rows. Texts of any length
are read whole. `score_documents` leaves other columns aside by name, the pipeline's
stage keeps them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import NO_SPACE, by_batch, known, mix, record, rolling, table, text_bytes, tune, word_hashes

BUCKETS = 1 << 18
RANGE = 1 << 12
SMOOTHING = 0.5
THRESHOLD = -0.2
WINDOW = 8
SYMBOLS = "#*$%&|<>"

def grams(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every unigram, then of every bigram, of a text's word hashes."""
    return (np.concatenate([mix(h + np.uint64(1)), rolling(h, 2)]) % np.uint64(buckets)).astype(np.int64)


def words(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's word hashes; case counts."""
    h, n = word_hashes(texts, lower=False)
    return np.split(h, np.cumsum(n)[:-1]) if texts else []


def counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket counts over all rows of `b` (bytes).

    Each task gives its counts as one row per range of buckets; these are added
    up range by range, first within 16 groups of tasks, so no task reads them all.
    The driver gets 8 bytes per bucket.
    """
    step = min(RANGE, buckets)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            if lists := [grams(h, buckets) for h in words(batch.column(0).to_pylist())]:
                found += np.bincount(np.concatenate(lists), minlength=buckets)
        if found.any():
            blocks = found.reshape(-1, step)
            yield record(block=pa.array(range(len(blocks)), pa.int32()), c=pa.array(list(blocks), pa.list_(pa.int64())))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for k, row in zip(batch.column(0).to_pylist(), flat, strict=True):
                sums[k] = sums[k] + row if k in sums else row
        if sums:
            yield record(block=pa.array(list(sums), pa.int32()), c=pa.array(list(sums.values()), pa.list_(pa.int64())))

    schema = "block int, c array<long>"
    parts = texts.select("b").mapInArrow(count, schema).withColumn("task", F.spark_partition_id() % 16)
    parts = parts.repartition("block", "task").select("block", "c").mapInArrow(add, schema)
    out = np.zeros(buckets, np.int64)
    for row in parts.repartition(4, "block").mapInArrow(add, schema).toArrow().to_pylist():
        out[row["block"] * step : (row["block"] + 1) * step] = row["c"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    if not target.any():
        return np.zeros(len(target))
    p, q = (np.log(c + smoothing) - np.log(c.sum() + smoothing * len(c)) for c in (target, raw))
    return p - q


def repeated_words(h: np.ndarray, width: int = WINDOW) -> int:
    """Words (by hash) that stand in a window of this width found twice or more in the list."""
    n = len(h)
    if n <= width:
        return 0
    kinds, name = np.unique(h, return_inverse=True)
    size = 1
    while size < width and len(kinds) < len(name):  # exact names of ever longer windows
        step = min(size, width - size)
        kinds, name = np.unique(name[:-step] * (n + 1) + name[step:], return_inverse=True)
        size += step
    if len(kinds) == len(name):
        return 0
    start = np.bincount(name)[name] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(start)] += start
    edge[width : width + len(start)] -= start
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _base(b: bytes, h: np.ndarray) -> tuple[int, int, int, int]:
    a = np.frombuffer(b, np.uint8)
    chars = int((NO_SPACE[a] & ((a & 0xC0) != 0x80)).sum())
    lines = [x for x in b.split(b"\n") if x.strip()] if b"\n" in b else []
    return chars, sum(b.count(s.encode()) for s in SYMBOLS), len(lines) - len(set(lines)), repeated_words(h)


def fitted(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray | None:
    """The log ratio of each bucket; None without trusted n-grams. docs has doc_id and text."""
    tune(docs.sparkSession)
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    target = counts(known(both, trusted_ids), buckets)
    return log_ratios(target, counts(both, buckets), smoothing) if target.any() else None


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
KINDS = (*[pa.int64()] * 5, *[pa.bool_()] * 2, pa.float64())
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(texts: list[bytes], ratio: np.ndarray | None, threshold: float) -> list[tuple]:
    """The columns NAMES of each text."""
    out = []
    for b, h in zip(texts, words(texts), strict=True):
        n, base = len(h), _base(b, h)
        failed = n < 20 or 100 * base[3] > 30 * n
        score = round(float(ratio[grams(h, len(ratio))].mean()), 6) + 0.0 if n and ratio is not None else 0.0
        out.append((n, *base, failed, not failed and score >= threshold, score))
    return out


def score_documents(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text); trusted_ids has the doc_id of the trusted target."""
    held = docs.sparkSession.sparkContext.broadcast(fitted(docs, trusted_ids, buckets, smoothing))  # 8 bytes per bucket

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = zip(*judge(batch.column(1).to_pylist(), held.value, threshold), strict=True)
        return record(doc_id=batch.column(0), **{k: pa.array(v, t) for k, v, t in zip(NAMES, out, KINDS, strict=True)})

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), run, "doc_id long, " + SCHEMA)


def keep_documents(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns; judged where they are read."""
    held = docs.sparkSession.sparkContext.broadcast(fitted(docs, trusted_ids, buckets, smoothing))

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([x[6] for x in judge([bytes(b) for b in texts], held.value, threshold)], dtype=bool)

    return docs.where(kept(text_bytes()))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trusted target: documents labelled of good quality."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: rejected documents go, the others stay as they are."""
    return keep_documents(docs, trusted(spark, sf_dir))
