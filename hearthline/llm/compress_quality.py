"""Quality classifier by compression with zstandard dictionaries.

One dictionary is built from good labelled texts, one from bad ones. A text that
resembles the good ones compresses better with the good dictionary. The
difference of the two sizes, normalised by their sum and by the text's own size,
goes with how far the text shrinks at all and how long it is (both say how much
a difference means) through a logistic curve, fitted to labelled rows that built
no dictionary and weighted to the classes' true shares. A second curve sees the
difference by the sizes' sum alone; its value is `difference_score`, beside `score`.

Labels are learnt from a bounded sample: of each class the first SAMPLE rows by
hash of their id, up to SAMPLE_BYTES of text in all (whole texts; one that doesn't
fit is passed over, and of a class with none that fits the shortest stands with
its beginning); half of them, by another hash, build the dictionaries and the
others fit the curve. Every text is scored whole. Only the text enters the score.

Null texts count as empty; an empty text gets the curve's value for no
difference. Repeated rows, and rows of a null doc_id, are scored like any other;
labels of a null doc_id, or other than 0 and 1, are passed over, and of several
labels of one doc_id the worst counts. Ties of the sample's order are settled by
id, length and text. If a class has no rows, every score is the good rows' share
(0.5 without any). An empty table gives no rows. Other columns are left aside by
name. Labelled rows are joined once and stored; each text is read twice in all.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.llm.common import by_batch, known, record, store, table, text_bytes, tune

SAMPLE = 4000
SAMPLE_BYTES = 24 << 20
DICTIONARY = 256 << 10
LEVEL = 3
CUT = 0.3


class Compressors:
    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL) -> None:
        self.pair = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]
        self.floor = [len(c.compress(b"")) for c in self.pair]

    def measures(self, text: bytes) -> tuple[float, float, float, float]:
        """The difference by the sizes' sum (above 0 if the good dictionary fits better) and by the text's size, the sum by the text's size, and the size's logarithm."""
        g, b = (len(c.compress(text)) - f for c, f in zip(self.pair, self.floor, strict=True))
        n, total = max(1, len(text)), max(1, g + b)
        return (b - g) / total, (b - g) / n, (g + b) / n, math.log(n)


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; of few or short texts, which can't be trained on, their own bytes."""
    total = sum(map(len, texts))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), texts, threads=0).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-size:] or b"\n" * 8


class Curve:
    """P(y=1) as a logistic function of standardised columns, by weighted Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> None:
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        z, self.w = self._columns(x), np.zeros(x.shape[1] + 1)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(self.w)), z.T @ (weight * (y - p)) - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-10:
                break

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._columns(x) @ self.w, -30, 30)))


def kept_keys(spark: SparkSession, kept: list[tuple[int, int, int]]) -> DataFrame:
    """The kept rows' keys (o, doc_id, n), and how many rows of each are kept; at most SAMPLE."""
    return spark.createDataFrame([(*k, c) for k, c in Counter(kept).items()], "o long, doc_id long, n int, times int")


def fit(labelled: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY) -> dict:
    """The model from rows of (doc_id, b, quality); what reaches the driver is bounded by sample and sample_bytes."""
    order = F.xxhash64("doc_id", F.lit(11))
    parts = []
    for label in (1, 0):
        rows = labelled.where(F.col("quality") == label).select("doc_id", "b", F.lit(label).alias("quality"), order.alias("o"), F.length("b").alias("n"))
        room, kept = sample_bytes // 2, []
        keys = ["o", "doc_id", "n"]
        for r in rows.where(F.col("n") <= room).select(*keys).orderBy(*keys).limit(sample).collect():
            if r.n <= room:
                room -= r.n
                kept.append(tuple(r))
        if kept:
            times = kept_keys(labelled.sparkSession, kept)
            nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("b")))
            got = rows.where(F.col("o") <= kept[-1][0]).join(F.broadcast(times), keys).withColumn("nth", nth).where("nth <= times").select(*keys, "b").collect()
        else:
            got = rows.orderBy("n", "o", "doc_id").select(*keys, F.substring("b", 1, room).alias("b")).limit(1).collect()
        parts += [(bytes(r.b), label, r.o) for r in sorted(got, key=lambda r: (r.o, r.doc_id, r.n, bytes(r.b)))]
    y = np.array([p[1] for p in parts])
    if len(set(y.tolist())) < 2:
        return {"prior": float(y.mean()) if len(y) else 0.5}
    build = np.array([(p[2] >> 7) % 2 == 0 for p in parts])
    for label in (0, 1):
        if not (build & (y == label)).any() or not (~build & (y == label)).any():
            build[y == label] = np.arange((y == label).sum()) % 2 == 0
    good, bad = (dictionary([p[0] for p, u in zip(parts, build & (y == label), strict=True) if u], size) for label in (1, 0))
    pair = Compressors(good, bad)
    use = ~build if len(set(y[~build].tolist())) == 2 else np.ones(len(y), bool)
    x, y = np.array([pair.measures(p[0]) for p, u in zip(parts, use, strict=True) if u]), y[use].astype(float)
    totals = {r.quality: r["count"] for r in labelled.groupBy("quality").count().collect()}
    share = totals[1] / (totals[0] + totals[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return {"good": good, "bad": bad, "curve": Curve(x, y, weight), "plain": Curve(x[:, :1], y, weight)}


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, the normalised size difference, score and difference_score of each row of docs (doc_id, b)."""
    tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a few numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = held.value, batch.column(1).to_pylist()
        if "prior" in m:
            x = np.zeros(len(texts))
            s = plain = np.full(len(texts), m["prior"])
        else:
            pair = Compressors(m["good"], m["bad"])
            measures = np.array([pair.measures(t) for t in texts])
            x, s, plain = measures[:, 0], m["curve"](measures), m["plain"](measures[:, :1])
        return record(doc_id=batch.column(0), difference=pa.array(x), score=pa.array(s), difference_score=pa.array(plain))

    return by_batch(docs.select("doc_id", "b"), run, "doc_id long, difference double, score double, difference_score double")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels has doc_id and quality."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    labels = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    labelled = store(known(docs, labels).join(labels.hint("shuffle_hash"), "doc_id"))
    model = fit(labelled)
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "difference", "difference_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
