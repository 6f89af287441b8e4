"""Language-model scoring by a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(sub | class, history) * P(word | class, sub).
A word's hash gives its class and its sub-class; the first two factors are
softmaxes over sums of weight rows, which hashed features of the history choose:
the word before, the word before that (a skip), and both together. The third
factor is the word's smoothed count in its sub-class, with one share for all
words not seen. Together these are a distribution over all words.

Learning reads all training documents four times. First the words are counted (the
counts stay a distributed table). Then each round takes the gradient of the log
likelihood, observed less expected counts of every row's classes, over all
documents for the rows of one feature, and steps along it. The gradient is summed
by Spark: each task adds up its own rows, and ranges of rows are added in two
levels, so no task reads those of all others. The step of a weight is scaled as in
iterative scaling, log((observed / expected share + a) / (n + a)): rows met often
move freely, rare ones little. How little (`a`) is chosen from the sums, for rows
of like n, by the likelihood of each observation under all others. So the weights
don't depend on how documents are dealt to tasks. The number of rows follows the
tokens between LEAST_ROWS and MOST_ROWS; the bound keeps what tasks gather per
round, and the model sent to them, in proportion to their input.

Scoring is done by sparse numpy batches: rows are gathered by feature hash. The
counts of the most frequent words (a bounded table) are sent with the task; rarer
words go through an exact join with the table of counts, summed per document.

Tokens: ASCII-lower-cased words and one end per text. Null and empty texts are
one end. Repeated rows are kept apart by their place in the scan. Without
training documents (or an empty table) all counts are 0 and scores are those of
the smoothing alone. Rows of a null doc_id are training documents. Words are told
apart by 64-bit hashes. Texts of any length are read whole, a batch at a time. Ties
of `a` go to the least. Other columns, whatever their names, are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import ROLL, by_batch, mix, record, signed, store, table, text_bytes, tune, word_hashes

CLASSES = SUBS = 16
FEATURES = 3
LEAST_ROWS, MOST_ROWS, TOKENS_A_ROW = 1 << 14, 1 << 16, 32
ORDER = (0, 2, 1)
GRID = (0.5, 2.0, 8.0, 30.0, 100.0, 300.0, 1000.0, 1e5)
STEP = 1 << 16
RANGE = 1 << 11
FREQUENT = 2_000_000
WINDOW = 1 << 22

END = np.uint64(0x1D8AF066A3D9F1C7)  # the end's own hash value
START = np.uint64(0x5BD1E995F00DCAFE)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, one after the other, and the number of each text's."""
    h, n = word_hashes(texts)
    n = n + 1
    out = np.empty(len(h) + len(n), np.uint64)
    ends = np.cumsum(n) - 1
    words = np.ones(len(out), bool)
    words[ends] = False
    out[words] = h
    out[ends] = END
    return out, n


def features(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(FEATURES, tokens): hashes of each token's history: the word before, the one before that, both."""
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    starts = np.cumsum(n) - n
    one[starts] = START
    two[starts] = START
    second = starts[n > 1] + 1
    two[second] = START
    return np.stack([mix(one + np.uint64(3)), mix(two + np.uint64(5)), mix(one * ROLL + two)])


def rows_for(tokens: int) -> int:
    """Rows of a feature: a power of two that follows the number of training tokens."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << max(0, tokens // TOKENS_A_ROW).bit_length()))


def groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and sub-class of each word."""
    g = mix(h ^ START) >> np.uint64(56)
    return (g >> np.uint64(4)).astype(np.uint8), (g & np.uint64(15)).astype(np.uint8)


class Model:
    """Weight rows of the two softmaxes: `a` chosen by a feature's history, `b` by history and class."""

    def __init__(self, group_counts: np.ndarray, group_words: np.ndarray, rows: int = LEAST_ROWS) -> None:
        c = group_counts.reshape(CLASSES, SUBS) + 0.5
        self.bias_a = np.log(c.sum(1) / c.sum()).astype(np.float32)
        self.bias_b = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)
        self.rest = np.log10(group_counts + group_words + 1.0)  # of the third factor
        self.rows, self.learnt = rows, {}  # feature -> (a, b)

    def keys(self, f: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of `a` and of `b` that histories and classes choose."""
        r = np.uint64(self.rows - 1)
        return (f & r).astype(np.intp), (mix(f ^ (c.astype(np.uint64) + np.uint64(1)) * ROLL) & r).astype(np.intp)

    def shares(self, f: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all classes, and of all sub-classes of the own class, for each token."""
        za, zb = self.bias_a[None, :].repeat(len(c), 0), self.bias_b[c]
        for k, (a, b) in self.learnt.items():
            ka, kb = self.keys(f[k], c)
            za += a[ka]
            zb += b[kb]
        one = np.ones(CLASSES, np.float32)
        for z in (za, zb):
            np.exp(z, out=z)
            z /= (z @ one)[:, None]
        return za, zb

    def log10(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Per text, the sum over its tokens of log10 of all but a word's own count."""
        f, (c, s) = features(h, n), groups(h)
        out = np.empty(len(h))
        for i in range(0, len(h), STEP):
            e = slice(i, i + STEP)
            ci, si = c[e].astype(np.intp), s[e].astype(np.intp)
            at = np.arange(len(ci))
            a, b = self.shares(f[:, e], ci)
            out[e] = np.log10(a[at, ci]) + np.log10(b[at, si]) - self.rest[ci * SUBS + si]
        return np.add.reduceat(out, np.cumsum(n) - n) if len(n) else np.zeros(0)

    def stepped(self, feature: int, sums: np.ndarray) -> Model:
        """This model with the rows of one feature, from observed and expected counts (2, 2, rows, CLASSES)."""
        out = Model.__new__(Model)
        out.__dict__ |= self.__dict__ | {"learnt": self.learnt | {feature: (scaled(*sums[0]), scaled(*sums[1]))}}
        return out


class Gradient:
    """Observed and expected counts of one feature's rows."""

    def __init__(self, model: Model, feature: int) -> None:
        self.model, self.feature = model, feature
        self.observed, self.expected = np.zeros((2, model.rows, CLASSES), np.float32), np.zeros((2, CLASSES, model.rows), np.float32)
        self.classes = None if model.learnt else np.zeros((model.rows, CLASSES), np.float32)  # of the rows of `b`

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        f, (c, s) = features(h, n), groups(h)
        for i in range(0, len(h), STEP):
            e = slice(i, i + STEP)
            ci, si = c[e].astype(np.intp), s[e].astype(np.intp)
            keys = self.model.keys(f[self.feature, e], ci)
            for k, y in ((0, ci), (1, si)):
                np.add.at(self.observed[k].reshape(-1), keys[k] * CLASSES + y, np.float32(1))
            if self.classes is not None:  # shares are still those of the biases: counts are enough
                np.add.at(self.classes.reshape(-1), keys[1] * CLASSES + ci, np.float32(1))
                continue
            for k, p in enumerate(self.model.shares(f[:, e], ci)):
                for y, column in enumerate(np.ascontiguousarray(p.T)):
                    self.expected[k, y] += np.bincount(keys[k], column, self.model.rows)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if self.classes is not None:
            return self.observed, np.stack([self.observed[0].sum(1, keepdims=True) * np.exp(self.model.bias_a), self.classes @ np.exp(self.model.bias_b)])
        return self.observed, self.expected.transpose(0, 2, 1)


def scaled(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Weights of rows from observed and expected counts; rows never met get none."""
    n = observed.sum(1, keepdims=True, dtype=np.float64)
    out, kind = np.zeros(observed.shape, np.float32), np.floor(np.log2(np.maximum(n[:, 0], 1)) / 2).astype(int)
    for x in np.unique(kind[n[:, 0] > 0]):
        rows = np.flatnonzero((kind == x) & (n[:, 0] > 0))
        o, m = observed[rows].astype(np.float64), n[rows]
        share = np.maximum(expected[rows] / m, 1e-9)
        met = o > 0
        left = [float((o[met] * np.log(np.maximum((o - 1 + a * share) / (m - 1 + a) / share, 1e-12)[met])).sum()) for a in GRID]
        a = GRID[int(np.argmax(left))]
        out[rows] = np.log((o / share + a) / (m + a))
    return out


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token stands in docs (b); summed over windows of tokens before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return record(h=pa.array(signed(h)), c=pa.array(c.astype(np.int64)))

        for batch in batches:
            held.append(tokens(batch.column(0).to_pylist())[0])
            size += len(held[-1])
            if size >= WINDOW:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return docs.select("b").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def group_totals(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words of each sub-class: CLASSES * SUBS rows reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words = np.zeros(CLASSES * SUBS, np.int64), np.zeros(CLASSES * SUBS, np.int64)
        for batch in batches:
            c, s = groups(batch.column(0).to_numpy().view(np.uint64))
            g = c.astype(np.int64) * SUBS + s
            np.add.at(n, g, batch.column(1).to_numpy())
            np.add.at(words, g, 1)
        yield record(g=pa.array(np.arange(CLASSES * SUBS)), n=pa.array(n), words=pa.array(words))

    n, words = np.zeros(CLASSES * SUBS, np.int64), np.zeros(CLASSES * SUBS, np.int64)
    for r in counts.select("h", "c").mapInArrow(run, "g long, n long, words long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        n[r.g], words[r.g] = r.n, r.words
    return n, words


def train(docs: DataFrame, model: Model, feature: int) -> Model:
    """One round: the gradient of one feature's rows over all documents (b), and a step along it."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    shape = (-1, 2, CLASSES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Gradient(held.value, feature)
        for batch in batches:
            own.add(*tokens(batch.column(0).to_pylist()))
        observed, expected = own.sums()
        for k in range(2):
            for i in range(0, own.model.rows, RANGE):
                o, e = observed[k, i : i + RANGE], expected[k, i : i + RANGE]
                n = o.sum(1, keepdims=True)
                used = np.flatnonzero(n)
                if len(used):  # shares of the expected counts, in half precision: a third of the bytes
                    yield record(key=pa.array([k * own.model.rows + i]), rows=pa.array([used.astype(np.uint16).tobytes()], pa.binary()), o=pa.array([o[used].astype(np.uint32).tobytes()], pa.binary()), e=pa.array([(e[used] / n[used]).astype(np.float16).tobytes()], pa.binary()))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, rows, o, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o = np.frombuffer(o, np.uint32).reshape(-1, CLASSES).astype(np.float32)
                total = sums.setdefault(key, np.zeros((RANGE, 2, CLASSES), np.float32))
                total[np.frombuffer(rows, np.uint16), 0] += o
                total[np.frombuffer(rows, np.uint16), 1] += np.frombuffer(e, np.float16).reshape(-1, CLASSES).astype(np.float32) * o.sum(1, keepdims=True)
        yield from packed(sums)

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(w, np.float32).reshape(shape)
                sums[key] = sums[key] + part if key in sums else part
        yield from packed(sums)

    def packed(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for key, w in sums.items():
            yield record(key=pa.array([key]), w=pa.array([w.tobytes()], pa.binary()))

    parts = docs.select("b").mapInArrow(run, "key long, rows binary, o binary, e binary").withColumn("task", F.floor(F.spark_partition_id() / 64)).repartition("key", "task")
    sums = parts.drop("task").mapInArrow(add, "key long, w binary").repartition("key").mapInArrow(again, "key long, w binary")
    out = np.zeros((2, model.rows, 2, CLASSES), np.float32)
    for r in sums.toLocalIterator():  # of fixed size in all
        k, i = divmod(r.key, model.rows)
        out[k, i : i + RANGE] = np.frombuffer(bytes(r.w), np.float32).reshape(shape)
    return model.stepped(feature, out.transpose(0, 2, 1, 3))


def frequent_words(counts: DataFrame, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (sorted) and counts of all words of at least the third value's count; at most limit of them."""
    left, least = limit, 1 << 12
    for r in counts.groupBy(F.least("c", F.lit(least)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        if r.words > left:
            least = r.n + 1
            break
        left, least = left - r.words, r.n
    top = counts.where(F.col("c") >= least).toArrow() if left < limit else None
    if top is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 1 << 62
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    o = np.argsort(h)
    return h[o], c[o], least


def score_documents(docs: DataFrame, learn: DataFrame, order: tuple[int, ...] = ORDER, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs (doc_id, text), scored by a model of the rows of learn (text)."""
    spark = docs.sparkSession
    tune(spark)
    texts = learn.select(text_bytes())
    counts = store(count_words(texts))
    group_counts, group_words = group_totals(counts)
    total, words = int(group_counts.sum()), int(group_words.sum())
    model = Model(group_counts, group_words, rows_for(total))
    for feature in order if total else ():
        model = train(texts, model, feature)
    often, times, least = frequent_words(counts, frequent)
    held = spark.sparkContext.broadcast((model, often, np.log10(times + 1.0)))
    all_words = len(often) == words
    rare_kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, often, logs = held.value
        h, n = tokens(batch.column(2).to_pylist())
        starts = np.cumsum(n) - n
        if len(often):
            at = np.minimum(np.searchsorted(often, h), len(often) - 1)
            hit = often[at] == h
            own = np.where(hit, logs[at], 0.0)
        else:
            hit, own = np.zeros(len(h), bool), np.zeros(len(h))
        rare: list[list[dict] | None] = [None] * len(n)
        if not all_words:
            text = np.repeat(np.arange(len(n)), n)[~hit]
            order = np.lexsort((h[~hit], text))
            t, x = text[order], h[~hit][order]
            first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])])) if len(t) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([first, [len(t)]]))
            for i, v, k in zip(t[first].tolist(), signed(x[first]).tolist(), size.tolist(), strict=True):
                if rare[i] is None:
                    rare[i] = []
                rare[i].append({"h": v, "n": k})
        return record(row_id=batch.column(0), doc_id=batch.column(1), n_tokens=pa.array(n), n_known=pa.array(np.add.reduceat(hit.astype(np.int64), starts)), own=pa.array(np.add.reduceat(own, starts)), rest=pa.array(m.log10(h, n)), rare=pa.array(rare, rare_kind))

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    scored = by_batch(rows, run, "row_id long, doc_id long, n_tokens long, n_known long, own double, rest double, rare array<struct<h:long,n:long>>")
    if not all_words:
        scored = store(scored)
        found = scored.where("rare is not null").select("row_id", F.explode("rare").alias("x")).select("row_id", "x.h", "x.n").join(counts.where(F.col("c") < least), "h")
        sums = found.groupBy("row_id").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("gain"))
        scored = scored.drop("rare").join(sums, "row_id", "left")
    else:
        scored = scored.withColumns({"more": F.lit(0), "gain": F.lit(0.0)})
    own = F.col("own") + F.coalesce("gain", F.lit(0.0))
    base = own - F.col("n_tokens") * math.log10(total + words + 1)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (own + F.col("rest")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, docs.where(~held_out()))
