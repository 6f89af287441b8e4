"""Language identification by a convolutional network over bytes.

Each window of WINDOW bytes (A-Z lower-cased, the last one filled up with zeros) goes
through FILTERS filters of every width in WIDTHS, the maximum of each over all places,
and a softmax layer. A filter sees its bytes one-hot, so its weights are one table of
256 rows for each of its places, and a convolution is a sum of table rows. Windows
overlap by the widest filter less one byte: every n-gram of a text is seen, the whole
text is read. A text's probabilities are its windows', weighted by their bytes.

The network is trained in numpy on the driver, with a fixed seed, from a bounded sample
of labelled texts: of the LANGUAGES most frequent languages, PER_LANGUAGE different texts
each and TEXTS in all at most, those of least hash, and of each up to PER_TEXT windows
spread over the whole text. What is broadcast is the network, below 1 MiB. Scoring looks
at each text alone, with no shuffle.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out of the sample, as are those of
null lang; a null doc_id is not held out. A null text, or one without a letter (\\p{L}),
is `und` with score 0; so is every text if there is nothing to learn from. Repeated
rows give the same result and count once for learning, ties of probability go to the
first language by code point. An empty table gives no rows. Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.llm.common import by_batch, cut, record, table, text_bytes, tune

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
LANGUAGES, PER_LANGUAGE, TEXTS, PER_TEXT = 512, 400, 8192, 8
STEPS, BATCH, RATE, DECAY, SEED = 1500, 64, 0.01, 1e-4, 5
CHUNK = 64
NONE = "und"


def windows(texts: list[bytes], window: int = WINDOW, step: int = WINDOW - max(WIDTHS) + 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with zeros behind, and each window's start there, its bytes and its text; an empty text has one window."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    number = 1 + -(-np.maximum(size - window, 0) // step)
    text = np.repeat(np.arange(len(texts)), number)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    begin = np.cumsum(size) - size
    used = np.minimum(size[text] - nth * step, window)
    return np.frombuffer(b"".join([*texts, bytes(window)]).lower(), np.uint8), begin[text] + nth * step, used, text


def cut_out(data: np.ndarray, start: np.ndarray, used: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The windows as rows of bytes, zero where their text has ended."""
    out = np.lib.stride_tricks.sliding_window_view(data, window)[start]
    short = np.flatnonzero(used < window)
    out[short] *= np.arange(window) < used[short, None]
    return out


class Network:
    """Filters of several widths over bytes, max pooling, softmax."""

    def __init__(self, classes: int, filters: int = FILTERS, widths: tuple[int, ...] = WIDTHS, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.widths, self.filters = widths, filters
        self.tables = [r.normal(0, 0.5 / w**0.5, (w, 256, filters)).astype(np.float32) for w in widths]
        self.offsets = [np.zeros(filters, np.float32) for _ in widths]
        self.out = r.normal(0, (filters * len(widths)) ** -0.5, (filters * len(widths), classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.offsets, self.out, self.bias]

    def responses(self, x: np.ndarray, k: int) -> np.ndarray:
        """What the filters of the k-th width answer at every place of the windows x: (windows, places, filters)."""
        w, t = self.widths[k], self.tables[k]
        places = x.shape[1] - w + 1
        sums = t[0].take(x[:, :places], 0)
        for i in range(1, w):
            sums += t[i].take(x[:, i : i + places], 0)
        return sums

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.concatenate([self.responses(x, k).max(1) + self.offsets[k] for k in range(len(self.widths))], 1), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(np.concatenate([self.pooled(x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]) @ self.out + self.bias)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of weights(); only the places of the maxima get any."""
        n, held, at = len(x), [], []
        for k in range(len(self.widths)):
            r = self.responses(x, k)
            at.append(r.argmax(1))
            held.append(np.take_along_axis(r, at[-1][:, None], 1)[:, 0] + self.offsets[k])
        raw = np.concatenate(held, 1)
        h = np.maximum(raw, 0)
        d = softmax(h @ self.out + self.bias)
        d[np.arange(n), y] -= 1
        d /= n
        back = (d @ self.out.T) * (raw > 0)
        tables, offsets, rows, f = [], [], np.arange(n)[:, None], np.arange(self.filters)
        for k, w in enumerate(self.widths):
            g = back[:, k * self.filters : (k + 1) * self.filters]
            t = np.zeros_like(self.tables[k])
            for i in range(w):
                np.add.at(t[i], (x[rows, at[k] + i], f), g)
            tables.append(t)
            offsets.append(g.sum(0))
        return [*tables, *offsets, h.T @ d, d.sum(0)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def trained(x: np.ndarray, used: np.ndarray, y: np.ndarray, classes: int, steps: int = STEPS, seed: int = SEED) -> Network:
    """A network fitted to windows x of class y: languages drawn alike, every other window cut to a random length, Adam with a falling rate."""
    r, net = np.random.default_rng(seed), Network(classes, seed=seed)
    order = np.argsort(y, kind="stable")
    start, number = np.searchsorted(y[order], np.arange(classes)), np.bincount(y, minlength=classes)
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    for step in range(1, steps + 1):
        c = r.integers(0, classes, BATCH)
        some = order[start[c] + (r.random(BATCH) * number[c]).astype(np.int64)]
        length = np.where(r.random(BATCH) < 0.5, used[some], 1 + (r.random(BATCH) * used[some]).astype(np.int64))
        batch = x[some] * (np.arange(x.shape[1]) < length[:, None])
        rate = RATE * (1 - (step - 1) / steps)
        for w, g, m, v in zip(net.weights(), net.gradients(batch.astype(np.uint8), y[some]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * w)
    return net


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, languages: int = LANGUAGES, per_language: int = PER_LANGUAGE, texts: int = TEXTS, per_text: int = PER_TEXT) -> pa.Table:
    """lang, window and used of the sample, out of rows of (doc_id, lang, b, letters); at most min(languages * per_language, texts) * per_text rows."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("letters")).select("lang", "b", F.xxhash64("b").alias("h"))
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    common = cut(common)
    each = min(per_language, texts // max(1, common.count()))
    different = rows.join(F.broadcast(common), "lang").select("lang", "h").distinct()  # at most `languages` rows are broadcast
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = cut(different.withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "h"))
    held = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("b").alias("b"))  # at most `texts` rows are broadcast

    def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, h, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, start, used, _ = windows([b])
                spread = np.unique(np.linspace(0, len(start) - 1, min(per_text, len(start))).astype(np.int64))
                x = cut_out(data, start[spread], used[spread])
                yield record(lang=pa.array([lang] * len(x), pa.string()), h=pa.array([h] * len(x), pa.int64()), x=pa.array([r.tobytes() for r in x], pa.binary()), used=pa.array(used[spread], pa.int64()))

    return held.mapInArrow(some, "lang string, h long, x binary, used long").toArrow().sort_by([(c, "ascending") for c in ("lang", "h", "x")])


def fit(docs: DataFrame) -> tuple[list[str], Network] | None:
    """The languages, by code point, and their network; None without labelled texts."""
    found = sample(docs)
    if not len(found):
        return None
    names = found.column("lang").to_pylist()
    languages = sorted(set(names))
    place = {x: k for k, x in enumerate(languages)}
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return languages, trained(x, found.column("used").to_numpy(), np.array([place[n] for n in names]), len(languages))


def predicted(model: tuple[list[str], Network] | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and probability of each text."""
    if model is None or not texts:
        return [NONE] * len(texts), [0.0] * len(texts)
    languages, net = model
    data, start, used, text = windows(texts)
    sums = np.zeros((len(texts), len(languages)))
    for i in range(0, len(start), 4096):
        part = slice(i, i + 4096)
        np.add.at(sums, text[part], net.probabilities(cut_out(data, start[part], used[part])) * np.maximum(used[part], 1)[:, None])
    total = np.bincount(text, np.maximum(used, 1), len(texts))
    best = sums.argmax(1)
    score = np.clip(sums[np.arange(len(texts)), best] / total, 0, 1)
    return [languages[k] for k in best], np.round(score, 6).tolist()


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs (doc_id, text, lang)."""
    tune(docs.sparkSession)
    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), letters, text_bytes())
    held = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        letters = batch.column(2).to_numpy(zero_copy_only=False)
        lang, score = np.full(len(letters), NONE, object), np.zeros(len(letters))
        some = np.flatnonzero(letters)
        if len(some):
            lang[some], score[some] = predicted(held.value, batch.column(3).take(pa.array(some)).to_pylist())
        return record(doc_id=batch.column(0), held_out=batch.column(1), lang_pred=pa.array(lang, pa.string()), score=pa.array(score))

    return by_batch(rows.select("doc_id", held_out().alias("held_out"), "letters", "b"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
