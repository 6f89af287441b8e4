"""Near-duplicate vectors: sign hashing in several tables, exact cosines, components.

Equal vectors become one representative with a weight. Each table has BITS random
hyperplanes (fixed seed); the signs of the projections name a bucket. The number
of tables is such that a pair at the threshold meets in one of them with the
probability RECALL, and pairs of higher cosine with more. Bits grow with the
logarithm of the number of vectors, so buckets stay small on the whole.

Within a bucket all cosines are computed in double precision, by blocks: a bucket
of more than BLOCK vectors is cut into parts, and each pair of parts is a unit of
its own, so that no task holds a large group and no pair is ever a row. A pair
that meets in several tables counts in the first only (each row carries all its
hashes, two bytes each, so that placing and counting can't differ). A unit gives one row per linked vector: the weights of its partners and
the least id its links reach there. The links' components are found in
distributed rounds.

Vectors that are null, zero, or hold null or non-finite components link with
nothing: n_links 0 and the own id as component; so do rows of a null vec_id
(kept false). Vectors of different lengths never link. Repeated rows are copies:
each counts the others; rows of one vec_id with different vectors are placed by
their own vector. A pair of exactly the threshold links; of equal ids or partners the
least id names the component. An empty table gives no rows. Other columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import cut, record, table, tune
from hearthline.llm.components import components

THRESHOLD = 0.9
RECALL = 0.995
BLOCK = 1024
SEED = 20


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors."""
    bits = max(8, min(16, int(math.log2(max(2, n))) - 6))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def planes(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, bits * tables))


def hashes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of each row of x in each table."""
    signs = (x @ planes(x.shape[1], bits, tables) > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose lists have one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def buckets(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """vectors (rep, w, v) with `buckets`, one per table, and the same as bytes (`own`)."""
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                h = hashes(_matrix(part.column(2)), bits, tables)
                yield record(rep=part.column(0), w=part.column(1), v=part.column(2), buckets=pa.array(list(h), pa.list_(pa.int64())), own=pa.array([x.tobytes() for x in h.astype(np.uint16)], pa.binary()))

    return vectors.select("rep", "w", "v").mapInArrow(run, f"rep long, w long, v {kind}, buckets array<long>, own binary")


def block_links(reps: np.ndarray, w: np.ndarray, x: np.ndarray, chunk: np.ndarray, h: np.ndarray, t: int, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row its partners' weights that no earlier table has counted, and the least id its links reach."""
    close = np.triu(x @ x.T >= threshold, 1)
    if cross:
        close &= chunk[:, None] != chunk[None, :]
    a, b = np.nonzero(close)
    counts, label = np.zeros(len(reps), np.int64), reps.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        if (before == label).all():
            break
    for s in range(0, len(a), 1 << 20):
        p, q = a[s : s + (1 << 20)], b[s : s + (1 << 20)]
        new = np.ones(len(p), bool)
        for k in range(t):
            new &= h[p, k] != h[q, k]
        np.add.at(counts, p[new], w[q[new]])
        np.add.at(counts, q[new], w[p[new]])
    return counts, label


def links(units: DataFrame, threshold: float) -> DataFrame:
    """(rep, n, least) from rows of (t, bucket, size, i, j, chunk, rep, w, v, own), sorted by unit in each partition."""

    def solve(t: int, cross: bool, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
        if whole.num_rows < 2:
            return None
        reps, w, chunk = (whole.column(k).to_numpy() for k in (6, 7, 5))
        h = np.stack([np.frombuffer(b, np.uint16) for b in whole.column(9).to_pylist()])
        counts, label = block_links(reps, w, _matrix(whole.column(8)), chunk, h, t, cross, threshold)
        on = np.flatnonzero((counts > 0) | (label != reps))
        return record(rep=pa.array(reps[on]), n=pa.array(counts[on]), least=pa.array(label[on])) if len(on) else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(edges, edges[1:], strict=False):
                if (key := tuple(keys[s].tolist())) != unit:
                    if parts and (out := solve(unit[0], unit[3] != unit[4], parts)) is not None:
                        yield out
                    unit, parts = key, []
                parts.append(batch.slice(s, e - s))
        if parts and (out := solve(unit[0], unit[3] != unit[4], parts)) is not None:
            yield out

    return units.select("t", "bucket", "size", "i", "j", "chunk", "rep", "w", "v", "own").mapInArrow(run, "rep long, n long, least long")


def dedup_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    tune(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    reps = cut(rows.where("sound").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")))
    bits, tables = plan(reps.count(), threshold, recall)
    hashed = cut(buckets(reps, bits, tables))
    keyed = hashed.select("rep", "w", "v", "own", F.size("v").alias("size"), F.posexplode("buckets").alias("t", "bucket"))
    large = keyed.groupBy("t", "size", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = large.select("t", "size", "bucket", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    placed = keyed.join(large, ["t", "size", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    unit = ["t", "bucket", "size", "i", "j"]
    found = cut(links(placed.repartition(*unit).sortWithinPartitions(*unit), threshold).groupBy("rep", "least").agg(F.sum("n").alias("n")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    linked = components(found.select(F.col("rep").alias("u"), F.col("least").alias("v"))).withColumnRenamed("id", "rep")
    classes = reps.join(counts, "rep", "left").join(linked, "rep", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("sound").join(classes, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_vectors(table(spark, sf_dir, "embeddings"))
