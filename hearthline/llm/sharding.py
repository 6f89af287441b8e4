"""Sharding by minimax contiguous partition.

Atoms are groups of equal texts (equal 64-bit hash), ordered by that hash. The
smallest capacity for which the ordered atoms fit into the shards is found by
binary search, each capacity being checked greedily, and the shards are cut
there, each cut as near to an equal share as that capacity allows.

The driver never holds the atoms. It holds segments: sums over ranges of the
hash, at most 2^BITS at first. On segments a greedy check gives a capacity that
surely suffices (cuts between segments only) and one that surely doesn't (cuts
anywhere inside). Ranges that a cut can fall into are split further until both
agree, which happens after a few rounds, as each makes the segments 2^MORE_BITS times finer.
Only DataFrame functions run on the data, and no text is moved: each row's hash,
size and checksum are computed where it is read.

Null texts count as empty and share the empty text's group. Texts of any length are
hashed and measured whole; one longer than an equal share fills its shard. A null
doc_id changes nothing: rows are placed by text, and come first among equal texts.
An empty table gives no rows; with fewer groups than shards some shards are empty.
Repeated rows are rows of their own in the shard of their text; ties of doc_id are
broken by place only among equal rows, of which those that are more than a thousandth
of the table are dealt to bins by a number of their own. Other columns are left aside, whatever their
names. Law: `bytes`; grown_shard is null.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.llm.common import copies_numbered, cut, table

SHARDS = 40
OVERHEAD = 16
BITS, MORE_BITS = 13, 6
SLOT_ROWS = 2000


@dataclass(frozen=True)
class Segment:
    """Consecutive atoms: first hash, bytes, number of atoms, size of the largest."""

    first: int
    size: int
    atoms: int
    largest: int
    low: int  # the range of hashes it stands for
    high: int


def _shift(level: int) -> int:
    return max(0, 64 - BITS - MORE_BITS * (level - 1))


def _segments(atoms: DataFrame, level: int, where: Column | None = None) -> list[Segment]:
    s = _shift(level)
    rows = (atoms if where is None else atoms.where(where)).groupBy(F.shiftright("h", s).alias("p")).agg(F.min("h").alias("first"), F.sum("bytes").alias("size"), F.count("*").alias("atoms"), F.max("bytes").alias("largest"))
    return [Segment(r.first, r.size, r.atoms, r.largest, r.p << s, (r.p << s) + (1 << s) - 1) for r in rows.select("p", "first", "size", "atoms", "largest").orderBy("first").collect()]


class Line:
    """Segments in order with the running sums of their sizes."""

    def __init__(self, segments: list[Segment]) -> None:
        self.segments, self.ends = segments, []
        total = 0
        for s in segments:
            total += s.size
            self.ends.append(total)
        self.total = total

    def start(self, i: int) -> int:
        return self.ends[i] - self.segments[i].size

    def at(self, place: int) -> int:
        """The segment that holds this place, or that ends there."""
        return min(bisect.bisect_left(self.ends, place), len(self.ends) - 1)

    def reach(self, place: int, capacity: int, inside: bool) -> int:
        """How far a shard that begins at place gets: to a segment's end, or (inside) also into one of several atoms."""
        stop = place + capacity
        if stop >= self.total:
            return self.total
        i = bisect.bisect_right(self.ends, stop)  # the segment that stop falls into
        if inside and self.segments[i].atoms > 1:
            return stop
        return self.start(i)

    def fits(self, capacity: int, shards: int, inside: bool) -> bool:
        place = 0
        for _ in range(shards):
            if place >= self.total:
                break
            if (there := self.reach(place, capacity, inside)) <= place:
                return False
            place = there
        return place >= self.total

    def least(self, shards: int, inside: bool) -> int:
        """Binary search of the smallest capacity that fits."""
        low = max(-(-self.total // shards), max(s.largest for s in self.segments))
        high = max(low, self.total)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards, inside) else (middle + 1, high)
        return low

    def doubtful(self, low: int, high: int, shards: int) -> list[tuple[int, int]]:
        """Spans of segments that a cut can fall into for a capacity from low to high."""
        out = []
        a = b = 0
        for _ in range(shards):
            if a >= self.total:
                break
            i = self.at(min(a + low, self.total))
            a = max(a, min(a + low, self.total) - self.segments[i].largest)
            b = min(b + high, self.total)
            out.append((self.at(a), self.at(b)))
        return out

    def about(self, places: list[float]) -> list[tuple[int, int]]:
        """The segments before and after each place."""
        last = len(self.segments) - 1
        return [(i, min(i + 1, last)) for i in (self.at(p) for p in places)]

    def splittable(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Disjoint spans that hold all segments of several atoms in these."""
        inner = sorted({i for a, b in spans for i in range(a, b + 1) if self.segments[i].atoms > 1})
        held, out = [x for x in sorted(spans)], []
        for i in inner:
            if out and any(a <= out[-1][1] and i <= b for a, b in held):
                out[-1] = (out[-1][0], i)
            else:
                out.append((i, i))
        return out

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Places of the cuts: each as near to an equal share of what is left as the capacity allows."""
        latest, place = [], self.total  # the earliest place from which the rest fits, from the last shard on
        for _ in range(shards - 1):
            i = bisect.bisect_left(self.ends, place - capacity) if place > capacity else -1
            place = 0 if i < 0 else self.ends[i]
            latest.append(place)
        out, place = [], 0
        for j, least in enumerate(reversed(latest)):
            ideal = place + (self.total - place) / (shards - j)
            i = bisect.bisect_left(self.ends, ideal)
            options = [self.ends[k] for k in (i - 1, i) if 0 <= k < len(self.ends)] + [place, least, self.reach(place, capacity, False)]
            options = [x for x in options if max(place, least) <= x <= place + capacity]
            place = min(options, key=lambda x: (abs(x - ideal), x))
            out.append(place)
        return out


def minimax_cuts(atoms: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """The least capacity, and the first hash of each shard after the first (shards left empty at the end have none)."""
    line, level = Line(_segments(atoms, 1)), 1
    if not line.segments:
        return 0, []
    while True:
        low, high = line.least(shards, True), line.least(shards, False)
        spans = line.splittable(line.doubtful(low, high, shards) if low < high else line.about([*line.cuts(high, shards), *(line.total * (j + 1) / shards for j in range(shards - 1))]))
        if not spans or _shift(level) == 0:
            break
        level += 1
        ranges = [(line.segments[a].low, line.segments[b].high) for a, b in spans]
        parts = _segments(atoms, level, F.expr(" or ".join(f"h between {a} and {b}" if a > -(1 << 63) else f"h <= {b}" for a, b in ranges)))
        gone = {i for a, b in spans for i in range(a, b + 1)}
        line = Line(sorted([s for i, s in enumerate(line.segments) if i not in gone] + parts, key=lambda s: s.first))
    firsts = []
    for place in line.cuts(high, shards):
        i = bisect.bisect_right(line.ends, place)
        if i < len(line.segments):
            firsts.append(line.segments[i].first)
    return high, firsts


def shard_documents(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    atoms = cut(rows.groupBy("h").agg(F.sum("size").alias("bytes")))
    _, firsts = minimax_cuts(atoms, shards)
    shard = F.lit(0)
    for first in firsts:
        shard = shard + (F.col("h") >= first).cast("int")
    bins = max(1, min(4096, rows.count() // (shards * SLOT_ROWS)))
    bin_ = F.when(F.col("copy") == 0, F.xxhash64("doc_id", "h")).otherwise(F.xxhash64("doc_id", "h", "copy"))
    placed = cut(copies_numbered(rows).withColumn("shard", shard).withColumn("bin", F.pmod(bin_, F.lit(bins)).cast("int")))
    sums = placed.groupBy("shard", "bin").agg(F.count("*").alias("n"))  # at most shards * 4096 rows
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "bin").orderBy("doc_id", "h")
    placed = placed.join(F.broadcast(sums), ["shard", "bin"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.row_number().over(order) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
