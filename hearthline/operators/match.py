"""Pairs of upstream and aggregator listings of one building: tolerance join, one-to-one choice, clocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions import text as T
from hearthline.functions import times

TOLERANCE, BEDS_APART, PLAUSIBLE_DAYS = 0.04, 0.01, 60
CENSORED = "censored:present-at-first-crawl"


def building() -> Column:
    return T.first_filled("bin", "bbl")


def clock(listed_at: Column | str = "listed_at", first_seen: Column | str = "first_seen") -> Column:
    """The publisher's time if there is one, else ours, with the clock's name."""
    listed, seen = ((F.col(c) if isinstance(c, str) else c) for c in (listed_at, first_seen))
    return F.struct(F.coalesce(listed, seen).alias("time"), F.when(listed.isNotNull(), "listed_at").otherwise("first_seen").alias("clock"))


def candidates(listings: DataFrame, upstream: list[str], aggregators: list[str], tolerance: float = TOLERANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of one building, beds equal where both are known, rents within the tolerance.

    listings has fingerprint, source, bin, bbl, beds, price and optionally `ordinal`
    (the order of ties; else the fingerprint). Columns named in carry go along as
    u_<name> and a_<name>. An equi-join on the building with the
    rest as residual condition: AQE splits a skewed building, and rent buckets keep
    a large one from meeting all of itself.
    """
    own = listings.where(building().isNotNull() & F.col("price").isNotNull()).withColumn("building", building())
    order = F.col("ordinal") if "ordinal" in listings.columns else F.lit(0)
    # a pair's rents differ by at most the tolerance, so their logarithms' cells are equal or next to each other
    cell = F.floor(F.log(F.greatest(F.col("price").cast("double"), F.lit(1.0))) / -F.log(F.lit(1.0 - tolerance - 1e-9))) if tolerance > 0 else F.col("price").cast("long")
    more = lambda p: [F.col(c).alias(f"{p}_{c}") for c in carry]
    side = lambda sources, p: own.where(F.col("source").isin(sources)).select("building", F.col("fingerprint").alias(f"{p}_fp"), F.col("source").alias(f"{p}_source"), F.col("beds").alias(f"{p}_beds"), F.col("price").alias(f"{p}_price"), order.alias(f"{p}_order"), cell.cast("long").alias("cell"), *more(p))
    a, u = side(aggregators, "a"), side(upstream, "u")
    if tolerance > 0:
        u = u.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    gap = F.abs(F.col("u_price") - F.col("a_price")) / F.greatest("u_price", "a_price")
    near = (F.col("u_price") == F.col("a_price")) | (gap <= tolerance)
    beds = F.coalesce(F.abs(F.col("u_beds") - F.col("a_beds")) <= BEDS_APART, F.lit(True))
    pairs = u.join(a, ["building", "cell"]).where(beds & near)
    exact = F.col("u_price") == F.col("a_price")
    return pairs.select("building", "u_fp", "a_fp", "u_source", "a_source", "u_price", "a_price", "u_order", "a_order", F.when(exact, 0.0).otherwise(gap).alias("penalty"), F.when(exact, "building+beds+price").otherwise("building+beds+near-price").alias("matched_by"), *[f"{p}_{c}" for p in "ua" for c in carry])


def assign(pairs: DataFrame) -> DataFrame:
    """The pairs that a greedy pass by (penalty, order, fingerprint) takes, no side twice.

    A building's pass is independent of all others. Spark sorts its pairs (and
    spills them); the pass streams over them and holds the sides taken so far, not
    the pairs.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    columns = pairs.columns
    place = [columns.index(c) for c in ("building", "u_fp", "a_fp")]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ups, aggs = None, set(), set()
        for batch in batches:
            rows = []
            for i, (building, u, a) in enumerate(zip(*(batch.column(k).to_pylist() for k in place), strict=True)):
                if building != here:
                    here, ups, aggs = building, set(), set()
                if u not in ups and a not in aggs:
                    ups.add(u)
                    aggs.add(a)
                    rows.append(i)
            if rows:
                yield pa.RecordBatch.from_arrays([c.take(pa.array(rows)) for c in batch.columns], names=columns)

    order = ["building", "penalty", "u_order", "a_order", "u_fp", "a_fp"]
    return pairs.repartition("building").sortWithinPartitions(*order).mapInArrow(take, kinds)


def second_runs(runs: DataFrame) -> DataFrame:
    """Per source the start of its second run (null with one run only)."""
    w = Window.partitionBy("source").orderBy("started_at", *(["id"] if "id" in runs.columns else []))
    ranked = runs.withColumn("_k", F.row_number().over(w))
    return ranked.groupBy("source").agg(F.max(F.when(F.col("_k") == 2, F.col("started_at"))).alias("second_run"), F.lit(True).alias("has_runs"))


def matches(listings: DataFrame, runs: DataFrame, upstream: list[str], aggregators: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """One-to-one pairs with their times and the basis that says which clocks were compared."""
    # what the pairs need of their listings goes along, so that they needn't be joined to them again
    out = assign(candidates(listings.withColumn("c", clock()), upstream, aggregators, tolerance, ("c", "first_seen", "address", "unit_key")))
    cutoffs = second_runs(runs).withColumnRenamed("source", "u_source")
    out = out.join(cutoffs, "u_source", "left")
    censored = (F.col("u_c.clock") == "first_seen") & F.coalesce("has_runs", F.lit(False)) & (F.col("second_run").isNull() | (F.col("u_first_seen") < F.col("second_run")))
    basis = F.when(censored, CENSORED).otherwise(F.concat_ws("->", F.col("u_c.clock"), F.col("a_c.clock")))
    return out.select("building", F.col("u_fp").alias("upstream_fp"), F.col("a_fp").alias("aggregator_fp"), F.col("a_source").alias("aggregator"), "matched_by", "penalty", F.col("u_c.time").alias("upstream_time"), F.col("a_c.time").alias("aggregator_time"), basis.alias("basis"), F.col("u_address").alias("address"), F.col("u_unit_key").alias("unit"), F.col("u_price").alias("price"))


def implausible(days: float = PLAUSIBLE_DAYS) -> Column:
    return F.abs(times.hours_between("upstream_time", "aggregator_time")) / 24.0 > days
