"""The lead-time ledger: first hit wins, the basis is kept, unlike clocks are counted and left out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.cluster import cut
from hearthline.functions import times
from hearthline.operators import match as M

SMALL_SAMPLE = 30


def open_entries(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with an entry for each new fingerprint (fingerprint, first_seen); known ones stay as they are."""
    add = new.groupBy("fingerprint").agg(F.min("first_seen").alias("our_first_seen")).join(ledger.select("fingerprint"), "fingerprint", "left_anti")
    return ledger.unionByName(add, allowMissingColumns=True)


def judge(matches: DataFrame, ledger: DataFrame, days: float = M.PLAUSIBLE_DAYS) -> DataFrame:
    """matches with `outcome`: unusable (no time, or unknown to the ledger), implausible, already or recorded; and lead_hours."""
    known = ledger.select(F.col("fingerprint").alias("upstream_fp"), F.col("aggregator_seen").isNotNull().alias("_measured"), F.col("lead_hours").alias("_lead"), F.lit(True).alias("_known"))
    rows = matches.join(known, "upstream_fp", "left")
    timeless = F.col("upstream_time").isNull() | F.col("aggregator_time").isNull()
    outcome = F.when(timeless, "unusable").when(M.implausible(days), "implausible").when(F.col("_known").isNull(), "unusable").when(F.col("_measured"), "already").otherwise("recorded")
    lead = times.hours_between("upstream_time", "aggregator_time")
    rows = rows.withColumn("outcome", outcome)
    return rows.withColumn("lead_hours", F.when(F.col("outcome") == "recorded", lead).when(F.col("outcome") == "already", F.col("_lead"))).drop("_measured", "_lead", "_known")


def record(ledger: DataFrame, judged: DataFrame) -> DataFrame:
    """The ledger with the recorded measurements; an entry that has one is never written again."""
    hit = judged.where("outcome = 'recorded'").select(F.col("upstream_fp").alias("fingerprint"), F.struct(F.col("upstream_time").alias("our_first_seen"), "aggregator", F.col("aggregator_time").alias("aggregator_seen"), "lead_hours", "basis", "matched_by", F.col("aggregator_fp").alias("matched_fp")).alias("h"))
    rows = ledger.join(hit, "fingerprint", "left")
    return rows.select(*[F.when(F.col("h").isNotNull(), F.col(f"h.{c}")).otherwise(F.col(c)).alias(c) if c != "fingerprint" else F.col(c) for c in ledger.columns])


def run_counters(judged: DataFrame) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    return judged.agg(F.count("*").alias("pairs_found"), n("recorded").alias("recorded"), n("already").alias("already_measured"), n("unusable").alias("unusable"), n("implausible").alias("implausible"), F.count_if(F.col("matched_by") == "building+beds+price").alias("exact_price"))


def comparable(basis: Column | str = "basis") -> Column:
    """Both sides used the same clock and neither is censored."""
    b = F.col(basis) if isinstance(basis, str) else basis
    sides = F.split(b, "->", 2)
    return F.coalesce(~b.startswith("censored:") & (F.size(sides) == 2) & (F.try_element_at(sides, F.lit(1)) == F.try_element_at(sides, F.lit(2))), F.lit(False))


def _placed(counts: DataFrame) -> DataFrame:
    """counts (v, c) with `part`, their range of values; kept, so that all uses see the same ranges and nothing is counted twice."""
    return cut(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))


def _indexed(ranged: DataFrame, shares: dict[str, float]) -> DataFrame:
    ranged = ranged.where("v is not null")
    n = ranged.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    sums = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as partitions
    before = ranged.groupBy("part").agg(F.sum("c").alias("s")).select("part", F.coalesce(F.sum("s").over(sums), F.lit(0)).alias("before"))
    upto = ranged.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v")))
    index = {k: max(1, math.floor(n * s)) if s < 0.5 else min(n, math.floor(n * s) + 1) for k, s in shares.items()} | {"m1": (n + 1) // 2, "m2": n // 2 + 1}
    return upto.agg(*[F.min(F.when(F.col("upto") >= i, F.col("v"))).alias(k) for k, i in index.items()])


def indexed_quantiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: the values at indexes of the sorted values, and of the median's two (`m1`, `m2`), without collecting them.

    Low shares count from the value before, high ones from the value after. Equal
    values are counted, ranges of the values summed and kept, then each range holds
    the indexes that fall into it.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    return _indexed(_placed(counts), shares)


def distribution(ledger: DataFrame) -> DataFrame:
    """One row: how many are measured, pending and excluded, and the order statistics of the comparable leads.

    Without any, the statistics are null and `note` says why. The ledger is read
    once, into counts of equal leads.
    """
    has = F.col("lead_hours").isNotNull()
    use = has & comparable()
    kinds = ledger.groupBy(F.when(use, F.col("lead_hours")).alias("v"), F.col("aggregator_seen").isNull().alias("pending"), (has & ~comparable()).alias("excluded")).agg(F.count("*").alias("c"))
    ranged = _placed(kinds)
    number = lambda on: F.coalesce(F.sum(F.when(on, F.col("c"))), F.lit(0))
    measured = number(F.col("v").isNotNull())
    share = lambda on: F.try_divide(number(on), measured)
    shape = ranged.agg(
        measured.alias("measured"), number(F.col("pending")).alias("pending"), number(F.col("excluded")).alias("excluded_mixed_basis"), F.try_divide(F.sum(F.col("v") * F.col("c")), measured).alias("a"),
        share(F.col("v") > 0).alias("s0"), share(F.col("v") >= 24).alias("s24"), share(F.col("v") >= 72).alias("s72"),
    )
    tails = _indexed(ranged, {"q10": 0.10, "q90": 0.90})
    r = lambda c, d: F.bround(F.col(c), d)
    note = F.when((F.col("measured") == 0) & (F.col("excluded_mixed_basis") > 0), F.format_string("%d pairs found, none of them usable yet", "excluded_mixed_basis")).when(F.col("measured") == 0, "no aggregator timestamps recorded yet")
    caveat = F.when((F.col("measured") > 0) & (F.col("measured") < SMALL_SAMPLE), "small sample")
    return shape.join(F.broadcast(tails)).select("measured", "pending", "excluded_mixed_basis", F.bround((F.col("m1") + F.col("m2")) / 2, 1).alias("median_hours"), r("a", 1).alias("mean_hours"), r("q10", 1).alias("p10_hours"), r("q90", 1).alias("p90_hours"), r("s0", 3).alias("share_ahead"), r("s24", 3).alias("share_ahead_24h"), r("s72", 3).alias("share_ahead_72h"), caveat.alias("caveat"), note.alias("note"))


def by_basis(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("lead_hours").isNotNull() & comparable()).groupBy("basis").agg(F.count("*").alias("n"))


def by_aggregator(ledger: DataFrame) -> DataFrame:
    """All rows with a lead count here, the excluded ones too."""
    return ledger.where("lead_hours is not null").groupBy("aggregator").agg(F.count("*").alias("n"))


def report(ledger: DataFrame) -> DataFrame:
    """distribution() with the two breakdowns as maps."""
    as_map = lambda df, key, name: df.where(F.col(key).isNotNull()).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n"))))).alias(name))
    return distribution(ledger).join(F.broadcast(as_map(by_basis(ledger), "basis", "basis"))).join(F.broadcast(as_map(by_aggregator(ledger), "aggregator", "vs")))
