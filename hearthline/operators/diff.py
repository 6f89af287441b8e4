"""Change capture: one crawl's listings folded into the state, as joins and windows.

Everything is a function of DataFrames: (state, batch) -> (state', events, verdicts).
`first_seen` and all facts but last_seen, price, available_on, detail_url and
gone_at stay as first stored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDED = ("price", "available_on", "detail_url")


@dataclass(frozen=True)
class Diff:
    """verdicts has a row per row of the batch: fingerprint, ordinal, verdict, old_price, price; missing (fingerprint, source) is what the sweeps marked gone."""

    state: DataFrame
    events: DataFrame
    verdicts: DataFrame
    missing: DataFrame


def ordinals(batch: DataFrame, order: list[Column]) -> DataFrame:
    """The batch with `ordinal`, the place of a row among those of its fingerprint."""
    return batch.withColumn("ordinal", F.row_number().over(Window.partitionBy("fingerprint").orderBy(*order)))


def _judged(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch (fingerprint, source, turn, ordinal, price) with verdict, old_price, changed and what the sweep of the stored source means to them.

    state has fingerprint, price, gone_at, source and _sweep, the turn after which
    the stored source is swept (null: it isn't).
    """
    known = state.select("fingerprint", F.col("price").alias("_p"), F.col("gone_at").isNotNull().alias("_gone"), F.col("source").alias("_owner"), "_sweep", F.lit(True).alias("_known"))
    rows = batch.join(known, "fingerprint", "left")
    own = Window.partitionBy("fingerprint")
    before = own.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    unseen = F.col("_sweep").isNotNull() & ~F.coalesce(F.max(F.col("source") == F.col("_owner")).over(own), F.lit(False))
    rows = rows.withColumns({"old_price": F.coalesce(F.last("price", ignorenulls=True).over(before), F.col("_p")), "_later": unseen & (F.col("turn") > F.col("_sweep"))})
    first = F.col("ordinal") == 1
    new = first & F.col("_known").isNull()
    back = (first & F.coalesce("_gone", F.lit(False))) | (F.coalesce("_later", F.lit(False)) & ~F.coalesce(F.max("_later").over(before), F.lit(False)))
    changed = F.coalesce(F.col("price") != F.col("old_price"), F.lit(False)) & ~new
    verdict = F.when(new, "new").when(back, "relisted").when(changed, "price_change").otherwise("seen")
    return rows.withColumns({"verdict": verdict, "changed": changed})


def verdicts(state: DataFrame, batch: DataFrame) -> DataFrame:
    """What each row of the batch (fingerprint, ordinal, price) is to the state, earlier rows of the batch included.

    The old price is the last one known before the row. Only the first row of a
    fingerprint can be new or relisted.
    """
    none = F.lit(None)
    held = state.withColumns({"source": none.cast("string"), "_sweep": none.cast("int")})
    named = batch if "source" in batch.columns else batch.withColumn("source", none.cast("string"))
    rows = _judged(held, named.withColumn("turn", F.lit(0))).drop("_p", "_gone", "_owner", "_sweep", "_known", "_later", "turn")
    return rows if "source" in batch.columns else rows.drop("source")


def events_of(rows: DataFrame, observed_at: Column) -> DataFrame:
    """new, relisted and price_change events of verdict rows; a row can give two."""
    event = lambda name, old, new, on: F.when(on, F.struct(F.lit(name).alias("event"), old.cast("int").alias("old_price"), new.cast("int").alias("new_price")))
    old, new = F.col("old_price"), F.col("price")
    made = F.array_compact(F.array(event("new", F.lit(None), new, F.col("verdict") == "new"), event("relisted", old, new, F.col("verdict") == "relisted"), event("price_change", old, new, F.col("changed"))))
    rows = rows.select("fingerprint", observed_at.alias("observed_at"), "ordinal", F.posexplode(made).alias("k", "e"))
    return rows.select("fingerprint", "observed_at", "e.event", "e.old_price", "e.new_price", (F.col("ordinal") * 3 + F.col("k")).cast("int").alias("seq"))


def gone(state: DataFrame, seen: DataFrame, sources: DataFrame) -> DataFrame:
    """Fingerprints of active listings, stored under one of the sources, that the crawl didn't see."""
    active = state.where("gone_at is null").join(sources.select("source").distinct(), "source", "left_semi")
    return active.join(seen.select("fingerprint", "source").distinct(), ["fingerprint", "source"], "left_anti").select("fingerprint")


def fold(state: DataFrame, batch: DataFrame, observed_at: Column, swept: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Diff:
    """One crawl. batch has the listing columns and `ordinal`; swept (source) names the sources whose missing listings are gone.

    A crawl of several sources, one after the other, is one fold too: batch and
    swept then have `turn`, and ordinals follow it. A source is swept after its
    turn; a later one that carries what it lost brings that back. keep is applied to
    what several of the results are made of: cluster.cut, where most of them are wanted.
    """
    turn = "turn" in batch.columns
    batch = batch if turn else batch.withColumn("turn", F.lit(0))
    if swept is None:
        held = state.withColumn("_sweep", F.lit(None).cast("int"))
    else:
        turns = swept.groupBy("source").agg((F.max("turn") if turn else F.lit(0)).cast("int").alias("_sweep"))
        held = state.join(turns, "source", "left")
    rows = keep(_judged(held, batch))
    newest, oldest = F.struct("ordinal"), F.struct(F.col("ordinal"))
    last_known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), newest))
    own = [c for c in state.columns if c in batch.columns]
    stored = [c for c in own if c not in ("fingerprint", "last_seen", *FOLDED)]
    folded = rows.groupBy("fingerprint").agg(
        F.max("last_seen").alias("_last"), *[last_known(c).alias(f"_n_{c}") for c in FOLDED], F.min_by(F.struct(*stored), oldest).alias("_f"),
        F.max(F.col("source") == F.col("_owner")).alias("_by_owner"), F.count_if(F.col("turn") <= F.col("_sweep")).alias("_n_before"), F.max("_later").alias("_back"),
    )
    joined = held.join(folded, "fingerprint", "full_outer")
    unseen = F.col("_sweep").isNotNull() & ~F.coalesce("_by_owner", F.lit(False))
    active = F.col("gone_at").isNull() | (F.coalesce("_n_before", F.lit(0)) > 0)
    joined = joined.withColumns({"_lost": unseen & active, "_back": F.coalesce("_back", F.lit(False))})
    value = {c: F.coalesce(f"_n_{c}", c) for c in FOLDED}
    kept = F.when(F.col("_last").isNull(), F.col("gone_at"))
    value |= {"last_seen": F.coalesce("_last", "last_seen"), "gone_at": F.when(F.col("_lost") & ~F.col("_back"), observed_at).otherwise(kept)}
    fresh = F.col("source").isNull() & F.col("_f").isNotNull()
    value |= {c: F.when(fresh, F.col(f"_f.{c}")).otherwise(F.col(c)) for c in stored}
    after = joined.select(*[value.get(c, F.col(c)).alias(c) for c in state.columns])
    none = F.lit(None).cast("int")
    missing = keep(joined.where("_lost").select("fingerprint", "source", (F.coalesce("_n_before", F.lit(0)) * 3 + 2).cast("int").alias("seq")))
    events = events_of(rows, observed_at).unionByName(missing.select("fingerprint", observed_at.alias("observed_at"), F.lit("gone").alias("event"), none.alias("old_price"), none.alias("new_price"), "seq"))
    rows = rows.drop("_p", "_gone", "_owner", "_sweep", "_known", "_later", *([] if turn else ["turn"]))
    return Diff(after, events, rows, missing.drop("seq"))


def counters(rows: DataFrame, raw: DataFrame, config: DataFrame, sweep: bool = True) -> DataFrame:
    """Per source: n_raw, n_new, n_updated, n_unresolved, suspicious (fewer raw rows than min_expected), ok, error.

    rows are verdicts with source and confidence; config has source and min_expected.
    """
    counts = rows.groupBy("source").agg(F.count_if(F.col("verdict") == "new").alias("n_new"), F.count_if(F.col("verdict").isin("price_change", "relisted")).alias("n_updated"), F.count_if(F.col("confidence") == "low").alias("n_unresolved"))
    read = raw.groupBy("source").agg(F.count("*").alias("n_raw"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = config.select("source", "min_expected").join(read, "source", "left").join(counts, "source", "left")
    out = out.withColumns({c: zero(c) for c in ("n_raw", "n_new", "n_updated", "n_unresolved")})
    low = F.col("n_raw") < zero("min_expected")
    return out.withColumns({"suspicious": low, "ok": ~low, "error": F.when(low, F.format_string("only %d rows returned", "n_raw")), "sweep": F.lit(sweep) & ~low})


def history(observations: DataFrame) -> DataFrame:
    """All events of many crawls at once, for rows of (fingerprint, source, crawl, ordinal, price).

    crawl orders the crawls of a source, each swept at its end; a fingerprint has
    one source. Gaps between the crawls that saw a fingerprint become gone and
    relisted events. One shuffle by fingerprint; the crawls of a source are few.
    """
    runs = observations.select("source", "crawl").distinct()
    w = Window.partitionBy("source").orderBy("crawl")
    runs = runs.withColumns({"run": F.row_number().over(w), "next_crawl": F.lead("crawl").over(w)})
    rows = observations.join(runs, ["source", "crawl"])
    by = Window.partitionBy("fingerprint").orderBy("run", "ordinal")
    rows = rows.withColumns({
        "old_price": F.last("price", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)),
        "before": F.lag("run").over(by), "after": F.lead("run").over(by),
    })
    new = F.col("before").isNull()
    back = F.coalesce(F.col("run") - F.col("before") > 1, F.lit(False))
    changed = ~new & F.coalesce(F.col("price") != F.col("old_price"), F.lit(False))
    left = F.col("next_crawl").isNotNull() & F.coalesce(F.col("after") - F.col("run") > 1, F.lit(True))
    none = F.lit(None).cast("int")
    event = lambda name, at, old, price, on: F.when(on, F.struct(F.lit(name).alias("event"), at.alias("crawl"), old.cast("int").alias("old_price"), price.cast("int").alias("new_price")))
    here = F.col("crawl")
    made = F.array_compact(F.array(event("new", here, none, F.col("price"), new), event("relisted", here, F.col("old_price"), F.col("price"), back), event("price_change", here, F.col("old_price"), F.col("price"), changed), event("gone", F.col("next_crawl"), none, none, left)))
    return rows.select("fingerprint", "source", F.explode(made).alias("e")).select("fingerprint", "source", "e.*")
