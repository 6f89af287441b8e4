"""A crawl: raw records of each source, normalised, looked up, diffed and written as one version."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.cluster import cut
from hearthline.functions import text as T
from hearthline.operators import diff, geo, ledger, match
from hearthline.operators.normalize import conform, normalize
from hearthline.operators.state import History, Part


def crawl(history: History, sources: dict[str, Callable[[], DataFrame]], min_expected: dict[str, int], primary: DataFrame, register: DataFrame | None, now: datetime, sweep: bool = True) -> DataFrame:
    """Fold all sources, in their order, into the next version; returns the run rows.

    sources make raw records of one source each. One that fails gives a failed run
    and changes nothing; one with fewer rows than expected is folded, but its
    missing listings are kept. The whole crawl is one lookup, one fold and one
    version, however many sources it has.
    """
    spark, at = history.spark, F.lit(str(now)).cast("timestamp")
    read, failed = {}, {}
    for turn, (name, make) in enumerate(sources.items()):
        try:
            # cut where the source's own work ends, so that its failure is its own
            raw = cut(conform(make()).withColumns({"_k": F.monotonically_increasing_id(), "turn": F.lit(turn)}))
            read[name] = (turn, raw, raw.count())
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    low = {name for name, (_, _, n) in read.items() if n < min_expected.get(name, 1)}
    tables, logs, counts, lost = {}, {}, {}, {}
    if read:
        raw = reduce(DataFrame.unionByName, [r for _, r, _ in read.values()])
        asked = history.touched("geo", raw.select(T.geo_key("address", "borough_hint").alias("query")))
        cache = history.read("geo", asked)
        resolved = cut(geo.lookup(raw, cache, primary, register))
        batch = cut(diff.ordinals(normalize(raw, resolved, at), [F.col("turn"), F.col("_k")]).drop("_k"))
        turns = [(name, turn) for name, (turn, _, _) in read.items() if sweep and name not in low]
        swept = spark.createDataFrame(turns, "source string, turn int")
        # the fold meets the buckets that hold a key of the batch or a listing that the sweeps lose; no others change
        lost = diff.gone(history.read("listings").select("fingerprint", "source", "gone_at"), batch, swept)
        met = sorted({*history.touched("listings", batch), *history.touched("listings", lost)})
        d = diff.fold(history.read("listings", met), batch, at, swept, keep=cut)
        judged = d.verdicts.groupBy("turn").agg(F.count_if(F.col("verdict") == "new").alias("new"), F.count_if(F.col("verdict").isin("price_change", "relisted")).alias("updated"), F.count_if(F.col("confidence") == "low").alias("low"))
        counts = {r.turn: r for r in judged.collect()}  # as many as sources
        lost = {r.source: r["n"] for r in d.missing.groupBy("source").agg(F.count("*").alias("n")).collect()}  # as many as sources
        new = d.verdicts.where("verdict = 'new'").select("fingerprint", "first_seen")
        opened = history.touched("ledger", new)
        entries = ledger.open_entries(history.read("ledger", opened), new)
        tables = {"listings": Part(d.state, met), "ledger": Part(entries, opened), "geo": Part(geo.remember(resolved, cache), asked)}
        logs = {"events": d.events}
    runs = []
    for name in sources:
        if name in failed:
            runs.append((name, now, now, False, 0, 0, 0, 0, 0, failed[name]))
            continue
        turn, _, n = read[name]
        c = counts.get(turn)
        runs.append((name, now, now, name not in low, n, c.new if c else 0, c.updated if c else 0, lost.get(name, 0), c.low if c else 0, f"only {n} rows returned" if name in low else None))
    rows = spark.createDataFrame(runs, schemas.RUN)
    history.commit(tables, logs | {"runs": rows})
    return rows


def crossmatch(history: History, upstream: list[str], aggregators: list[str], tolerance: float = match.TOLERANCE) -> DataFrame:
    """Pair the current listings, record what is new in the ledger as the next version; returns the counters."""
    runs = history.log("runs").select("source", "started_at")
    judged = cut(ledger.judge(match.matches(history.read("listings"), runs, upstream, aggregators, tolerance), history.read("ledger")))
    counters = ledger.run_counters(judged)
    hit = history.touched("ledger", judged.where("outcome = 'recorded'"), "upstream_fp")
    history.commit({"ledger": Part(ledger.record(history.read("ledger", hit), judged), hit)}, {})
    return counters


def fresh_measurements(judged: DataFrame, show: int = 20) -> DataFrame:
    return judged.where("outcome = 'recorded'").orderBy(F.desc("lead_hours"), "upstream_fp").limit(show)
