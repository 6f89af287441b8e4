from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.cluster import cut
from hearthline.operators import diff
from hearthline.operators.state import History, Part, migrate
from hearthline.plans import crawl as C
from hearthline.plans import histories
from hearthline.streaming import crawl_stream

DAY = datetime(2026, 8, 1, 12)
GEO = "query string, bbl string, bin string, label string, borough string, lat double, lon double, confidence double, provider string"


def raw(spark, rows, source):
    return spark.createDataFrame([(source, "350 West 42nd Street", u, str(p), "1 Bedroom", "Manhattan") for u, p in rows], "source string, address string, unit_raw string, price_raw string, beds_raw string, borough_hint string")


def test_crawls(spark, tmp_path):
    h = History(spark, f"{tmp_path}/h", buckets=4)
    primary = spark.createDataFrame([("350 w 42 st Manhattan", "1010", "77", "350 WEST 42 STREET", "Manhattan", 40.7, -74.0, 0.9, "p")], GEO)

    def broken():
        raise OSError("no page")

    def go(day, rows, **more):
        return {r.source: r for r in C.crawl(h, {"up": lambda: raw(spark, rows, "up")} | more, {"up": 2 if day == 4 else 1}, primary, None, DAY + timedelta(days=day)).collect()}

    r = go(0, [("12B", 4200), ("14C", 4400)], bad=broken)
    assert (r["up"].n_new, r["up"].ok, r["bad"].ok, r["bad"].error) == (2, True, False, "OSError: no page")
    assert go(1, [("12B", 3950), ("14C", 4400)])["up"].n_updated == 1
    assert go(2, [("12B", 3950)])["up"].n_gone == 1
    r = go(3, [("12B", 3950), ("14C", 4100)])["up"]
    assert (r.n_new, r.n_updated, r.n_gone) == (0, 1, 0)
    r = go(4, [])["up"]
    assert (r.ok, r.n_gone, r.error) == (False, 0, "only 0 rows returned")
    state = {x.unit_key: x for x in h.read("listings").collect()}
    assert len(state) == 2 and all(x.gone_at is None and x.first_seen == DAY for x in state.values())
    assert h.log("events").count() == 6 and h.recent_runs(3).count() == 3 and h.version() == 5
    C.crawl(h, {"agg": lambda: raw(spark, [(None, 4100)], "agg").withColumn("source_ref", F.lit("r1"))}, {}, primary, None, DAY + timedelta(days=5))
    c = C.crossmatch(h, ["up"], ["agg"]).first()
    assert c.pairs_found == 1
    assert h.read("ledger").where("lead_hours is not null").count() == 1 and h.read("geo").count() == 1
    written = {t: sorted(p.name for p in (tmp_path / "h" / t).iterdir()) for t in ("listings", "ledger")}
    assert h.version() == 7 and "v=7" in written["ledger"] and "v=7" not in written["listings"]  # pairing changes the ledger alone
    before = sorted(map(str, h.read("listings").collect()))
    assert h.prune(2) > 5 and h.prune(2) == 0 and sorted(map(str, h.read("listings").collect())) == before and h.read("ledger").count() == 3


def test_one_source_brings_back_what_another_loses(spark, tmp_path):
    h = History(spark, f"{tmp_path}/h", buckets=4)
    primary = spark.createDataFrame([("350 w 42 st Manhattan", "1010", "77", "350 WEST 42 STREET", "Manhattan", 40.7, -74.0, 0.9, "p")], GEO)
    go = lambda day, **rows: {r.source: r for r in C.crawl(h, {s: (lambda s=s, x=x: raw(spark, x, s)) for s, x in rows.items()}, {"b": 0, "a": 0}, primary, None, DAY + timedelta(days=day)).collect()}
    assert go(0, a=[("1", 1000)], b=[("1", 1000), ("2", 2000)])["b"].n_new == 1
    r = go(1, a=[], b=[("1", 1100), ("2", 2000)])
    assert (r["a"].n_gone, r["b"].n_updated, r["b"].n_gone) == (1, 1, 0)
    assert h.read("listings").where("gone_at is null").count() == 2
    last = [e.event for e in h.log("events").where(f"observed_at = timestamp'{DAY + timedelta(days=1)}'").orderBy("seq").collect()]
    assert last == ["gone", "relisted", "price_change"]


def listings(spark, rows, source="s"):
    held = [(f"f{k}", source, p) for k, p in rows]
    out = spark.createDataFrame(held, "fingerprint string, source string, price int")
    return migrate(out, schemas.STATE).select(schemas.STATE.names)


def test_a_commit_writes_the_touched_buckets_alone(spark, tmp_path):
    h = History(spark, f"{tmp_path}/h", buckets=32)
    assert h.commit({"listings": listings(spark, [(k, k) for k in range(2000)])}, {}) == 1
    size = lambda v: sum(p.stat().st_size for p in (tmp_path / "h" / "listings" / f"v={v}").rglob("*.parquet"))
    batch = listings(spark, [(k, -k) for k in (5, 17, 1900)])
    met = History(spark, f"{tmp_path}/h").touched("listings", batch)  # its own number of buckets holds
    assert 1 <= len(met) <= 3
    held = h.read("listings", met).join(batch.select("fingerprint"), "fingerprint", "left_anti").select(schemas.STATE.names).unionByName(batch)
    assert h.commit({"listings": Part(held, met)}, {}) == 2
    assert size(2) < size(1) / 5 and sorted(p.name for p in (tmp_path / "h" / "listings" / "v=2").glob("bucket=*")) == sorted(f"bucket={b}" for b in met)
    assert {r.fingerprint: r.price for r in h.read("listings").collect()} == {f"f{k}": -k if k in (5, 17, 1900) else k for k in range(2000)}
    with pytest.raises(ValueError, match="outside"):
        h.commit({"listings": Part(h.read("listings"), met)}, {})
    assert h.version() == 2 and h.commit({"listings": Part(held.where("false"), met)}, {}) == 3
    assert 0 < h.read("listings").count() < 2000 and h.read("listings", met).count() == 0
    assert h.prune(1) == 2 * len(met) and 0 < h.read("listings").count() < 2000  # what the newest version reads stays


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, tmp_path, monkeypatch):
    h = History(spark, f"{tmp_path}/h", buckets=8)
    primary = spark.createDataFrame([], GEO)
    go = lambda day, rows: C.crawl(h, {"s": lambda: raw(spark, rows, "s")}, {}, primary, None, DAY + timedelta(days=day))
    go(0, [("1", 1000), ("2", 2000)])
    before = sorted(map(str, h.read("listings").collect())), h.log("events").count(), h.recent_runs().count()

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(History, "_publish", dies)
    with pytest.raises(OSError):
        go(1, [("1", 1500)])
    monkeypatch.undo()
    fresh = History(spark, f"{tmp_path}/h")
    assert (sorted(map(str, fresh.read("listings").collect())), fresh.log("events").count(), fresh.recent_runs().count()) == before
    assert go(1, [("1", 1500)]).first().n_gone == 1 and h.version() == 2
    events = {(e.event, e.new_price) for e in h.log("events").collect()}
    assert events == {("new", 1000), ("new", 2000), ("price_change", 1500), ("gone", None)} and h.log("events").count() == 4


def test_stream(spark, tmp_path):
    primary = spark.createDataFrame([], GEO)
    for i, rows in enumerate(([("1", 1000), ("2", 2000)], [("1", 1100)])):
        raw(spark, rows, "s").coalesce(1).write.json(f"{tmp_path}/in/{i}")
    h = History(spark, f"{tmp_path}/h", buckets=4)
    stream = spark.readStream.schema(schemas.RAW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
    q = crawl_stream.start(stream, h, primary, f"{tmp_path}/cp", lambda b: DAY + timedelta(days=b))
    q.awaitTermination()
    events = sorted((e.event, e.new_price) for e in h.log("events").collect() if e.event != "gone")
    assert q.exception() is None and h.version() == 2 and len(events) == 3 and h.read("listings").count() == 2
    again = crawl_stream.start(stream, h, primary, f"{tmp_path}/cp2", lambda b: DAY + timedelta(days=b))
    again.awaitTermination()
    assert h.version() == 2


def test_a_history_works_out_once_what_all_its_crawls_ask(spark, monkeypatch):
    """What crawls see, and the provider's answers, are stored before the first crawl: none reads the events again."""
    monkeypatch.setattr(histories, "_landed", lambda seen, n, source: seen)
    asked = []

    class Enough(Exception):
        pass

    def stub(history, sources, expected, primary, *rest):
        asked.extend([primary, *(make() for make in sources.values())])
        raise Enough

    monkeypatch.setattr(histories, "crawl", stub)
    with pytest.raises(Enough):
        histories.crawl_history(spark, "/root/testdata/sf0.001")
    assert len(asked) == 6 and not any(x.inputFiles() for x in asked)


def test_a_fold_keeps_what_its_results_share(spark):
    """The judged rows and what was lost are kept once each, and the results are made of them."""
    batch = spark.sql("select 'a' as fingerprint, 'up' as source, 1 as ordinal, 5 as price, timestamp'2026-08-02' as last_seen, cast(null as date) as available_on, cast(null as string) as detail_url, timestamp'2026-08-02' as first_seen")
    state = spark.sql("select 'b' as fingerprint, 'up' as source, 4 as price, timestamp'2026-08-01' as last_seen, cast(null as date) as available_on, cast(null as string) as detail_url, timestamp'2026-08-01' as first_seen, cast(null as timestamp) as gone_at")
    kept = []
    d = diff.fold(state, batch, F.lit("2026-08-02").cast("timestamp"), spark.sql("select 'up' as source"), keep=lambda df: kept.append(df) or cut(df))
    assert len(kept) == 2
    assert {(x.fingerprint, x.event) for x in d.events.collect()} == {("a", "new"), ("b", "gone")}
    assert [x.fingerprint for x in d.missing.collect()] == ["b"] and d.state.where("gone_at is not null").count() == 1


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    h = History(spark, f"{tmp_path}/h", buckets=1)
    rows = spark.range(20000, numPartitions=4).select(F.sha1(F.col("id").cast("string")).alias("fingerprint"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        h.commit({"ledger": migrate(rows, schemas.LEDGER)}, {})
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    held = h.read("ledger")
    assert held.select("fingerprint").distinct().count() == held.count() == 20000
    assert len(held.inputFiles()) > 1
