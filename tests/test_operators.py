import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline import cluster, schemas
from hearthline.functions import text as T
from hearthline.operators import diff, geo, ledger, match, normalize, search

START = datetime(2026, 8, 1, 12)
GEO = "query string, bbl string, bin string, label string, borough string, lat double, lon double, confidence double"


def stamp(days):
    return F.lit(str(START + timedelta(days=days))).cast("timestamp")


def listing(fp, source="s", price=1000, **more):
    row = {f.name: None for f in schemas.LISTING} | {"fingerprint": fp, "source": source, "price": price, "unit_key": "1", "confidence": "high", "first_seen": START, "last_seen": START} | more
    return tuple(row[f.name] for f in schemas.LISTING)


def crawl(spark, rows, day, source="s"):
    df = spark.createDataFrame([listing(fp, source, price, first_seen=START + timedelta(days=day), last_seen=START + timedelta(days=day)) for fp, price in rows], schemas.LISTING)
    return df.withColumn("k", F.monotonically_increasing_id())


def fold(spark, state, rows, day, source="s", sweep=True):
    batch = diff.ordinals(crawl(spark, rows, day, source), [F.col("k")]).drop("k")
    swept = spark.createDataFrame([(source,)], "source string") if sweep else None
    d = diff.fold(state, batch, stamp(day), swept)
    return spark.createDataFrame(d.state.collect(), schemas.STATE), sorted((r.fingerprint, r.event, r.old_price, r.new_price) for r in d.events.collect())


def test_five_crawls(spark):
    state = spark.createDataFrame([], schemas.STATE)
    state, e = fold(spark, state, [("12B", 4200), ("14C", 4400)], 0)
    assert e == [("12B", "new", None, 4200), ("14C", "new", None, 4400)]
    state, e = fold(spark, state, [("12B", 3950), ("14C", 4400)], 1)
    assert e == [("12B", "price_change", 4200, 3950)]
    state, e = fold(spark, state, [("12B", 3950)], 2)
    assert e == [("14C", "gone", None, None)] and state.where("gone_at is null").count() == 1
    state, e = fold(spark, state, [("12B", 3950), ("14C", 4100)], 3)
    assert e == [("14C", "price_change", 4400, 4100), ("14C", "relisted", 4400, 4100)]
    state, e = fold(spark, state, [], 4, sweep=False)
    assert e == [] and state.where("gone_at is null").count() == 2
    rows = {r.fingerprint: r for r in state.collect()}
    assert rows["12B"].first_seen == START and rows["14C"].price == 4100 and rows["14C"].last_seen == START + timedelta(days=3)


def test_stored_source_keeps_a_listing(spark):
    """First seen by one source and later carried by another only, it is still the first one's."""
    state, _ = fold(spark, spark.createDataFrame([], schemas.STATE), [("x", 1000)], 0, "a")
    state, e = fold(spark, state, [("x", 1000)], 1, "b")
    assert e == [] and state.collect()[0].source == "a"
    state, e = fold(spark, state, [], 2, "a")
    assert e == [("x", "gone", None, None)]
    state, e = fold(spark, state, [("x", 1000)], 3, "b")
    assert e == [("x", "relisted", 1000, 1000)]


def one_by_one(prices_by_crawl, state):
    """The sequential rule, row by row."""
    events, verdicts = [], []
    for fp, price in prices_by_crawl:
        if fp not in state:
            state[fp] = [price, False]
            events.append((fp, "new", None, price))
            verdicts.append("new")
            continue
        old, gone = state[fp]
        v = "seen"
        if gone:
            events.append((fp, "relisted", old, price))
            v = "relisted"
        if price is not None and old is not None and price != old:
            events.append((fp, "price_change", old, price))
            v = "price_change" if v == "seen" else v
        state[fp] = [old if price is None else price, False]
        verdicts.append(v)
    return events, verdicts


def test_fold_equals_the_sequential_rule(spark):
    r = random.Random(4)
    for _ in range(3):
        names, prices = "abcdef", [None, 1, 2, 3]
        known = {n: [r.choice(prices), r.random() < 0.4] for n in names if r.random() < 0.6}
        state = spark.createDataFrame([(*listing(n, price=p), START if g else None) for n, (p, g) in known.items()], schemas.STATE)
        rows = [(r.choice(names), r.choice(prices)) for _ in range(14)]
        events, verdicts = one_by_one(rows, known)
        batch = diff.ordinals(crawl(spark, rows, 1), [F.col("k")]).drop("k")
        d = diff.fold(state, batch, stamp(1))
        key = lambda x: tuple(str(y) for y in x)
        assert sorted(((e.fingerprint, e.event, e.old_price, e.new_price) for e in d.events.collect()), key=key) == sorted(events, key=key)
        assert sorted(v.verdict for v in d.verdicts.collect()) == sorted(verdicts)
        assert {s.fingerprint: s.price for s in d.state.collect()} == {n: p for n, (p, _) in known.items()}
        assert d.state.where("gone_at is not null").count() == sum(g for _, g in known.values())


def test_sources_in_one_fold_equal_folds_in_turn(spark):
    """Also where one source's sweep loses what a later one brings back, and where an earlier one revived it."""
    r = random.Random(11)
    named, prices = "abcdefgh", [None, 1, 2, 3]
    for _ in range(4):
        known = [(n, r.choice("xyzw"), r.choice(prices), r.random() < 0.4) for n in named if r.random() < 0.8]
        start = spark.createDataFrame([(*listing(n, s, p), START if g else None) for n, s, p, g in known], schemas.STATE)
        crawls = {s: [(r.choice(named), r.choice(prices)) for _ in range(r.randint(0, 5))] for s in "xyz"}
        swept = [s for s in "xyz" if r.random() < 0.8]
        state, events, verdicts, lost = start, [], [], []
        flat = lambda df: [(e.fingerprint, e.event, e.old_price, e.new_price) for e in df.orderBy("fingerprint", "seq").collect()]
        for turn, (s, rows) in enumerate(crawls.items()):
            d = diff.fold(state, diff.ordinals(crawl(spark, rows, 1, s), [F.col("k")]).drop("k"), stamp(1), spark.createDataFrame([(s,)] if s in swept else [], "source string"))
            events += flat(d.events)
            verdicts += [(turn, v.fingerprint, v.verdict, v.old_price) for v in d.verdicts.collect()]
            lost += [(m.fingerprint, m.source) for m in d.missing.collect()]
            state = spark.createDataFrame(d.state.collect(), schemas.STATE)
        every = [crawl(spark, rows, 1, s).withColumn("turn", F.lit(t)) for t, (s, rows) in enumerate(crawls.items())]
        batch = diff.ordinals(every[0].unionByName(every[1]).unionByName(every[2]), [F.col("turn"), F.col("k")]).drop("k")
        d = diff.fold(start, batch, stamp(1), spark.createDataFrame([(s, "xyz".index(s)) for s in swept], "source string, turn int"))
        key = lambda x: tuple(str(y) for y in x)
        assert flat(d.events) == sorted(events, key=lambda e: e[0])  # in their order within a fingerprint
        assert sorted(((v.turn, v.fingerprint, v.verdict, v.old_price) for v in d.verdicts.collect()), key=key) == sorted(verdicts, key=key)
        assert sorted((m.fingerprint, m.source) for m in d.missing.collect()) == sorted(lost)
        assert sorted(map(str, d.state.collect())) == sorted(map(str, state.collect()))


def test_history_equals_folds(spark):
    r = random.Random(9)
    obs, state, want = [], {}, []
    for day in range(6):
        rows = [(r.choice("abcd"), r.choice([None, 1, 2])) for _ in range(r.randint(1, 5))]
        obs += [(fp, "s", day, i, p) for i, (fp, p) in enumerate(rows)]
        events, _ = one_by_one(rows, state)
        want += [(day, *e) for e in events]
        for fp, s in state.items():
            if fp not in {x for x, _ in rows} and not s[1]:
                s[1] = True
                want.append((day, fp, "gone", None, None))
    got = diff.history(spark.createDataFrame(obs, "fingerprint string, source string, crawl int, ordinal int, price int")).collect()
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(((e.crawl, e.fingerprint, e.event, e.old_price, e.new_price) for e in got), key=key) == sorted(want, key=key)


def pair_table(spark, rows):
    full = [listing(f"f{i}", src, price, bin=b, beds=beds, listed_at=None if at is None else START + timedelta(days=at)) for i, (src, b, beds, price, at) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.LISTING)


def test_matches(spark):
    runs = spark.createDataFrame([], "source string, started_at timestamp, id long")
    m = lambda rows, runs=runs: match.matches(pair_table(spark, rows), runs, ["up"], ["agg"]).collect()
    (r,) = m([("up", "b", 1.0, 5608, -5), ("agg", "b", 1.0, 5608, -1)])
    assert (r.matched_by, r.basis) == ("building+beds+price", "listed_at->listed_at")
    assert len(m([("up", "b", 0.0, 3000, 0)] * 6 + [("agg", "b", 0.0, 3000, 0)])) == 1
    (r,) = m([("up", "b", 1.0, 4100, 0), ("up", "b", 1.0, 4000, 0), ("agg", "b", 1.0, 4000, 0)])
    assert r.upstream_fp == "f1" and r.penalty == 0
    assert m([("up", "b", 0.0, 3000, 0), ("agg", "b", 2.0, 3000, 0)]) == [] and m([("up", "b", 1.0, 3000, 0), ("agg", "c", 1.0, 3000, 0)]) == [] and m([("up", "b", 1.0, 3000, 0), ("agg", "b", 1.0, 3600, 0)]) == []
    assert len(m([("up", "b", None, 3000, 0), ("agg", "b", 2.0, 3100, 0)])) == 1
    once = spark.createDataFrame([("up", START, 1)], "source string, started_at timestamp, id long")
    assert m([("up", "b", 1.0, 3000, None), ("agg", "b", 1.0, 3000, None)], once)[0].basis == match.CENSORED
    assert m([("up", "b", 1.0, 3000, None), ("agg", "b", 1.0, 3000, None)])[0].basis == "first_seen->first_seen"
    twice = spark.createDataFrame([("up", START - timedelta(days=2), 1), ("up", START - timedelta(days=1), 2)], "source string, started_at timestamp, id long")
    assert m([("up", "b", 1.0, 3000, None), ("agg", "b", 1.0, 3000, None)], twice)[0].basis == "first_seen->first_seen"


def test_assignment_is_greedy(spark):
    r = random.Random(2)
    rows = [(r.choice(["up", "agg"]), r.choice("bcd"), r.choice([None, 1.0, 2.0]), r.choice([3000, 3030, 3060, 3100]), 0) for _ in range(60)]
    pairs = match.candidates(pair_table(spark, rows), ["up"], ["agg"])
    got = sorted((p.u_fp, p.a_fp) for p in match.assign(pairs).collect())
    used, want, expected = set(), [], []
    ups = [(f"f{i}", x) for i, x in enumerate(rows) if x[0] == "up"]
    aggs = [(f"f{i}", x) for i, x in enumerate(rows) if x[0] == "agg"]
    for u, x in ups:
        for a, y in aggs:
            if x[1] == y[1] and (x[2] is None or y[2] is None or abs(x[2] - y[2]) <= 0.01) and abs(x[3] - y[3]) / max(x[3], y[3]) <= 0.04:
                want.append((abs(x[3] - y[3]) / max(x[3], y[3]), u, a))
    for _, u, a in sorted(want):
        if u not in used and a not in used:
            used |= {u, a}
            expected.append((u, a))
    assert pairs.count() == len(want) and got == sorted(expected)
    assert "Window" not in (plan := match.assign(pairs)._jdf.queryExecution().toString()) and "FlatMapGroups" not in plan


def test_ledger(spark):
    runs = spark.createDataFrame([], "source string, started_at timestamp, id long")
    table = pair_table(spark, [("up", "b", 1.0, 5608, -5), ("agg", "b", 1.0, 5608, -1), ("up", "c", 1.0, 1000, -1), ("agg", "c", 1.0, 1000, -4), ("up", "d", 1.0, 2000, -1), ("agg", "d", 1.0, 2000, -200), ("up", "e", 1.0, 900, None), ("agg", "e", 1.0, 900, -1)])
    book = ledger.open_entries(spark.createDataFrame([], schemas.LEDGER), table)
    found = match.matches(table, runs, ["up"], ["agg"])
    judged = ledger.judge(found, book)
    assert ledger.run_counters(judged).first().asDict() == {"pairs_found": 4, "recorded": 3, "already_measured": 0, "unusable": 0, "implausible": 1, "exact_price": 4}
    book = ledger.record(book, judged)
    leads = {r.fingerprint: r.lead_hours for r in book.where("lead_hours is not null").collect()}
    assert leads == {"f0": 96.0, "f2": -72.0, "f6": -24.0}
    again = ledger.judge(found, book)
    assert ledger.run_counters(again).first().already_measured == 3
    assert ledger.record(book, again).where("lead_hours is not null").count() == 3
    r = ledger.report(book).first()
    assert (r.measured, r.excluded_mixed_basis, r.median_hours, r.share_ahead, r.caveat) == (2, 1, 12.0, 0.5, "small sample")
    assert r.basis == {"listed_at->listed_at": 2} and r.vs == {"agg": 3}
    empty = ledger.distribution(spark.createDataFrame([], schemas.LEDGER)).first()
    assert empty.measured == 0 and empty.median_hours is None and empty.note == "no aggregator timestamps recorded yet"


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 30, 101])
def test_quantiles(spark, n):
    xs = sorted(((i * 37) % 53) / 2 for i in range(n))
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = ledger.indexed_quantiles(df, "x", {"lo": 0.10, "hi": 0.90}).first()
    assert (got.lo, got.hi) == (xs[max(0, int(n * 0.10) - 1)], xs[min(n - 1, int(n * 0.90))])
    assert (got.m1 + got.m2) / 2 == statistics.median(xs)


def test_geo_and_normalize(spark):
    raws = [("s", "350 W. 42nd St.", "Manhattan", "#12B", "$4,200", "1 Bedroom"), ("s", "350 West 42 Street", "Manhattan", "Apt 12B", "$4,200", "1 Bedroom"), ("s", "unknown place", None, None, "call", "Studio"), ("s", "9 Elm Street", "Bronx", None, "$2,000", "2 bed"), ("s", " ", None, None, None, None), ("s", "5 Low Road", "Queens", None, "$2,000", None)]
    raw = spark.createDataFrame(raws, "source string, address string, borough_hint string, unit_raw string, price_raw string, beds_raw string")
    cache = spark.createDataFrame([("350 w 42 st Manhattan", "1010", "77", "350 WEST 42 STREET", "Manhattan", 40.7, -74.0, 0.9)], GEO)
    primary = spark.createDataFrame([("5 low rd Queens", "4", None, "5 LOW", "Queens", 1.0, 1.0, 0.3)], GEO)
    register = spark.createDataFrame([("2", "9", "ELM STREET", "88", "12", "3", "9")], "boroid string, lowhousenumber string, streetname string, bin string, block string, lot string, housenumber string")
    found = geo.lookup(raw, cache, primary, register)
    got = {r["query"]: r for r in found.collect()}
    assert {k: r.outcome for k, r in got.items()} == {"350 w 42 st Manhattan": "hit", "9 elm st Bronx": "fallback", "unknown pl": "empty", "5 low rd Queens": "low"}
    assert got["9 elm st Bronx"].bbl == "2000120003"
    assert geo.statistics(found).first().asDict() == {"hit": 1, "miss": 3, "fail": 0, "low_confidence": 1, "fallback": 1}
    learnt = geo.remember(found, cache)
    assert {r["query"]: r.confidence for r in learnt.collect()} == {"350 w 42 st Manhattan": 0.9, "9 elm st Bronx": 0.9, "unknown pl": -1.0, "5 low rd Queens": -1.0}
    assert geo.lookup(raw, learnt, primary, register).where("outcome = 'negative'").count() == 2
    rows = normalize.normalize(raw, found, stamp(0)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.address_raw, r)
    assert len(rows) == 5 and by["350 W. 42nd St."].fingerprint == by["350 West 42 Street"].fingerprint
    assert [by[a].confidence for a in ("350 W. 42nd St.", "9 Elm Street", "unknown place")] == ["high", "medium", "low"]
    assert (by["350 W. 42nd St."].unit_key, by["350 W. 42nd St."].price, by["350 W. 42nd St."].beds) == ("12B", 4200, 1.0) and by["unknown place"].bbl is None


def test_search(spark):
    rows = [listing("a", price=3000, beds=1.0, borough="Queens", no_fee=True, sqft=700, address="1 A St"), listing("b", price=None, beds=2.0, confidence="medium"), listing("c", price=5000, beds=None, confidence="low"), listing("d", price=3500, beds=2.5, borough="Bronx", first_seen=START + timedelta(days=1))]
    state = spark.createDataFrame([(*r, None) for r in rows], schemas.STATE)
    assert [r.fingerprint for r in search.active(state, max_price=4000).collect()] == ["d", "a"]
    assert [r.fingerprint for r in search.active(state, min_beds=2.0).collect()] == ["d", "b"]
    assert search.new_since(state, stamp(0.5)).count() == 1
    crit = spark.createDataFrame([("p", 3200, 1.0, 2.0, ["Queens"], None, True, 600, "medium"), ("q", None, None, 2.0, [], None, None, None, "low")], schemas.CRITERIA)
    got = {(r.search, r.fingerprint): r for r in search.judge(state, crit).collect()}
    assert got["p", "a"].reject is None and got["p", "a"].reasons == ["$3,000/mo within budget", "1 bed", "Queens"]
    assert [got["p", f].reject for f in "bcd"] == ["no price published", "below confidence floor", "price 3500 > 3200"]
    assert [got["q", f].reject for f in "abcd"] == [None, None, None, "more bedrooms than requested"]
    sent = []
    assert search.deliver(search.digests(search.matching(state, crit)).orderBy("search"), lambda s, b: sent.append((s, b))) == 2
    assert sent[0][0] == "1 new match for p" and "$3,000/mo — 1 A St #1\n  $3,000/mo within budget, 1 bed, Queens · 700 sqft · no fee" in sent[0][1]
    events = spark.createDataFrame([("a", START, "new", None, 1, 0)], schemas.EVENT)
    assert search.summary(state, events).first().asDict() == {"listings_total": 4, "listings_active": 4, "with_bbl": 0, "with_unit": 4, "high_confidence": 2, "distinct_buildings": 0, "events": 1}


def test_counters(spark):
    raw = spark.createDataFrame([("a",)] * 3 + [("b",)], "source string")
    rows = spark.createDataFrame([("a", "new", "low"), ("a", "price_change", "high"), ("a", "relisted", "high")], "source string, verdict string, confidence string")
    conf = spark.createDataFrame([("a", 2), ("b", 5), ("c", 1)], "source string, min_expected int")
    got = {r.source: r for r in diff.counters(rows, raw, conf).collect()}
    assert (got["a"].n_raw, got["a"].n_new, got["a"].n_updated, got["a"].n_unresolved, got["a"].ok) == (3, 1, 2, 1, True)
    assert (got["b"].ok, got["b"].error, got["b"].sweep) == (False, "only 1 rows returned", False) and not got["c"].ok




def test_social_reads_whole_messages(spark, tmp_path):
    from hearthline.plans import catalog

    long = "hello there " * 100
    spark.createDataFrame([(1, 2, f"{long}2 br in Harlem for $800 now"), (1, 5, long)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in catalog.social(spark, str(tmp_path)).collect())
    assert got == [(1, 2, True, 800, "2 br", "harlem"), (1, 5, True, None, None, None)]


def test_lookup_of_repeated_answers(spark):
    """Of several answers to one key the most confident counts, whatever their order."""
    asked = spark.createDataFrame([("9 Elm Street", "Bronx")], "address string, borough_hint string")
    answers = [("9 elm st Bronx", f"b{k}", None, "L", "Bronx", 1.0, 1.0, 0.7 + k % 3 / 10) for k in range(9)]
    for parts in (1, 5):
        got = geo.lookup(asked, spark.createDataFrame([], GEO), spark.createDataFrame(answers, GEO).repartition(parts)).collect()
        assert [(r.outcome, r.bbl) for r in got] == [("resolved", "b2")]


def test_searches_in_blocks(spark, monkeypatch):
    held = spark.createDataFrame([listing("a", price=100), listing("b", price=900)], schemas.LISTING)
    wanted = spark.createDataFrame([(f"s{k}", 500, None, None, None, None, None, None, "low") for k in range(25)], schemas.CRITERIA)
    want = sorted(map(str, search.judge(held, wanted).collect()))
    monkeypatch.setattr(search, "SEARCHES", 10)
    assert sorted(map(str, search.judge(held, wanted).collect())) == want and len(want) == 50
    assert search.judge(held, wanted.limit(0)).count() == 0


def wish_list(n, seed=1):
    r = random.Random(seed)
    pick = lambda *xs: r.choice(xs)
    return [(f"s{k}", pick(None, r.randint(500, 9000)), pick(None, float(r.randint(0, 4)), 1.5), pick(None, float(r.randint(0, 9)), 2.5), pick(None, ["Queens"], ["Bronx", None, "Bronx"], [], [None]), None, pick(None, True, False), pick(None, 700), pick(None, "low", "medium", "high", "odd")) for k in range(n)]


def test_matching_equals_judging_all(spark, monkeypatch):
    """The index of searches loses nothing and adds nothing, over all nulls, bounds and blocks; extra columns stay."""
    r = random.Random(2)
    pick = lambda *xs: r.choice(xs)
    held = [(f"f{k}", pick(None, r.randint(400, 9500), 3000), pick(None, float(r.randint(0, 12)), 1.5, float("nan")), pick(None, "Queens", "Bronx", ""), pick(None, "low", "medium", "high"), pick(None, True, False), pick(None, 650, 900), "x", 7) for k in range(300)]
    listings = spark.createDataFrame(held, "fingerprint string, price int, beds double, borough string, confidence string, no_fee boolean, sqft int, id string, ids int")
    wanted = spark.createDataFrame([*wish_list(150), ("s1", 3000, 1.0, 0.5, None, None, None, None, None)], schemas.CRITERIA)
    want = sorted(map(str, search.judge(listings, wanted).where("reject is null").drop("reject").collect()))
    assert len(want) > 1500
    assert sorted(map(str, search.matching(listings, wanted).collect())) == want
    monkeypatch.setattr(search, "SEARCHES", 40)
    monkeypatch.setattr(search, "ENTRIES", 3000)
    assert sorted(map(str, search.matching(listings, wanted).collect())) == want
    assert search.matching(listings, wanted.where("false")).count() == 0


def test_few_listings_meet_a_search(spark):
    """At 10 000 narrow searches a listing is judged for the searches of its cells alone."""
    r = random.Random(3)
    wanted = spark.createDataFrame([(f"s{k}", r.randint(500, 9000), float(k % 5), float(k % 5), [r.choice(["Queens", "Bronx", "Brooklyn", "Manhattan", "Staten Island"])], None, None, None, "low") for k in range(10_000)], schemas.CRITERIA)
    places = F.element_at(F.array(*map(F.lit, ["Queens", "Bronx", "Brooklyn", "Manhattan", "Staten Island"])), (F.col("id") % 5 + 1).cast("int"))
    listings = spark.range(2000).select(F.concat(F.lit("f"), "id").alias("fingerprint"), (500 + F.col("id") * 7919 % 9000).cast("int").alias("price"), (F.col("id") % 7 % 5).cast("double").alias("beds"), places.alias("borough"), F.lit("high").alias("confidence"), F.lit(True).alias("no_fee"), F.lit(900).alias("sqft"))
    held = wanted.withColumn("id", F.monotonically_increasing_id()).cache()
    cuts = sorted(set(held.agg(F.percentile_approx("max_price", [k / search.CUTS for k in range(1, search.CUTS + 1)])).first()[0]))
    met, matched = search.candidates(listings, held, cuts).count(), search.matching(listings, wanted).count()
    print(f" {met} pairs judged of {2000 * 10_000}, {matched} match", end="")
    assert matched <= met < 1.2 * matched < 2000 * 10_000 / 10


def test_digests_are_paged(spark):
    rows = [("s", f"f{k:03}", 1000 + k, START) for k in range(23)] + [("t", "f1", 5, START)]
    found = spark.createDataFrame(rows, "search string, fingerprint string, price int, first_seen timestamp")
    for c, kind in (("address", "string"), ("unit_key", "string"), ("sqft", "int"), ("no_fee", "boolean"), ("source", "string"), ("detail_url", "string"), ("source_url", "string"), ("reasons", "array<string>")):
        found = found.withColumn(c, F.lit(None).cast(kind))
    got = search.digests(found, page=10).orderBy("search", "page").collect()
    assert [(x.search, x.page, x.pages, x.n, x.subject) for x in got] == [("s", 1, 3, 23, "23 new matches for s (1/3)"), ("s", 2, 3, 23, "23 new matches for s (2/3)"), ("s", 3, 3, 23, "23 new matches for s (3/3)"), ("t", 1, 1, 1, "1 new match for t")]
    lines = [x for g in got[:3] for x in g.body.split("\n\n")]
    assert [x.split("/mo")[0] for x in lines] == [f"${1000 + k:,}" for k in range(23)]


def test_messages_are_made_where_their_lines_are_dealt(spark, monkeypatch):
    """Lines are not stored, and pages over the edges of spans are whole: equal dates, repeated rows and nulls too."""
    r, stored = random.Random(5), []
    for module in (cluster, search):
        monkeypatch.setattr(module, "cut", lambda df, real=cluster.cut: (stored.extend(df.columns), real(df))[1])
    monkeypatch.setattr(search, "SPAN", 1)
    rows = [("s", r.choice([None, *(f"f{k:02}" for k in range(60))]), r.randint(1, 4), r.choice([None, *(START + timedelta(days=d) for d in range(5))])) for _ in range(150)]
    rows += [(f"t{k}", f"f{i}", i + 1, START) for k in range(3) for i in range(10 * k + 1)]
    found = spark.createDataFrame(rows, "search string, fingerprint string, price int, first_seen timestamp")
    for c, kind in (("address", "string"), ("unit_key", "string"), ("sqft", "int"), ("no_fee", "boolean"), ("source", "string"), ("detail_url", "string"), ("source_url", "string"), ("reasons", "array<string>")):
        found = found.withColumn(c, F.lit(None).cast(kind))
    got = search.digests(found.repartition(5), page=7).orderBy("search", "page").collect()
    assert stored and "line" not in stored
    seen = found.select("search", "first_seen", "fingerprint", search.message().alias("line")).orderBy("search", "first_seen", "fingerprint", "line").collect()
    for name in ("s", "t0", "t1", "t2"):
        lines = [x.line for x in seen if x.search == name]
        pages = [lines[k : k + 7] for k in range(0, len(lines), 7)]
        assert [(x.page, x.pages, x.n, x.body) for x in got if x.search == name] == [(k + 1, len(pages), len(lines), "\n\n".join(p)) for k, p in enumerate(pages)]


def test_equal_searches_are_matched_once(spark):
    """Names that ask the same share a key; what is found for it reaches each of them, and names of several rows keep their own."""
    wanted = spark.createDataFrame([*((f"s{k}", 2000 + k % 2, None, None, ["Queens", None], None, None, None, "low") for k in range(40)), ("two", 2000, None, None, ["Queens", None], None, None, None, "low"), ("two", 500, None, None, None, None, None, None, "low"), (None, 9000, None, None, None, None, None, None, "low")], schemas.CRITERIA)
    held = spark.createDataFrame([listing("a", price=2000, borough="Queens"), listing("b", price=2001, borough="Queens"), listing("c", price=400)], schemas.LISTING)
    asked, members = search.shared(wanted)
    assert asked.columns == wanted.columns and (asked.count(), members.count()) == (5, 42)
    one, all_ = search.matching(held, asked), search.matching(held, wanted)
    assert (one.count(), all_.count()) == (8, 65)
    assert sorted(map(str, search.named(one, members).collect())) == sorted(map(str, all_.collect()))
    digests = lambda df: sorted(map(str, df.where("search is not null").collect()))
    assert digests(search.subjects(search.named(search.bodies(one), members))) == digests(search.digests(all_))
