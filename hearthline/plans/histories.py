"""Queries of whole crawl histories, of the stateful stream and of saved searches over the common test tables, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.cluster import cut, folder
from hearthline.functions import text as T
from hearthline.operators import search
from hearthline.operators.state import History
from hearthline.plans.catalog import _duck, _state, _view
from hearthline.plans.crawl import crawl
from hearthline.streaming import event_stream

CRAWLS, SLICE = 4, 8  # crawls of as many days each
START = "2024-01-01"


def _work(spark: SparkSession) -> str:
    return f"{folder(spark)}/work-{uuid.uuid4().hex}"


def _seen(spark: SparkSession, d: str) -> DataFrame:
    """What each crawl sees of each source: the last row of every listing in its days."""
    rows = _view(spark, d, "observations").withColumn("n", F.least(F.lit(CRAWLS - 1), F.floor(F.datediff("crawl", F.lit(START).cast("date")) / SLICE)).cast("int"))
    last = F.struct("crawl", "ordinal")
    return rows.groupBy("n", "source", "fingerprint").agg(F.max_by(F.struct("price"), last).alias("r")).select("n", "source", F.substring_index("fingerprint", "/", 1).alias("ref"), "r.price")


def _landed(seen: DataFrame, n: int, source: str) -> DataFrame:
    rows = seen.where((F.col("n") == n) & (F.col("source") == source))
    return rows.select(
        "source", F.concat("ref", F.lit(" Main Street")).alias("address"), F.lit("Queens").alias("borough_hint"), F.col("ref").alias("source_ref"),
        F.col("price").cast("double").alias("price_num"), F.lit("1 Bedroom").alias("beds_raw"),
    )


def crawl_history(spark: SparkSession, d: str) -> DataFrame:
    """Crawls of all sources, one of which fails in the second and is short in the third: runs, events, state, ledger and address cache of the history."""
    seen = cut(_seen(spark, d))  # every crawl asks it for every source
    names = [r.source for r in seen.select("source").distinct().orderBy("source").collect()]  # as many as sources
    asked = seen.select("ref").distinct().withColumn("query", T.geo_key(F.concat("ref", F.lit(" Main Street")), F.lit("Queens")))
    none = F.lit(None)
    answers = {"bbl": F.concat(F.lit("B"), "ref"), "bin": none.cast("string"), "label": F.concat(F.lit("L"), "ref"), "borough": F.lit("Queens"), "lat": none.cast("double"), "lon": none.cast("double"), "confidence": F.lit(0.9), "provider": F.lit("p")}
    primary = cut(asked.where("cast(ref as int) % 2 = 0").select("query", *[c.alias(k) for k, c in answers.items()]))
    history = History(spark, _work(spark), buckets=4)

    def fails() -> DataFrame:
        raise OSError("no page")

    for n in range(CRAWLS):
        sources = {name: (lambda name=name: _landed(seen, n, name)) for name in names}
        if n == 1:
            sources[names[0]] = fails
        crawl(history, sources, {names[0]: 1 << 30 if n == 2 else 1}, primary, None, spark.sql(f"select timestamp'{START} 00:00:00' + interval {n} days as t").first().t)
    when = lambda c: F.date_format(c, "yyyy-MM-dd")
    number = lambda *cs: [F.col(c).cast("long").alias(k) for k, c in zip("abcde", cs, strict=False)] + [none.cast("long").alias(k) for k in "abcde"[len(cs) :]]
    runs = history.log("runs").select(F.lit("run").alias("part"), when("started_at").alias("day"), F.col("source").alias("name"), F.coalesce(F.regexp_replace("error", r"\d+", "N"), F.lit("ok")).alias("what"), *number("n_raw", "n_new", "n_updated", "n_gone", "n_unresolved"))
    events = history.log("events").select(F.lit("event").alias("part"), when("observed_at").alias("day"), F.col("fingerprint").alias("name"), F.col("event").alias("what"), *number("old_price", "new_price"))
    state = history.read("listings").select(F.lit("listing").alias("part"), when("last_seen").alias("day"), F.col("fingerprint").alias("name"), F.concat_ws(" ", "confidence", when("first_seen"), when("gone_at")).alias("what"), *number("price"))
    book = history.read("ledger").select(F.lit("entry").alias("part"), when("our_first_seen").alias("day"), F.col("fingerprint").alias("name"), F.lit("open").alias("what"), *number())
    cache = history.read("geo").groupBy(F.when(F.col("bbl").isNull(), "negative").otherwise("found").alias("what")).agg(F.count("*").alias("n"))
    cache = cache.select(F.lit("cache").alias("part"), none.cast("string").alias("day"), none.cast("string").alias("name"), "what", *number("n"))
    recent = history.recent_runs(12).select(F.lit("recent").alias("part"), when("started_at").alias("day"), F.col("source").alias("name"), F.lit("run").alias("what"), *number("n_raw"))
    return runs.unionByName(recent).unionByName(events).unionByName(state).unionByName(book).unionByName(cache)


def stream_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of all crawls out of a stateful stream over three landed slices of them, one micro-batch each."""
    work, rows = _work(spark), _view(spark, d, "observations").withColumn("crawl", F.col("crawl").cast("timestamp"))
    days = F.floor(F.datediff("crawl", F.lit(START).cast("date")) / 10)
    for k in range(3):  # a start takes what has landed since the last one: a slice is a micro-batch, whatever number of files it has
        rows.where(F.least(F.lit(2), days) == k).write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{work}/in")
        event_stream.start(stream, f"{work}/out", f"{work}/checkpoint", buckets=16).awaitTermination()
    out = spark.read.schema(event_stream.EVENT).parquet(f"{work}/out")
    return out.withColumn("crawl", F.col("crawl").cast("date"))


def _wishes(spark: SparkSession, d: str, *views: str) -> DataFrame:
    parts = [_view(spark, d, v).withColumn("zip_codes", F.lit(None).cast("array<string>")) for v in views]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def saved_search_matches(spark: SparkSession, d: str) -> DataFrame:
    """A saved search for every customer, against all listings, through the index of searches; customers that ask the same are counted together."""
    wanted, members = search.shared(_wishes(spark, d, "wishes"))
    found = search.matching(_state(spark, d), wanted)
    counts = found.groupBy("search").agg(F.count("*").alias("n"), F.min("price").alias("cheapest"), F.max("sqft").alias("largest"), F.min(F.array_join("reasons", ", ")).alias("reason"))
    return search.named(counts, members)


def digest_pages(spark: SparkSession, d: str) -> DataFrame:
    """The messages of all saved searches, two of which match a good part of the listings."""
    held = _state(spark, d).withColumns({"detail_url": F.concat(F.lit("https://l.example/"), "fingerprint"), "source_url": F.lit(None).cast("string")})
    wanted, members = search.shared(_wishes(spark, d, "wishes", "searches"))
    pages = search.bodies(search.matching(held, wanted)).withColumn("body", F.md5("body"))  # before they are named: a body is the same for all who ask the same
    return search.subjects(search.named(pages, members))


_L, _O, _S, _W = (_duck(x) for x in ("listings", "observations", "searches", "wishes"))
_RANK = "map {'low': 0, 'medium': 1, 'high': 2}"
_MATCH = f"""{_RANK}[l.confidence] >= {_RANK}[s.min_confidence] and (s.max_price is null or l.price <= s.max_price) and (s.min_beds is null or l.beds >= s.min_beds)
    and (s.max_beds is null or l.beds is null or l.beds <= s.max_beds) and (s.boroughs is null or coalesce(list_contains(s.boroughs, l.borough), false))
    and (not coalesce(s.require_no_fee, false) or l.no_fee) and (s.min_sqft is null or l.sqft >= s.min_sqft)"""
_REASONS = """concat_ws(', ', case when s.max_price is not null then concat('$', format('{:,}', l.price), '/mo within budget') end,
    case when l.beds is not null then concat(cast(cast(l.beds as int) as varchar), ' bed') end, case when len(s.boroughs) > 0 then l.borough end)"""

EXPECTED: dict[str, str] = {
    "crawl_history": f"""with o as (select least({CRAWLS - 1}, date_diff('day', date '{START}', crawl) // {SLICE}) as n, * from {_O}),
        x as (select n, source, split_part(fingerprint, '/', 1) as ref, arg_max(struct_pack(p := price), struct_pack(c := crawl, o := ordinal)).p as price from o group by 1, 2, 3),
        s as (select source, row_number() over (order by source) as k from (select distinct source from x)),
        seen as (select x.n, x.source, ref, price, substr(sha1(case when ref::int % 2 = 0 then concat('B', ref, '|ref:', source, ':', ref)
                else concat('nobbl|', ref, ' main st|ref:', source, ':', ref, '|1.0') end), 1, 20) as f, ref::int % 2 = 1 as low from x join s using (source) where not (x.n = 1 and s.k = 1)),
        sweep as (select source, n from s, range({CRAWLS}) r(n) where not (k = 1 and n in (1, 2))),
        every as (select distinct f, source from seen), c as (select every.*, r.n from every, range({CRAWLS}) r(n)),
        h as (select c.f, c.source, c.n, z.f is not null as here, z.price, z.low, (select max(y.n) from seen y where y.f = c.f and y.n < c.n) as before,
                (select arg_max(y.price, y.n) from seen y where y.f = c.f and y.n < c.n and y.price is not null) as old from c left join seen z on z.f = c.f and z.n = c.n),
        e as (select *, before is not null and exists (select 1 from sweep w where w.source = h.source and w.n > h.before and w.n < h.n) as out,
                exists (select 1 from sweep w where w.source = h.source and w.n = h.n) as swept from h),
        g as (select *, here and before is null as fresh, here and out as back, here and before is not null and coalesce(price <> old, false) as moved, not here and before is not null and not out and swept as lost from e),
        d(n, day) as (select r.n, strftime(date '{START}' + cast(r.n as int), '%Y-%m-%d') from range({CRAWLS}) r(n)),
        q as (select source, n, count(*) filter (here) as a, count(*) filter (fresh) as b, count(*) filter (back or moved) as c, count(*) filter (lost) as d, count(*) filter (here and low) as e from g group by 1, 2)
        select 'run' as part, day, source as name, case when k = 1 and n = 1 then 'OSError: no page' when k = 1 and n = 2 then 'only N rows returned' else 'ok' end as what, a, b, c, d, e from q join s using (source) join d using (n)
        union all (select 'recent', day, source, 'run', a, null, null, null, null from q join d using (n) order by day desc, source limit 12)
        union all select 'event', day, f, 'new', null, price, null, null, null from g join d using (n) where fresh
        union all select 'event', day, f, 'relisted', old, price, null, null, null from g join d using (n) where back
        union all select 'event', day, f, 'price_change', old, price, null, null, null from g join d using (n) where moved
        union all select 'event', day, f, 'gone', null, null, null, null, null from g join d using (n) where lost
        union all select 'listing', max(day) filter (here), f, concat_ws(' ', case when bool_or(low) then 'low' else 'medium' end, min(day) filter (here),
                case when max(n) filter (lost) > max(n) filter (here) then max(day) filter (lost) end), arg_max(price, n) filter (price is not null), null, null, null, null from g join d using (n) group by f
        union all select 'entry', min(day) filter (here), f, 'open', null, null, null, null, null from g join d using (n) group by f
        union all select 'cache', null, null, case when ref::int % 2 = 0 then 'found' else 'negative' end, count(distinct ref), null, null, null, null from seen group by 4""",
    "saved_search_matches": f"""select s.name as search, count(*) as n, min(l.price) as cheapest, max(l.sqft) as largest, min({_REASONS}) as reason from {_L} l join {_W} s on {_MATCH} group by 1""",
    "digest_pages": f"""with m as (select s.name as search, l.first_seen, l.fingerprint, concat(case when coalesce(l.price, 0) <> 0 then concat('$', format('{{:,}}', l.price), '/mo') else 'price on request' end, ' — ', coalesce(l.address, ''),
            case when coalesce(l.unit_key, '') <> '' then concat(' #', l.unit_key) else '' end, chr(10), '  ', {_REASONS}, case when coalesce(l.sqft, 0) <> 0 then concat(' · ', l.sqft, ' sqft') else '' end,
            case when l.no_fee then ' · no fee' else '' end, chr(10), '  first seen ', coalesce(cast(l.first_seen as varchar), ''), ' via ', l.source, chr(10), '  https://l.example/', l.fingerprint) as line
            from {_L} l join (select * from {_W} union all by name select * from {_S}) s on {_MATCH}),
        p as (select *, row_number() over (partition by search order by first_seen, fingerprint, line) as k, count(*) over (partition by search) as n from m)
        select search, cast((k - 1) // {search.PAGE} + 1 as int) as page, cast(ceil(n / cast({search.PAGE} as double)) as int) as pages, n, concat(n, case when n > 1 then ' new matches for ' else ' new match for ' end, search,
            case when n > {search.PAGE} then concat(' (', (k - 1) // {search.PAGE} + 1, '/', cast(ceil(n / cast({search.PAGE} as double)) as int), ')') else '' end) as subject, md5(string_agg(line, concat(chr(10), chr(10)) order by k)) as body
        from p group by search, n, (k - 1) // {search.PAGE}""",
}

QUERIES = {f.__name__: f for f in (crawl_history, stream_events, saved_search_matches, digest_pages)}
