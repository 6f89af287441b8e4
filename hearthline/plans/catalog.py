"""Queries of the engine's operators over the common test tables, each with equal SQL where SQL can say it.

The tables hold no rental data, so listings, observations and texts are derived
from them by plain SQL that both engines read alike (VIEWS).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.cluster import ship, spread
from hearthline.functions import text as T
from hearthline.functions import times
from hearthline.operators import diff, geo, ledger, match, normalize, search
from hearthline.sources import htmlx, jsonx, registry

UP, AGG = ["up0", "up2", "up4"], ["agg0", "agg1"]

VIEWS = {
    "listings": """
        select substr(sha1(concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string),
                   cast(l_shipdate as string), cast(cast(round(l_extendedprice * 100) as bigint) as string))), 1, 20) as fingerprint,
               case when l_suppkey % 2 = 0 then concat('up', cast(l_suppkey % 6 as string)) else concat('agg', cast(l_suppkey % 3 as string)) end as source,
               case when l_partkey % 7 = 0 then null else concat('1', cast(l_partkey as string)) end as bin,
               case when l_partkey % 5 = 0 then null else concat('B', cast(l_partkey as string)) end as bbl,
               case when l_orderkey % 11 = 0 then null else cast(l_linenumber % 4 as double) end as beds,
               case when l_orderkey % 13 = 0 then null else cast(500 + cast(floor(l_extendedprice) as bigint) % 9000 as int) end as price,
               case when l_suppkey % 3 = 0 then 'Queens' when l_suppkey % 3 = 1 then 'Bronx' else null end as borough,
               case when l_returnflag = 'A' then 'high' when l_returnflag = 'N' then 'medium' else 'low' end as confidence,
               case when l_quantity >= 40 then true else null end as no_fee, cast(l_quantity * 40 as int) as sqft,
               case when l_linenumber % 2 = 0 then cast(l_orderkey % 50 as string) else '' end as unit_key,
               concat(cast(l_partkey as string), ' Main St') as address, l_shipdate as first_seen,
               case when l_orderkey % 4 < 3 then l_shipdate else null end as listed_at,
               case when l_linestatus = 'F' and l_orderkey % 3 = 0 then l_shipdate else null end as gone_at
        from {lineitem}""",
    "observations": """
        select concat(cast(user_id as string), '/', event_type) as fingerprint, event_type as source, cast(ts as date) as crawl, event_id as ordinal,
               case when event_id % 9 = 0 then null else cast(500 + cast(floor(value) as bigint) as int) end as price
        from {events}""",
    "runs": "select distinct event_type as source, cast(ts as date) as started_at from {events}",
    "addresses": """
        select c_custkey, concat(cast(c_custkey % 990 + 1 as string), case when c_custkey % 3 = 0 then ' West 42nd Street' when c_custkey % 3 = 1 then ' E. 7th Ave.' else '-20 North Elm & Oak Road' end) as street,
               concat(case when c_custkey % 4 = 0 then 'Apt. ' when c_custkey % 4 = 1 then '#0' else 'Unit ' end, cast(c_custkey % 77 as string), case when c_custkey % 2 = 0 then '-b' else 'C' end) as unit,
               concat('near ', case when c_custkey % 6 = 0 then 'Astoria' when c_custkey % 6 = 1 then 'BROOKLYN' when c_custkey % 6 = 2 then 'Hoboken' when c_custkey % 6 = 3 then 'Harlem, Queens' when c_custkey % 6 = 4 then 'Riverdale' else 'Bay Ridge' end) as place,
               cast(10000 + (c_custkey * 7) % 1800 as string) as zip
        from {customer}""",
    "quotes": """
        select o_orderkey, concat('$', cast(cast(floor(o_totalprice) as bigint) as string), case when o_orderkey % 3 = 0 then '/mo' when o_orderkey % 3 = 1 then '.50' else '.1.2' end) as rent,
               case when o_orderkey % 5 = 0 then 'Studio' when o_orderkey % 5 = 1 then concat(cast(o_custkey % 15 as string), ' Bedroom + Den') when o_orderkey % 5 = 2 then concat(cast(o_custkey % 4 as string), 'br')
                    when o_orderkey % 5 = 3 then cast(o_custkey % 20 as string) else 'Loft' end as beds,
               case when o_orderkey % 2 = 0 then concat(cast(o_custkey % 30000 as string), ' sq ft') else cast(o_custkey % 30000 as string) end as area,
               case when o_orderkey % 4 = 0 then 'today' when o_orderkey % 4 = 1 then 'yesterday' when o_orderkey % 4 = 2 then concat(cast(o_custkey % 40 as string), ' hours') else concat(cast(o_custkey % 9 as string), ' weeks ago') end as posted,
               case when o_orderkey % 3 = 0 then substr(cast(o_orderdate as string), 1, 19) when o_orderkey % 3 = 1 then concat(substr(cast(o_orderdate as string), 1, 10), 'T08:30:00+02:00') else 'n/a' end as stamp
        from {orders}""",
    "messages": """
        select conv_id, turn, case when turn % 3 = 0 then 'Looking for a place' when turn % 3 = 1 then concat('No fee ', cast(conv_id % 4 + 1 as string), 'BR for rent $', cast(500 + conv_id * 37 % 40000 as string)) else 'Sublet' end as title,
               concat(text, case when conv_id % 2 = 0 then ' in Astoria or Chelsea, $1,900' else ' $99' end) as body
        from {conversations}""",
    "searches": """
        select 'cheap' as name, 3000 as max_price, cast(1 as double) as min_beds, cast(null as double) as max_beds, array('Queens', 'Bronx') as boroughs, cast(null as boolean) as require_no_fee, cast(null as int) as min_sqft, 'medium' as min_confidence
        union all select 'large', cast(null as int), cast(null as double), cast(2 as double), cast(null as array<string>), true, 1700, 'high'""",
    "wishes": """
        select concat('c', cast(c_custkey as string)) as name, case when c_custkey % 8 = 7 then null else cast(550 + c_custkey * 7 % 400 as int) end as max_price,
               case when c_custkey % 5 = 4 then null else cast(c_custkey % 4 as double) end as min_beds, case when c_custkey % 6 = 5 then null else cast(c_custkey % 4 + c_custkey % 3 as double) end as max_beds,
               case when c_custkey % 3 = 0 then array('Queens', 'Bronx') else array('Bronx') end as boroughs, case when c_custkey % 8 = 7 then true else c_custkey % 4 = 0 end as require_no_fee,
               case when c_custkey % 8 = 7 then 1960 when c_custkey % 2 = 0 then 900 else null end as min_sqft, case when c_custkey % 3 = 1 then 'high' else 'medium' end as min_confidence
        from {customer}""",
}


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "events", "customer", "orders", "conversations") if f"{{{t}}}" in sql}
    return spark.sql(sql, **tables)


def _duck(name: str) -> str:
    sql = VIEWS[name].replace("{", "").replace("}", "").replace("array('Queens', 'Bronx')", "['Queens', 'Bronx']").replace("array('Bronx')", "['Bronx']").replace("array<string>", "varchar[]")
    return f"({sql})"


def _state(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, "listings")


def text_fields(spark: SparkSession, d: str) -> DataFrame:
    a = _view(spark, d, "addresses")
    return a.select("c_custkey", T.normalize_street("street").alias("street"), T.normalize_unit("unit").alias("unit"), T.house_number("street").alias("house"), T.infer_borough("place").alias("borough"), T.borough_from_zip("zip").alias("zip_borough"), T.register_street(T.street_part("street")).alias("register_street"))


def numbers(spark: SparkSession, d: str) -> DataFrame:
    q = _view(spark, d, "quotes")
    return q.select("o_orderkey", T.parse_price("rent").alias("price"), T.parse_beds("beds").alias("beds"), T.parse_area("area").alias("sqft"))


def stamps(spark: SparkSession, d: str) -> DataFrame:
    q = _view(spark, d, "quotes")
    posted = times.posted_to_timestamp("posted", F.lit("2026-08-31 12:00:00").cast("timestamp"))
    hours = times.hours_between(posted, F.lit("2026-08-31 12:00:00").cast("timestamp"))
    return q.select("o_orderkey", hours.alias("hours_ago"), F.date_format(times.to_utc("stamp"), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    x = _state(spark, d)
    return x.select("fingerprint", T.fingerprint(F.col("bbl"), F.col("unit_key"), F.col("address"), F.col("beds"), F.col("source"), F.when(F.col("sqft") > 1000, F.col("fingerprint")), F.col("bin")).alias("identity"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    a = _view(spark, d, "addresses")
    title = F.concat(F.col("street"), F.lit(" "), F.regexp_replace("unit", "^[A-Za-z]+[. ]*", ""), F.lit(" - 2 Bedroom"))
    return a.select("c_custkey", T.unit_from_title(title, "street").alias("unit"))


def geo_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = _view(spark, d, "addresses")
    asked = a.select(F.col("street").alias("address"), F.col("place").alias("borough_hint"), "c_custkey")
    known = asked.groupBy(T.geo_key("address", "borough_hint").alias("query")).agg(F.min("c_custkey").alias("k"))
    answer = known.select("query", F.col("k").cast("string").alias("bbl"), F.lit(None).cast("string").alias("bin"), F.col("query").alias("label"), F.lit(None).cast("string").alias("borough"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.when(F.col("k") % 5 == 0, -1.0).when(F.col("k") % 5 == 1, 0.5).otherwise(0.9).alias("confidence"), "k")
    cache = answer.where("k % 2 = 0").withColumn("bbl", F.when(F.col("confidence") != -1.0, F.col("bbl"))).drop("k")
    primary = answer.where("k % 2 = 1 and k % 3 != 0").drop("k")
    return geo.lookup(asked, cache, primary).groupBy("outcome").agg(F.count("*").alias("n"), F.count("bbl").alias("with_bbl"))


def active_listings(spark: SparkSession, d: str) -> DataFrame:
    return search.active(_state(spark, d), limit=200, max_price=4000, min_beds=1.0, borough="Queens").select("fingerprint", "price", "beds", "first_seen")


def new_since(spark: SparkSession, d: str) -> DataFrame:
    return search.new_since(_state(spark, d), F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).groupBy("source").agg(F.count("*").alias("n"), F.max("first_seen").alias("newest"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    return search.summary(_state(spark, d), _view(spark, d, "observations"))


def criteria(spark: SparkSession, d: str) -> DataFrame:
    c = _view(spark, d, "searches").withColumn("zip_codes", F.lit(None).cast("array<string>"))
    got = search.judge(_state(spark, d), c)
    return got.groupBy("search", F.coalesce("reject", F.array_join("reasons", ", ")).alias("verdict")).agg(F.count("*").alias("n"))


def second_run(spark: SparkSession, d: str) -> DataFrame:
    return match.second_runs(_view(spark, d, "runs")).select("source", "second_run")


def cdc_events(spark: SparkSession, d: str) -> DataFrame:
    return diff.history(_view(spark, d, "observations"))


def cdc_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """One crawl (the last day) against the state that the days before left."""
    obs = _view(spark, d, "observations")
    last = obs.agg(F.max("crawl").alias("last"))
    rows = obs.join(F.broadcast(last))
    old = rows.where("crawl < last").groupBy("fingerprint").agg(F.max_by("price", F.when(F.col("price").isNotNull(), F.struct("crawl", "ordinal"))).alias("price"), F.when(F.max("crawl") < F.date_sub(F.max("last"), 1), F.max("crawl")).alias("gone_at"))
    batch = diff.ordinals(rows.where("crawl = last").select("fingerprint", "source", "price", F.col("ordinal").alias("k")), [F.col("k")])
    return diff.verdicts(old, batch).select("fingerprint", "ordinal", "old_price", "price", "verdict")


def mark_gone(spark: SparkSession, d: str) -> DataFrame:
    obs = _view(spark, d, "observations")
    last = obs.agg(F.max("crawl").alias("last"))
    rows = obs.join(F.broadcast(last))
    state = rows.where("crawl = date_sub(last, 1)").select("fingerprint", "source", F.lit(None).cast("date").alias("gone_at")).distinct()
    seen = rows.where("crawl = last").select("fingerprint", "source")
    return diff.gone(state, seen, seen)


def match_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = match.candidates(_state(spark, d), UP, AGG)
    return c.select("building", "u_fp", "a_fp", "matched_by", F.round("penalty", 9).alias("penalty"))


def _runs(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values ('up0', timestamp_ntz'1994-01-01 00:00:00', 1), ('up0', timestamp_ntz'1995-06-01 00:00:00', 2), ('up2', timestamp_ntz'1994-01-01 00:00:00', 3) as t(source, started_at, id)")


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    m = match.matches(_state(spark, d), _runs(spark), UP, AGG)
    return m.select("building", "upstream_fp", "aggregator_fp", "matched_by", "basis")


def _book(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    state = _state(spark, d)
    empty = spark.sql("select '' as fingerprint, cast(null as timestamp_ntz) as our_first_seen, cast(null as string) as aggregator, cast(null as timestamp_ntz) as aggregator_seen, cast(null as double) as lead_hours, cast(null as string) as basis, cast(null as string) as matched_by, cast(null as string) as matched_fp").where("fingerprint != ''")
    book = ledger.open_entries(empty, state.where(F.col("source").isin(UP)))
    judged = ledger.judge(match.matches(state, _runs(spark), UP, AGG), book)
    return ledger.record(book, judged), judged


def lead_report(spark: SparkSession, d: str) -> DataFrame:
    return ledger.distribution(_book(spark, d)[0])


def match_counters(spark: SparkSession, d: str) -> DataFrame:
    return ledger.run_counters(_book(spark, d)[1])


def match_counters_again(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a second pairing, over a ledger that holds the first one's measurements but has lost half of its entries."""
    book = _book(spark, d)[0].where("fingerprint >= '8'")
    return ledger.run_counters(ledger.judge(match.matches(_state(spark, d), _runs(spark), UP, AGG), book))


def _pairs_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger made straight from the listings, so that SQL can follow it: each order's own dates as its two clocks."""
    x = _state(spark, d)
    q = F.expr("sqft div 40")
    lead = F.when(q % 3 != 0, (q * 37 % 400 - 120) / 4.0)
    basis = F.when(q % 7 == 0, match.CENSORED).when(q % 5 == 0, "listed_at->first_seen").when(F.col("listed_at").isNull(), "first_seen->first_seen").otherwise("listed_at->listed_at")
    return x.select("fingerprint", F.col("source").alias("aggregator"), lead.alias("lead_hours"), basis.alias("basis"), F.when(lead.isNotNull(), F.col("first_seen")).alias("aggregator_seen"))


def lead_distribution(spark: SparkSession, d: str) -> DataFrame:
    return ledger.distribution(_pairs_ledger(spark, d))


def lead_by_basis(spark: SparkSession, d: str) -> DataFrame:
    return ledger.by_basis(_pairs_ledger(spark, d))


def lead_by_aggregator(spark: SparkSession, d: str) -> DataFrame:
    return ledger.by_aggregator(_pairs_ledger(spark, d))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def page_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The links of each page that lead to addresses, in their places."""
    pages = _pages(spark, d).select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), "html")
    return htmlx.anchors(pages).select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id"), "pos", "href", "link")


def page_links(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    more = F.concat(F.lit('<a href="/available-apartments/'), k, F.lit('">Available apartments</a><a href="/buildings/'), k, F.lit('-main-st?x=1">'), k, F.lit(" East 21st Street</a>"))
    p = _pages(spark, d).select("url", F.col("page_id").alias("seq"), F.concat("html", more).alias("html"))  # an address may have landed several times
    return htmlx.navigation(p).unionByName(htmlx.building_links(p, 6)).unionByName(htmlx.portfolio_links(p)).drop("seq")


def page_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return htmlx.verdicts(_pages(spark, d).select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), "html")).select("url", "verdict", F.col("rank").cast("int").alias("rank"))


def verdict_totals(spark: SparkSession, d: str) -> DataFrame:
    return htmlx.verdict_totals(page_verdicts(spark, d)).select("verdict", "n", F.round("share", 6).alias("share"))


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).select(F.col("page_id").cast("string").alias("url"), "html")
    return htmlx.building_verdicts(pages).select(F.col("url").cast("long").alias("page_id"), "prices", "beds", "units")


def page_details(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).select("page_id", "url", F.concat(F.lit("<h1>"), F.col("page_id").cast("string"), F.lit(" Water Street, #"), F.col("page_id").cast("string"), F.lit("A</h1><p>2 Beds, 1.5 Baths, $4,"), F.lpad(F.col("page_id").cast("string"), 3, "0"), F.lit("</p><i>New York 10038</i> 2 months free "), F.col("html")).alias("html"))
    return htmlx.details(p, "detail").select("address", "unit_raw", "price_raw", "beds_raw", "baths_raw", "borough_hint", F.col("extra")["months_free"].alias("months_free"))


def page_markup(spark: SparkSession, d: str) -> DataFrame:
    part = spread(spark.read.parquet(f"{d}/part.parquet"), "p_partkey")
    node = F.to_json(F.struct(F.lit("Apartment").alias("@type"), F.col("p_name").alias("name"), F.struct(F.concat(F.col("p_partkey").cast("string"), F.lit(" Elm St")).alias("streetAddress")).alias("address"), F.array(F.struct(F.col("p_retailprice").alias("price"))).alias("offers")))
    pages = part.select(F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string")).alias("url"), F.concat(F.lit('<script type="application/ld+json">{"@graph": ['), node, F.lit(",]}</script>")).alias("html"))
    return htmlx.markup(pages, "markup").select("source_url", "address", F.col("price_raw").cast("double").alias("price"), "title")


def social(spark: SparkSession, d: str) -> DataFrame:
    m = _view(spark, d, "messages").withColumn("f", T.post_fields("title", "body"))
    return m.select("conv_id", "turn", T.is_offer("title", "body").alias("offer"), F.col("f.price").alias("price"), F.col("f.beds").alias("beds"), F.col("f.neighborhood").alias("neighborhood"))


def json_dig(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", jsonx.dig(F.try_parse_json("props"), "k", "int").alias("k"), jsonx.dig(F.try_parse_json("props"), "a.0.b").alias("missing"))


def json_records(spark: SparkSession, d: str) -> DataFrame:
    """A payload for each order, its lines the records; the list sits beside a shorter one."""
    own = F.col("l_linenumber").alias("unitNumber"), F.struct(F.concat("l_partkey", F.lit(" Elm St")).alias("line1")).alias("address"), (F.col("l_partkey") % 9000 + 1000).alias("marketRent")
    lines = spread(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("units"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("page"))).alias("paging"), F.struct("units").alias("data")))
    payloads = lines.select(F.col("l_orderkey").cast("string").alias("url"), F.lit("GET").alias("method"), body.alias("body"))
    rows = jsonx.json_api(payloads, "api", {"address": "address.line1", "unit_raw": "unitNumber", "price": "marketRent"})
    return rows.select(F.col("source_url").alias("payload"), "address", "unit_raw", T.parse_price("price_raw", "price_num").alias("price"))


def survey_rank(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 == 0, "JSONLD").when(F.col("s_suppkey") % 4 == 1, "PMS").when(F.col("s_suppkey") % 4 == 2, "HTML").otherwise("DEAD").alias("verdict"))
    return registry.ranked_survey(s, {"JSONLD": 0, "PMS": 1, "SPA": 2, "HTML": 3, "BLOCKED": 4, "DEAD": 5})


def queue_slice(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_name", F.col("s_suppkey").alias("seq"), F.when(F.col("s_nationkey") % 2 == 0, "Acme PMS").otherwise("Other").alias("vendor"), F.lit("1").alias("tier"))
    return registry.queue(s, vendor="acme", tier="1", offset=5, limit=20).select("seq", "s_name", "vendor")


def normalized(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from raw records to listings, over derived addresses and rents."""
    a = _view(spark, d, "addresses")
    raw = a.select(F.lit("s").alias("source"), F.col("street").alias("address"), F.col("place").alias("borough_hint"), F.col("unit").alias("unit_raw"), F.concat(F.lit("$"), (F.col("c_custkey") % 9000 + 400).cast("string")).alias("price_raw"), F.lit("1 Bedroom").alias("beds_raw"), F.col("c_custkey").cast("string").alias("source_ref"))
    keys = raw.select(T.geo_key("address", "borough_hint").alias("query")).distinct()
    g = keys.select("query", F.lit(True).alias("found"), F.md5("query").alias("bbl"), F.lit(None).cast("string").alias("bin"), F.upper("query").alias("label"), F.lit("Queens").alias("borough"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(0.9).alias("confidence")).where(F.length("query") % 3 != 0)
    out = normalize.normalize(raw, g, F.lit("2026-08-31 12:00:00").cast("timestamp"))
    return out.groupBy("confidence", "borough").agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("units"), F.sum("price").alias("rents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lead_report, lead_distribution, lead_by_basis, lead_by_aggregator, match_candidates, greedy_match, match_counters, match_counters_again, text_fields, numbers, stamps, fingerprints, titles, geo_lookup, normalized,
        active_listings, new_since, summary, criteria, second_run, cdc_events, cdc_verdicts, mark_gone, page_anchors, page_links, page_verdicts, verdict_totals, page_counts, page_details, page_markup,
        social, json_dig, json_records, survey_rank, queue_slice,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    from hearthline.plans import histories, landed, mixed, trips

    return {k: shipped(f) for k, f in (QUERIES | landed.QUERIES | histories.QUERIES | mixed.QUERIES | trips.QUERIES).items()}
