"""Queries of sources and state over payloads made of the common test tables, each beside its expected rows as SQL.

The payloads (JSON, HTML, crawls) are built from the tables' rows, so they grow
with them; the SQL says what must come out without reading the payloads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.cluster import spread
from hearthline.operators import diff, geo, ledger, search
from hearthline.plans.catalog import _duck, _pages, _state, _view
from hearthline.sources import htmlx, jsonx, registry

NOW = "2026-08-31 12:00:00"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """A payload for each order, of one of three shapes, dealt over partitions by the order."""
    lines = spread(_read(spark, d, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("lines"))
    own = lambda x: x["l_linenumber"].cast("string")
    shape = [
        lambda x: F.struct(own(x).alias("unitNumber"), F.struct(F.concat(x["l_partkey"], F.lit(" Elm St")).alias("line1")).alias("address"), x["l_quantity"].alias("marketRent")),
        lambda x: F.struct(own(x).alias("apt"), F.concat(x["l_partkey"], F.lit(" Oak St")).alias("street"), x["l_quantity"].alias("rent"), F.lit(2).alias("bedrooms")),
        lambda x: F.struct(own(x).alias("id"), F.lit(True).alias("rented")),
    ]
    r0, r1, r2 = (F.array_sort(F.transform("lines", s)) for s in shape)
    pad = F.repeat(F.lit("x"), 200).alias("pad")
    bodies = [F.to_json(F.struct(pad, r0.alias("units"))), F.to_json(F.struct(pad, F.struct(r1.alias("rows")).alias("data"))), F.to_json(F.struct(pad, r2.alias("rows")))]
    body = F.when(F.col("l_orderkey") % 3 == 0, bodies[0]).when(F.col("l_orderkey") % 3 == 1, bodies[1]).otherwise(bodies[2])
    url = F.concat(F.lit("https://h"), F.col("l_orderkey") % 50, F.lit(".example/list?k="), F.col("l_orderkey"))
    return lines.select(url.alias("url"), F.lit("GET").alias("method"), body.alias("body"), F.col("l_orderkey").alias("seq"))


def field_maps(spark: SparkSession, d: str) -> DataFrame:
    return jsonx.field_maps(_payloads(spark, d)).select("url", "n_records", F.to_json("fields").alias("fields"), "score")


def endpoints_of(spark: SparkSession, d: str) -> DataFrame:
    captures = _payloads(spark, d).withColumns({"content_type": F.lit("application/json; charset=utf-8"), "origin": F.lit("https://o.example")})
    return jsonx.endpoints(captures)


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    return endpoints_of(spark, d).select("url", "score", "n_records", "seq")


_SHAPES = "select l_orderkey as k, cast(count(*) as int) as n from lineitem where l_orderkey % 3 <> 2 group by 1 having count(*) >= 3"
_URL = "concat('https://h', k % 50, '.example/list?k=', k)"
_MAP = """case k % 3 when 0 then '{"address":"address.line1","price":"marketRent","unit_raw":"unitNumber"}' else '{"address":"street","beds":"bedrooms","price":"rent","unit_raw":"apt"}' end"""


def cards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    rent = F.col("p_partkey") % 8 + 1
    card = F.concat(
        F.lit('<article class="card"><a href="/apartmentlistings/'), F.md5(k), F.lit('.html"><p class="card__title">Flat '), k, F.lit('</p></a><div class="card__adress">'), k, F.lit(' Elm Street (Astoria, QN)</div><p class="card__price">$'), rent.cast("string"),
        F.lit(',500 net effective</p><p class="card__facilities">2 bed, 1.5 bath</p><p class="card__info">Acme Homes, posted 3 days ago</p><div class="card__labels">No Fee</div><ul><li>Gym</li><li>2 bed</li></ul></article>'),
    )
    pages = _read(spark, d, "part").groupBy(F.expr("p_partkey div 100").alias("seq")).agg(F.array_join(F.array_sort(F.collect_list(card)), "\n").alias("html")).withColumn("url", F.concat(F.lit("https://c.example/"), F.col("seq")))
    twice = pages.unionByName(pages.withColumn("seq", -1 - F.col("seq")))  # the same results once more: each card counts once
    out = htmlx.cards(twice, "cards", F.lit(NOW).cast("timestamp"), "https://c.example")
    return out.select("source_url", "address", "price_raw", "beds_raw", "baths_raw", "listed_at", "title", "detail_url", "no_fee", "source_ref", F.col("extra")["neighborhood"].alias("hood"), F.col("extra")["amenities"].alias("amenities"), F.col("extra")["net_effective"].alias("net_effective"))


def lotteries(spark: SparkSession, d: str) -> DataFrame:
    s = _read(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    body = F.to_json(F.struct(
        k.alias("lottery_id"), F.col("s_name").alias("lottery_name"), F.when(F.col("s_suppkey") % 2 == 0, "Active").otherwise("Closed").alias("lottery_status"), F.when(F.col("s_suppkey") % 7 == 0, "Homeowner").otherwise("Rental").alias("development_type"),
        F.lpad(k, 9, "0").alias("lottery_start_date"), F.when(F.col("s_suppkey") % 3 == 0, "Multiple").otherwise("10001").alias("postcode"), F.lit("QUEENS").alias("borough"), F.lit("3").alias("applied_income_ami_40"), k.alias("unit_distribution_1bed"),
    ))
    out = jsonx.lotteries(s.select(body.alias("body")), "lot", limit=None)
    return out.select("source_url", "address", "title", "borough_hint", F.col("extra")["ami_bands"].alias("ami"), F.col("extra")["unit_mix"].alias("mix"), F.col("extra")["multi_building"].alias("several"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 30 * 100 + 900).cast("string").alias("rent"))
    k = F.col("o_orderkey")
    title = F.when(k % 4 == 0, "Looking for a room").otherwise(F.concat(F.lit("No fee "), (k % 3 + 1).cast("string"), F.lit("br for rent $"), "rent"))
    child = F.struct(F.struct(k.cast("string").alias("id"), title.alias("title"), F.lit("Sunny flat in Astoria.").alias("selftext"), F.lit("a").alias("author"), F.concat(F.lit("/p/"), k).alias("permalink")).alias("data"))
    pages = o.groupBy(F.expr("o_orderkey div 100").cast("string").alias("channel")).agg(F.to_json(F.struct(F.struct(F.collect_list(child).alias("children")).alias("data"))).alias("body"))
    return jsonx.posts(pages, "board").select("source_url", "address", "price_num", "beds_raw", "no_fee", "source_ref", "detail_url")


def index_links(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    link = F.concat(F.lit('<a href="/homes/'), k, F.lit('?from=index">x</a>'))
    pages = _read(spark, d, "part").groupBy(F.expr("p_partkey div 100").alias("seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, link.alias("a")))), lambda x: x["a"]), " ").alias("html")).withColumn("url", F.lit("https://i.example/all"))
    return htmlx.detail_links(pages, r"/homes/\d+\?from=index", 60).select("link", F.col("seq").cast("int").alias("seq"), "pos")


def digests(spark: SparkSession, d: str) -> DataFrame:
    wanted = _view(spark, d, "searches").withColumn("zip_codes", F.lit(None).cast("array<string>"))
    held = _state(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("detail_url", "source_url")})
    pages = search.digests(search.matching(held, wanted)).withColumn("lines", F.size(F.split("body", "\n\n")))
    whole = pages.groupBy("search", "n").agg(F.min(F.regexp_replace("subject", r" \(page .*$| \(\d+/\d+\)$", "")).alias("subject"), F.sum("lines").alias("lines"))
    return whole.select("search", "n", "subject", (F.col("lines") == F.col("n")).alias("whole"))


def geo_cache(spark: SparkSession, d: str) -> DataFrame:
    """A lookup with a second provider, what the cache learns of it, and a second lookup that only reads the cache."""
    from hearthline.functions import text as T

    asked = _read(spark, d, "supplier").select(F.concat("s_suppkey", F.lit(" Elm Street")).alias("address"), F.lit("Bronx").alias("borough_hint"), "s_suppkey")
    known = asked.select(T.geo_key("address", "borough_hint").alias("query"), F.col("s_suppkey").alias("k"))
    text = lambda c: F.lit(None).cast(c)
    answer = lambda conf: known.select("query", "k", F.concat(F.lit("L"), F.col("k")).alias("bbl"), text("string").alias("bin"), text("string").alias("label"), F.lit("Bronx").alias("borough"), text("double").alias("lat"), text("double").alias("lon"), conf.alias("confidence"), F.lit("first").alias("provider"))
    primary = answer(F.when(F.col("k") % 3 == 1, 0.4).otherwise(0.9)).where("k % 3 != 2").drop("k")
    primary = primary.unionByName(primary.withColumns({"bbl": F.lit("worse"), "confidence": F.lit(0.1)}))  # the more confident answer counts
    register = _read(spark, d, "supplier").where("s_suppkey % 6 = 2").select(F.lit("2").alias("boroid"), F.col("s_suppkey").cast("string").alias("lowhousenumber"), F.lit("ELM STREET").alias("streetname"), text("string").alias("bin"), F.lit("7").alias("block"), F.lit("1").alias("lot"), F.col("s_suppkey").cast("string").alias("housenumber"))
    cache = answer(F.lit(0.9)).limit(0).drop("k")
    first = geo.lookup(asked, cache, primary, register)
    learnt = geo.remember(first, cache)
    again = geo.lookup(asked, learnt, primary.limit(0))
    count = lambda df, run: df.groupBy("outcome", "bbl").agg(F.count("*").alias("n")).groupBy("outcome").agg(F.sum("n").alias("n"), F.count_if(F.col("bbl") == "worse").alias("worse")).withColumn("run", F.lit(run))
    return count(first, 1).unionByName(count(again, 2))


def geo_statistics(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.element_at(F.array(*map(F.lit, ("hit", "negative", "resolved", "fallback", "low", "empty", "failed"))), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return geo.statistics(_read(spark, d, "supplier").select(outcome.alias("outcome")))


def fold_state(spark: SparkSession, d: str) -> DataFrame:
    """The state after the last day's crawl, all its sources swept."""
    rows = _view(spark, d, "observations")
    rows = rows.join(F.broadcast(rows.agg(F.max("crawl").alias("last"))))
    none = lambda c: F.lit(None).cast(c)
    at = F.col("crawl").cast("timestamp")
    old = rows.where("crawl < last").groupBy("fingerprint").agg(F.first("source").alias("source"), F.max_by("price", F.when(F.col("price").isNotNull(), F.struct("crawl", "ordinal"))).alias("price"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.when(F.max("crawl") < F.date_sub(F.max("last"), 2), F.max(at)).alias("gone_at"))
    old = old.withColumns({"available_on": none("string"), "detail_url": none("string")})
    batch = diff.ordinals(rows.where("crawl = last").select("fingerprint", "source", "price", none("string").alias("available_on"), none("string").alias("detail_url"), at.alias("first_seen"), at.alias("last_seen"), F.col("ordinal").alias("k")), [F.col("k")]).drop("k")
    last = rows.agg(F.max("crawl")).first()[0]
    swept = batch.select("source").distinct()
    state = diff.fold(old, batch, F.lit(str(last)).cast("timestamp"), swept).state
    return state.select("fingerprint", "source", "price", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_seen", "last_seen", "gone_at")])


def building_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    links = pages.select(F.concat(F.lit("https://p.example/"), F.col("page_id") % 10).alias("url"), F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("https://none.example/"), "page_id")).otherwise(htmlx.bare("url")).alias("link"), F.concat(F.lit("house "), "page_id").alias("label"), F.col("page_id").cast("int").alias("place"))
    return htmlx.building_pages(links, pages).select("portfolio", "label", "place", "url", F.length("html").alias("chars"))


def building_verdicts(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), "html")
    return htmlx.building_verdicts(p).select("url", "verdict", "prices", "beds", "units")


def drill_totals(spark: SparkSession, d: str) -> DataFrame:
    return htmlx.drill_totals(building_verdicts(spark, d)).withColumn("crawlable_share", F.round("crawlable_share", 9))


def survey_totals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    names = F.array(*map(F.lit, ("JSONLD", "PMS", "SPA", "HTML", "BLOCKED", "DEAD")))
    return htmlx.survey_totals(_read(spark, d, "supplier").select(F.element_at(names, (k % 6 + 1).cast("int")).alias("verdict"), F.when(k % 5 == 0, "DISALLOW").when(k % 5 == 1, "none").otherwise("allow").alias("robots")))


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    homes = _read(spark, d, "supplier").select(F.concat(F.lit("https://s"), "s_suppkey", F.lit(".example/home?x=1")).alias("url"), "s_suppkey")
    links = homes.where("s_suppkey % 4 = 0").select("url", F.lit("https://a.example/rent").alias("link"), F.lit(1).alias("place"))
    return htmlx.entry_points(homes, links)


def reachable(spark: SparkSession, d: str) -> DataFrame:
    s = _read(spark, d, "supplier").select(F.col("s_name").alias("domain"), (F.col("s_suppkey") % 4).alias("k"))
    first = s.select("domain", F.lit(1).alias("attempt"), F.when(F.col("k") == 0, 403).when(F.col("k") == 1, 500).alias("status"), F.when(F.col("k") == 2, "Name or service not known").when(F.col("k") == 3, "timed out").alias("error"))
    second = s.select("domain", F.lit(2).alias("attempt"), F.when(F.col("k") <= 1, 200).alias("status"), F.when(F.col("k") == 2, "Name or service not known").when(F.col("k") == 3, "timed out").alias("error"))
    return htmlx.reachable(first.unionByName(second))


def best_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _read(spark, d, "part").select((k % 50).alias("site"), F.concat(F.lit("u"), k).alias("url"), F.lit("HTML").alias("verdict"), (F.col("p_size") % 4).alias("rank"), (k < 50).alias("is_home"), k.alias("pos"))
    return htmlx.best_pages(rows).select("site", "url", F.col("rank").cast("int").alias("rank"))


def recent(spark: SparkSession, d: str) -> DataFrame:
    """Listings of the 48 hours before a moment."""
    since = search.look_back(F.lit("1998-01-05 00:00:00").cast("timestamp"), 48)
    return search.new_since(_state(spark, d).withColumn("first_seen", F.col("first_seen").cast("timestamp")), since).groupBy("source").agg(F.count("*").alias("n"))


def registry_entries(spark: SparkSession, d: str) -> DataFrame:
    """The entries of a registry's text, what is expected of each, and how many rows the orders' priorities, taken as sources, have."""
    text = """{"sources": [{"id": "1-URGENT", "type": "jsonld"}, {"id": "2-HIGH", "type": "cards", "enabled": false},
        {"id": "3-MEDIUM", "type": "posts", "min_expected": 1000000000}, {"id": "none", "type": "posts", "min_expected": 7}]}"""
    read = _read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("n"))
    rows = registry.expectations(spark, registry.enabled(registry.entries(text))).join(read, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("source", "min_expected", "n", (F.col("n") < F.col("min_expected")).alias("short"))


def ledger_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries opened for listings, those that the ledger knew left as they were."""
    state = _state(spark, d).select("fingerprint", "first_seen")
    old = state.where("fingerprint < '8'").select("fingerprint", F.lit("1990-01-01 00:00:00").cast("timestamp_ntz").alias("our_first_seen"))
    return ledger.open_entries(old, state).select("fingerprint", F.date_format("our_first_seen", "yyyy-MM-dd").alias("seen"))


_VENDOR = f"regexp_matches(lower(html), '\\b({'|'.join(htmlx.VENDOR_TOKENS)})\\.(com|net|us|io)\\b')"
_COUNTED = f"""select concat(url, '#', page_id) as url, cast(len(list_distinct(regexp_extract_all(html, '{htmlx.RENT_IN_PAGE}'))) as int) as prices, cast(len(regexp_extract_all(html, '{htmlx.BED_IN_PAGE}')) as int) as beds,
    cast(len(regexp_extract_all(html, '{htmlx.UNIT_IN_PAGE}')) as int) as units, {_VENDOR} as v, length(html) // 1024 as kb from pages"""
_BUILDINGS = f"select url, case when prices >= 3 and beds > 0 then 'INLINE' when v then 'VENDOR' when kb < 40 then 'SPA' else 'OPAQUE' end as verdict, prices, beds, units from ({_COUNTED})"
_L, _O, _S = (_duck(x) for x in ("listings", "observations", "searches"))
_RANK = lambda c: f"case {c} when 'high' then 2 when 'medium' then 1 else 0 end"
_HIT = f"""{_RANK('l.confidence')} >= {_RANK('s.min_confidence')} and (s.max_price is null or l.price <= s.max_price) and (s.min_beds is null or l.beds >= s.min_beds) and (s.max_beds is null or l.beds is null or l.beds <= s.max_beds)
    and (s.boroughs is null or coalesce(list_contains(s.boroughs, l.borough), false)) and (not coalesce(s.require_no_fee, false) or l.no_fee) and (s.min_sqft is null or l.sqft >= s.min_sqft)"""

EXPECTED: dict[str, str] = {
    "field_maps": f"select {_URL} as url, n as n_records, {_MAP} as fields, cast(case k % 3 when 0 then 11 else 13 end + n // 10 as int) as score from ({_SHAPES})",
    "endpoints": f"with s as ({_SHAPES}) select {_URL} as url, cast(case k % 3 when 0 then 11 else 13 end + n // 10 as int) as score, n as n_records, k as seq from s where k in (select min(k) from s group by k % 50)",
    "cards": """select concat('https://c.example/', p_partkey // 100) as source_url, concat(p_partkey, ' Elm Street') as address, concat(p_partkey % 8 + 1, ',500') as price_raw, '2 bed' as beds_raw, '1.5' as baths_raw, '2026-08-28 12:00:00' as listed_at, concat('Flat ', p_partkey) as title,
        concat('https://c.example/apartmentlistings/', md5(cast(p_partkey as varchar)), '.html') as detail_url, true as no_fee, md5(cast(p_partkey as varchar)) as source_ref, 'Astoria' as hood, '["Gym"]' as amenities, 'true' as net_effective from part""",
    "lotteries": """select concat('lottery:', s_suppkey) as source_url, concat(s_name, case when s_suppkey % 3 <> 0 then ' 10001' else '' end) as address, s_name as title, 'Queens' as borough_hint, '{"40":"3"}' as ami, concat('{"1bed":"', s_suppkey, '"}') as mix,
        case when s_suppkey % 3 = 0 then 'true' else 'false' end as several from supplier where s_suppkey % 2 = 0 and s_suppkey % 7 <> 0""",
    "posts": """select cast(o_orderkey // 100 as varchar) as source_url, 'astoria' as address, cast(o_orderkey % 30 * 100 + 900 as double) as price_num, concat(o_orderkey % 3 + 1, 'br') as beds_raw, true as no_fee, cast(o_orderkey as varchar) as source_ref, concat('/p/', o_orderkey) as detail_url from orders where o_orderkey % 4 <> 0""",
    "index_links": "select concat('https://i.example/homes/', p_partkey) as link, cast(p_partkey // 100 as int) as seq, cast(row_number() over (partition by p_partkey // 100 order by p_partkey) - 1 as int) as pos from part order by 2, 3 limit 60",
    "digests": f"select s.name as search, count(*) as n, concat(count(*), case when count(*) > 1 then ' new matches for ' else ' new match for ' end, s.name) as subject, true as whole from {_L} l join {_S} s on {_HIT} group by 1",
    "geo_cache": """with o as (select case s_suppkey % 3 when 0 then 'resolved' when 1 then 'low' else case when s_suppkey % 6 = 2 then 'fallback' else 'empty' end end as outcome from supplier)
        select outcome, count(*) as n, 0 as worse, 1 as run from o group by 1 union all select case when outcome in ('resolved', 'fallback') then 'hit' else 'negative' end, count(*), 0, 2 from o group by 1""",
    "geo_statistics": "select count(*) filter (s_suppkey % 7 < 2) as hit, count(*) filter (s_suppkey % 7 >= 2) as miss, count(*) filter (s_suppkey % 7 = 6) as fail, count(*) filter (s_suppkey % 7 = 4) as low_confidence, count(*) filter (s_suppkey % 7 = 3) as fallback from supplier",
    "fold_state": f"""with o as {_O}, l as (select max(crawl) as last from o),
        s as (select fingerprint, any_value(source) as source, arg_max(price, struct_pack(c := crawl, o := ordinal)) filter (price is not null) as price, min(crawl) as a, max(crawl) as z, case when max(crawl) < (select last from l) - 2 then max(crawl) end as gone from o, l where crawl < last group by 1),
        b as (select fingerprint, any_value(source) as source, arg_max(price, ordinal) filter (price is not null) as price, max(last) as last from o, l where crawl = last group by 1)
        select fingerprint, coalesce(s.source, b.source) as source, coalesce(b.price, s.price) as price, strftime(coalesce(s.a, b.last), '%Y-%m-%d') as first_seen, strftime(coalesce(b.last, s.z), '%Y-%m-%d') as last_seen,
            strftime(case when b.fingerprint is null then coalesce(s.gone, case when s.source in (select source from b) then (select last from l) end) end, '%Y-%m-%d') as gone_at from s full join b using (fingerprint)""",
    "building_pages": """with p as (select *, regexp_replace(url, '[?#].*$', '') as bare from pages), h as (select bare, min(html) as html from p group by 1)
        select concat('https://p.example/', page_id % 10) as portfolio, concat('house ', page_id) as label, cast(page_id as int) as place, case when page_id % 9 = 0 then concat('https://none.example/', page_id) else p.bare end as url, cast(case when page_id % 9 <> 0 then length(h.html) end as int) as chars from p join h using (bare)""",
    "building_verdicts": _BUILDINGS,
    "drill_totals": f"select count(*) as n, count(*) filter (verdict in ('INLINE', 'VENDOR')) as crawlable, round(count(*) filter (verdict in ('INLINE', 'VENDOR')) / cast(count(*) as double), 9) as crawlable_share from ({_BUILDINGS})",
    "survey_totals": "select count(*) as n, count(*) filter (s_suppkey % 6 < 4) as reachable, count(*) filter (s_suppkey % 6 = 0) as zero_code, count(*) filter (s_suppkey % 6 < 2) as cheap, count(*) filter (s_suppkey % 5 = 0) as disallowed from supplier",
    "entry_points": f"""select concat('https://s', s_suppkey, '.example/home?x=1') as url, 'https://a.example/rent' as link, 1 as place from supplier where s_suppkey % 4 = 0
        union all select concat('https://s', s_suppkey, '.example/home?x=1'), concat('https://s', s_suppkey, '.example', p), k from supplier, (values {', '.join(f"({k + 1}, '{p}')" for k, p in enumerate(htmlx.FALLBACK))}) as t(k, p) where s_suppkey % 4 <> 0""",
    "reachable": "select s_name as domain, case s_suppkey % 4 when 0 then 'BLOCKED' when 1 then 'OK' when 2 then 'DEAD' else 'BLOCKED' end as verdict from supplier",
    "best_pages": """select site, url, cast(rank as int) as rank from (select p_partkey % 50 as site, concat('u', p_partkey) as url, p_size % 4 as rank,
        row_number() over (partition by p_partkey % 50 order by case when p_partkey < 50 and p_size % 4 = 0 then -1 else p_size % 4 end, p_partkey < 50, p_partkey) as k from part) where k = 1""",
    "recent": f"select source, count(*) as n from {_L} where gone_at is null and first_seen > timestamp '1998-01-03 00:00:00' group by 1",
    "registry_entries": """select source, min_expected, count(o_orderkey) as n, count(o_orderkey) < min_expected as short
        from (values ('1-URGENT', 1), ('3-MEDIUM', 1000000000), ('none', 7)) as t(source, min_expected) left join orders on o_orderpriority = source group by 1, 2""",
    "ledger_entries": f"select fingerprint, case when fingerprint < '8' then '1990-01-01' else strftime(min(first_seen), '%Y-%m-%d') end as seen from {_L} group by fingerprint",
}

QUERIES = {f.__name__: f for f in (field_maps, endpoints, cards, lotteries, posts, index_links, digests, geo_cache, geo_statistics, fold_state, building_pages, building_verdicts, drill_totals, survey_totals, entry_points, reachable, best_pages, recent, registry_entries, ledger_entries)}
