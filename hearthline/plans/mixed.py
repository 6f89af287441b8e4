"""Queries over payloads that take the branches others don't: registries of mixed sources, declared lists, rejected captures and posts, vendors' links, accents, lot numbers.

Each payload is made of the common tables' rows; the SQL beside it says what must come out of it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.cluster import spread
from hearthline.functions import text as T
from hearthline.operators import geo
from hearthline.plans.landed import _read
from hearthline.sources import htmlx, jsonx, registry

REGISTRY = json.dumps({
    "sources": [
        {"id": "markup", "type": "jsonld", "operator": "Elm", "min_expected": 5},
        {"id": "api", "type": "jsonapi", "root": "units", "fields": {"address": "address.line1", "unit_raw": "unitNumber", "price": "marketRent"}},
        {"id": "lots", "type": "lotteries", "limit": None, "min_expected": 1_000_000_000},
        {"id": "board", "type": "posts"},
        {"id": "off", "type": "cards", "enabled": False},
    ]
})


def _ld(*nodes: Column) -> Column:
    """A page of a JSON-LD block."""
    return F.concat(F.lit('<html><script type="application/ld+json">'), *nodes, F.lit("</script></html>"))


def _landed(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of four sources and of one that is switched off, as one table of landings."""
    none = F.lit(None).cast("string")
    k, p, s = F.col("o_orderkey"), F.col("p_partkey"), F.col("s_suppkey")
    node = F.to_json(F.struct(F.lit("Apartment").alias("@type"), F.col("p_name").alias("name"), F.struct(F.concat(p, F.lit(" Elm St")).alias("streetAddress")).alias("address")))
    units = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda u: F.struct(u.alias("unitNumber"), F.struct(F.concat(k.cast("string"), F.lit(" Oak St")).alias("line1")).alias("address"), (u * 1000).alias("marketRent"))).alias("units")))
    lot = F.to_json(F.struct(s.cast("string").alias("lottery_id"), F.col("s_name").alias("lottery_name"), F.when(s % 2 == 0, "Active").otherwise("Closed").alias("lottery_status"), F.lit("Rental").alias("development_type")))
    post = F.struct(F.struct(k.cast("string").alias("id"), F.concat(F.lit("No fee 2br for rent $"), (k % 30 * 100 + 900).cast("string")).alias("title"), F.lit("Flat in Astoria.").alias("selftext")).alias("data"))
    board = F.to_json(F.struct(F.struct(F.array(post).alias("children")).alias("data")))
    row = lambda source, url, html=none, body=none, channel=none: [F.lit(source).alias("source"), url.alias("url"), html.alias("html"), body.alias("body"), channel.alias("channel")]
    orders = spread(_read(spark, d, "orders"), "o_orderkey")
    pages = spread(_read(spark, d, "part"), "p_partkey").select(*row("markup", F.concat(F.lit("https://m.example/"), p), _ld(node)))
    out = pages.unionByName(pages.withColumn("source", F.lit("off")))
    out = out.unionByName(orders.where(k % 2 == 0).select(*row("api", F.concat(F.lit("https://a.example/"), k), body=units)))
    out = out.unionByName(_read(spark, d, "supplier").select(*row("lots", F.lit("https://l.example/"), body=lot)))
    return out.unionByName(orders.where(k % 2 == 1).select(*row("board", F.lit("https://b.example/"), body=board, channel=F.concat(F.lit("c"), k % 7))))


def mixed_registry(spark: SparkSession, d: str) -> DataFrame:
    """All enabled sources of a registry built from one table of landings: rows and addresses of each, and whether they are fewer than expected."""
    specs = registry.enabled(registry.entries(REGISTRY))
    raw = registry.build_all(specs, _landed(spark, d))
    counts = raw.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("address").alias("addresses"), F.min("address").alias("first"), F.count("price_raw").alias("priced"))
    return registry.expectations(spark, specs).join(counts, "source", "left").select("source", "n", "addresses", "first", "priced", (F.coalesce("n", F.lit(0)) < F.col("min_expected")).alias("short"))


def _declaring(spark: SparkSession, d: str) -> DataFrame:
    """Pages of nested JSON-LD lists with 0 to 5 listings that declare 0 to 6; some have no body, some name a vendor."""
    k = F.col("p_partkey")
    item = lambda i: F.struct(F.lit("ListItem").alias("@type"), F.struct(F.lit("Apartment").alias("@type"), F.concat(F.lit("n"), i).alias("name"), F.struct(F.lit("Offer").alias("@type"), F.lit(1).alias("price")).alias("offers")).alias("item"))
    items = F.slice(F.transform(F.sequence(F.lit(1), F.lit(5)), item), F.lit(1), (k % 6).cast("int"))
    declared = F.struct((k % 7).alias("numberOfItems"), F.lit("ItemList").alias("@type"), items.alias("itemListElement"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("WebPage").alias("@type"), declared.alias("mainEntity"))).alias("@graph")))
    rest = F.when(k % 4 == 1, F.lit("<p>$1,200 $1,300 $1,400 2 beds #4A</p>")).when(k % 4 == 2, '<a href="https://x.entrata.com/a">x</a>').otherwise("")
    return spread(_read(spark, d, "part"), "p_partkey").select(F.concat(F.lit("https://p.example/"), k).alias("url"), F.when(k % 11 != 0, F.concat(_ld(body), rest)).alias("html"))


def declared_lists(spark: SparkSession, d: str) -> DataFrame:
    return htmlx.verdicts(_declaring(spark, d).where("html is not null")).select("url", "verdict", "note")


def declared_buildings(spark: SparkSession, d: str) -> DataFrame:
    return htmlx.building_verdicts(_declaring(spark, d)).select("url", "verdict", "prices", "vendor")


def rejected_captures(spark: SparkSession, d: str) -> DataFrame:
    """Captures of which most are left out: another type, a short body, a host of statistics, too few records, no key of a listing, a repeated address."""
    k = F.col("o_orderkey")
    records = F.transform(F.sequence(F.lit(1), F.when(k % 7 == 3, 2).otherwise(3)), lambda u: F.struct(F.concat(u, F.lit(" Oak St")).alias("street"), u.alias("rent")))
    plain = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda u: F.struct(u.alias("id"), F.lit(True).alias("rented")))
    pad = F.when(k % 7 == 1, "").otherwise(F.repeat(F.lit("x"), 200)).alias("pad")
    body = F.when(k % 7 == 4, F.to_json(F.struct(pad, plain.alias("rows")))).otherwise(F.to_json(F.struct(pad, records.alias("rows"))))
    site = F.when(k % 7 == 2, "https://stats.hotjar.example/").otherwise("https://ok.example/")
    url = F.concat(site, F.when(k % 7 == 5, k - 5).otherwise(k).cast("string"), F.lit("?q="), k)
    kind = F.when(k % 7 == 0, "text/html").otherwise("application/json")
    captures = _read(spark, d, "orders").select(url.alias("url"), F.lit("GET").alias("method"), kind.alias("content_type"), body.alias("body"), F.lit("").alias("origin"), k.alias("seq"))
    return jsonx.endpoints(captures).select("url", "n_records", "score", F.map_keys("fields").alias("fields")).withColumn("fields", F.array_join(F.array_sort("fields"), ","))


def rejected_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts of which those without an offer, a plausible rent or a place are left out."""
    k = F.col("o_orderkey")
    rent = F.when(k % 5 == 0, "").when(k % 5 == 1, "$45").otherwise(F.concat(F.lit("$"), (k % 30 * 100 + 900).cast("string")))
    title = F.concat(F.when(k % 3 == 0, "Looking for a room ").when(k % 3 == 1, "For rent ").otherwise("Hello "), rent)
    text = F.when(k % 4 == 0, "Nice flat.").when(k % 4 == 1, "At 120 West 42nd Street now.").otherwise("Near Bushwick.")
    child = F.struct(F.struct(k.cast("string").alias("id"), title.alias("title"), text.alias("selftext")).alias("data"))
    pages = _read(spark, d, "orders").select(F.lit("c").alias("channel"), F.to_json(F.struct(F.struct(F.array(child).alias("children")).alias("data"))).alias("body"))
    return jsonx.posts(pages, "board").select("source_ref", "address", "price_num", "borough_hint")


def vendor_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages that link to a vendor: another's site, the vendor's own, only its name, or a host that merely looks like one."""
    k = F.col("s_suppkey")
    link = lambda h: F.concat(F.lit('<a href="https://'), F.lit(h), F.lit('/a">x</a>'))
    html = (
        F.when(k % 6 == 0, F.concat(link("own.example"), link("12.securecafe.com"), link("x.entrata.com")))
        .when(k % 6 == 1, F.concat(link("www.rentcafe.com"), F.lit(" powered by Nestio.com")))
        .when(k % 6 == 2, F.lit("<p>built on realpage.com and Buildium.us</p>"))
        .when(k % 6 == 3, link("onesite.realpage.com"))
        .when(k % 6 == 4, link("rentcafe.com.example"))
        .otherwise(link("myresman.com"))
    )
    pages = _read(spark, d, "supplier").select(k.alias("k"), F.when(k % 6 == 1, "rentcafe.com").otherwise("own.example").alias("own"), html.alias("html"))
    return pages.select("k", htmlx.vendor("html", F.col("own")).alias("v")).select("k", "v.vendor", "v.link")


def accented_streets(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with marks, ligatures, full-width and circled characters, and other scripts."""
    k = F.col("c_custkey")
    forms = F.array(*map(F.lit, ("Rue Élysée Streеt".replace("е", "e"), "Ａｖｅ Ｎｏｒｔｈ", "ﬁfth Cañon Road", "① Ångström Blvd", "Ｄžamonja Ｓｔ", "한강 Avenue", "été Lane", "𝐌𝐚𝐢𝐧 Street")))
    street = F.concat(k, F.lit(" "), F.get(forms, (k % 8).cast("int")))
    return _read(spark, d, "customer").select("c_custkey", T.normalize_street(street).alias("street"))


def lot_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that only the register knows: the lot number and label of each; a register row without a lot number answers nothing."""
    k = F.col("s_suppkey")
    asked = _read(spark, d, "supplier").select(F.concat(k, F.lit(" Elm Street")).alias("address"), F.lit("Bronx").alias("borough_hint"))
    lot = F.when(k % 5 == 0, "x").otherwise((k % 900).cast("string"))
    known = _read(spark, d, "supplier").where(k % 3 != 0).select(F.lit("2").alias("boroid"), k.cast("string").alias("lowhousenumber"), F.lit("ELM STREET").alias("streetname"), F.concat(F.lit("1"), k).alias("bin"), (k % 7000).cast("string").alias("block"), lot.alias("lot"), k.cast("string").alias("housenumber"))
    nothing = spark.createDataFrame([], "query string, bbl string, bin string, label string, borough string, lat double, lon double, confidence double, provider string")
    return geo.lookup(asked, nothing, nothing, known).select("query", "outcome", "bbl", "bin", "label")


ROBOTS = (
    "User-agent: *\nDisallow: /private", "User-agent: bot # ours\nDisallow: /\nAllow: /x\n\nUser-agent: *\nDisallow:",
    "User-agent: other\nUser-agent: third\nDisallow: /\n\nUser-agent: *\nCrawl-delay: 2\nAllow: /private/ok\nDisallow: /private\n\nDisallow: /y",
)


def robots_checks(spark: SparkSession, d: str) -> DataFrame:
    """Pages of sites with and without a robots file, asked for by one agent."""
    k = F.col("s_suppkey")
    site = F.concat(F.lit("s"), k)
    sites = _read(spark, d, "supplier")
    files = sites.select(site.alias("site"), F.get(F.array(*map(F.lit, ROBOTS)), (k % 4 - 1).cast("int")).alias("body"))
    pages = F.explode(F.array(*map(F.lit, ("/private/ok/1", "/private/2?z=1", "/y", "")))).alias("page")
    asked = sites.select(site.alias("site"), F.lit("Bot/1.0").alias("agent"), pages).withColumn("url", F.concat(F.lit("https://"), "site", F.lit(".example"), "page"))
    return htmlx.robots_verdicts(asked, files).select("site", "page", "verdict")


_NODES = "p_partkey % 6 * 2"
EXPECTED: dict[str, str] = {
    "mixed_registry": """select * from (
        select 'markup' as source, count(*) as n, count(*) as addresses, min(concat(p_partkey, ' Elm St')) as first, cast(0 as bigint) as priced, count(*) < 5 as short from part
        union all select 'api', 3 * count(*), count(*), min(concat(o_orderkey, ' Oak St')), 3 * count(*), count(*) < 1 from orders where o_orderkey % 2 = 0
        union all select 'lots', count(*), count(*), min(s_name), 0, true from supplier where s_suppkey % 2 = 0
        union all select 'board', count(*), 1, 'astoria', 0, count(*) < 1 from orders where o_orderkey % 2 = 1)""",
    "declared_lists": f"""with t as (select p_partkey as k, {_NODES} // 2 as n, p_partkey % 7 as m from part where p_partkey % 11 <> 0)
        select concat('https://p.example/', k) as url, case when n >= 3 then 'JSONLD' when k % 4 = 2 then 'PMS' else 'SPA' end as verdict,
            case when n >= 3 then concat(n, ' listing nodes', case when m > n then concat(' of ', m, ' declared (rest client-side)') else '' end) when k % 4 = 2 then 'Entrata @ https://x.entrata.com/a' else '0KB shell' end as note from t""",
    "declared_buildings": """select concat('https://p.example/', p_partkey) as url, case when p_partkey % 11 = 0 then 'ERR' when p_partkey % 6 >= 3 then 'JSONLD' when p_partkey % 4 = 1 then 'INLINE' when p_partkey % 4 = 2 then 'VENDOR' else 'SPA' end as verdict,
        cast(case when p_partkey % 11 = 0 then null when p_partkey % 4 = 1 then 3 else 0 end as int) as prices, case when p_partkey % 11 <> 0 and p_partkey % 4 = 2 then 'Entrata' else '' end as vendor from part""",
    "rejected_captures": """with t as (select o_orderkey as k, case when o_orderkey % 7 = 5 then o_orderkey - 5 else o_orderkey end as page from orders where o_orderkey % 7 in (5, 6))
        select concat('https://ok.example/', page, '?q=', k) as url, 3 as n_records, 8 as score, 'address,price' as fields from t""",
    "rejected_posts": """select cast(o_orderkey as varchar) as source_ref, case when o_orderkey % 4 = 1 then '120 West 42nd Street' else 'bushwick' end as address, cast(o_orderkey % 30 * 100 + 900 as double) as price_num,
        case when o_orderkey % 4 > 1 then 'bushwick' end as borough_hint from orders where o_orderkey % 3 = 1 and o_orderkey % 5 > 1 and o_orderkey % 4 > 0""",
    "vendor_links": """select s_suppkey as k, case s_suppkey % 6 when 0 then 'Yardi RentCafe' when 1 then 'Nestio (ref only)' when 2 then 'Buildium (ref only)' when 3 then 'RealPage' when 4 then 'Yardi RentCafe (ref only)' else 'ResMan' end as vendor,
        case s_suppkey % 6 when 0 then 'https://12.securecafe.com/a' when 3 then 'https://onesite.realpage.com/a' when 5 then 'https://myresman.com/a' else '' end as link from supplier""",
    "accented_streets": """select c_custkey, concat(c_custkey, ' ', case c_custkey % 8 when 0 then 'rue elysee st' when 1 then 'ave n' when 2 then 'fifth canon rd' when 3 then '1 angstrom blvd'
        when 4 then 'dzamonja st' when 5 then 'HANGUL ave' when 6 then 'ete ln' else 'main st' end) as street from customer""".replace("HANGUL", "한강"),
    "robots_checks": """select concat('s', s_suppkey) as site, page, case s_suppkey % 4 when 0 then 'none' when 2 then 'DISALLOW'
        when 1 then case when starts_with(page, '/private') then 'DISALLOW' else 'allow' end else case when page = '/private/2?z=1' then 'DISALLOW' else 'allow' end end as verdict
        from supplier, (values ('/private/ok/1'), ('/private/2?z=1'), ('/y'), ('')) as p(page)""",
    "lot_numbers": """with t as (select *, s_suppkey % 3 <> 0 and s_suppkey % 5 <> 0 as known from supplier)
        select concat(s_suppkey, ' elm st Bronx') as query, case when known then 'fallback' else 'empty' end as outcome,
        case when known then concat('2', lpad(cast(s_suppkey % 7000 as varchar), 5, '0'), lpad(cast(s_suppkey % 900 as varchar), 4, '0')) end as bbl,
        case when known then concat('1', s_suppkey) end as bin, case when known then concat(s_suppkey, ' ELM STREET, BRONX') end as label from t""",
}

QUERIES = {f.__name__: f for f in (mixed_registry, declared_lists, declared_buildings, rejected_captures, rejected_posts, vendor_links, accented_streets, lot_numbers, robots_checks)}
