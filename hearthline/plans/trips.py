"""Queries that write and read again: registries and survey files, saved searches, generated source entries; and fields of listings that are capped, cast or kept as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.cluster import spread
from hearthline.operators import normalize
from hearthline.plans.catalog import _book, _duck, _view
from hearthline.plans.crawl import fresh_measurements
from hearthline.plans.histories import _work
from hearthline.plans.landed import NOW, _read, endpoints_of
from hearthline.schemas import CRITERIA
from hearthline.sources import htmlx, registry

TIERS = ("1", "2", "3")


def survey_files(spark: SparkSession, d: str) -> DataFrame:
    """Survey results written as CSV (a comment and a row without a domain among them), read again, and the crawlable ones of a tier."""
    k = F.col("s_suppkey")
    domain = F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit("d"), k, F.lit(".example")))
    verdict = F.element_at(F.array(*map(F.lit, ("JSONLD", "PMS", "DEAD", "SPA"))), (k % 4 + 1).cast("int"))
    rows = _read(spark, d, "supplier").select(domain.alias("domain"), F.concat(F.lit('the "old", '), "s_name").alias("name"), verdict.alias("verdict"), (k % 3 + 1).cast("string").alias("tier"), (k % 10 == 1).alias("comment"))
    path = f"{_work(spark)}/survey"
    registry.write_csv(rows.where("not comment"), path, ["domain", "name", "verdict", "tier"])
    rows.where("comment").select(F.concat(F.lit("#"), F.concat_ws(",", "domain", F.lit("x"), F.lit("PMS"), F.lit("2")))).write.mode("append").text(path)
    return registry.survey_rows(registry.read_csv(spark, path), ["JSONLD", "PMS"], tier="2", limit=1000).select("domain", "name", "verdict", "tier")


def search_files(spark: SparkSession, d: str) -> DataFrame:
    """Saved searches as files of JSON arrays, a hundred each, read as criteria."""
    wanted = _view(spark, d, "wishes").withColumn("g", F.expr("cast(substr(name, 2) as int) div 100"))
    path = f"{_work(spark)}/criteria"
    wanted.groupBy("g").agg(F.to_json(F.collect_list(F.struct(*[c for c in CRITERIA.names if c in wanted.columns]))).alias("value")).write.partitionBy("g").text(path)
    return registry.read_criteria(spark, path).drop("g").withColumns({"boroughs": F.array_join("boroughs", ","), "zip_codes": F.array_join("zip_codes", ",")})


def generated_entries(spark: SparkSession, d: str) -> DataFrame:
    """Source entries of found endpoints, written as lines of JSON and read again."""
    path = f"{_work(spark)}/specs"
    registry.write_specs(endpoints_of(spark, d), path)
    spec = F.from_json("value", "id string, type string, url string, enabled boolean, fields map<string,string>, notes string")
    return spark.read.text(path).select(spec.alias("s")).select("s.id", "s.type", "s.url", "s.enabled", F.array_join(F.array_sort(F.map_keys("s.fields")), ",").alias("fields"), "s.notes")


def search_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The searches of all areas and sizes of many sites."""
    return htmlx.search_pages(_read(spark, d, "supplier").select(F.concat(F.lit("https://s"), "s_suppkey", F.lit(".example")).alias("base")))


def capped_fields(spark: SparkSession, d: str) -> DataFrame:
    """Markup with long descriptions, and cards with many amenities and without a path: what is cut, and the other key."""
    k = F.col("p_partkey")
    node = F.to_json(F.struct(F.lit("Apartment").alias("@type"), F.col("p_name").alias("name"), F.struct(F.concat(k, F.lit(" Elm St")).alias("streetAddress")).alias("address"), F.repeat(F.concat(k, F.lit(".")), 150).alias("description")))
    part = spread(_read(spark, d, "part"), "p_partkey")
    pages = part.select(F.concat(F.lit("https://m.example/"), k).alias("url"), F.concat(F.lit('<script type="application/ld+json">'), node, F.lit("</script>")).alias("html"))
    told = htmlx.markup(pages, "m").select("source_url", F.col("extra")["description"].alias("kept"), F.lit(None).cast("string").alias("ref"))
    items = F.array_join(F.transform(F.sequence(F.lit(1), (k % 12 + 1).cast("int")), lambda i: F.concat(F.lit("<li>a"), i, F.lit("</li>"))), "")
    card = F.concat(F.lit('<article class="card"><a href="/x?y=1&amp;z=2&%21id=ab_'), k, F.lit('%3A7">x</a><div class="card__adress">'), k, F.lit(" Oak Street</div><ul>"), items, F.lit("</ul></article>"))
    shown = htmlx.cards(part.select(F.concat(F.lit("https://c.example/"), k).alias("url"), card.alias("html"), k.alias("seq")), "c", F.lit(NOW).cast("timestamp"), "https://c.example")
    return told.unionByName(shown.select("source_url", F.col("extra")["amenities"].alias("kept"), F.col("source_ref").alias("ref")))


def enriched_listings(spark: SparkSession, d: str) -> DataFrame:
    """Listings whose texts of coordinates may be no numbers, and whose further facts are kept as JSON with what the lookup adds."""
    k = F.col("c_custkey")
    extra = F.create_map(F.lit("lat"), F.when(k % 3 == 0, "n/a").otherwise(F.concat(F.lit("40."), k)), F.lit("lon"), F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("-73."), k)), F.lit("note"), F.concat(F.lit('say "'), k, F.lit('"')))
    raw = _read(spark, d, "customer").select(F.lit("s").alias("source"), F.concat(k, F.lit(" Elm Street")).alias("address"), F.lit("Queens").alias("borough_hint"), k.cast("string").alias("source_ref"), extra.alias("extra"))
    none = F.lit(None)
    found = _read(spark, d, "customer").where(k % 5 == 0).select(F.concat(k, F.lit(" elm st Queens")).alias("query"), F.lit(True).alias("found"), F.concat(F.lit("B"), k).alias("bbl"), none.cast("string").alias("bin"), F.concat(F.lit("L"), k).alias("label"), F.lit("Queens").alias("borough"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), F.lit(0.75).alias("confidence"))
    out = normalize.normalize(raw, found, F.lit(NOW).cast("timestamp"))
    return out.select("address_raw", "lat", "lon", F.col("extra")["note"].alias("note"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter("extra", lambda a, b: a.startswith("geocode")))))).alias("added"))


def fresh_leads(spark: SparkSession, d: str) -> DataFrame:
    """The newest measurements of a pairing, the longest lead first."""
    return fresh_measurements(_book(spark, d)[1], 20).select("upstream_fp", "lead_hours")


_W = _duck("wishes")
EXPECTED: dict[str, str] = {
    "survey_files": """select concat('d', s_suppkey, '.example') as domain, concat('the "old", ', s_name) as name, case s_suppkey % 4 when 0 then 'JSONLD' else 'PMS' end as verdict, '2' as tier
        from supplier where s_suppkey % 10 > 1 and s_suppkey % 4 < 2 and s_suppkey % 3 = 1 order by s_name limit 1000""",
    "search_files": f"select name, max_price, min_beds, max_beds, array_to_string(boroughs, ',') as boroughs, cast(null as varchar) as zip_codes, require_no_fee, min_sqft, min_confidence from {_W}",
    "search_addresses": f"select concat('https://s', s_suppkey, '.example') as base, concat('https://s', s_suppkey, '.example/', a, '/', b) as url from supplier, unnest({list(htmlx.AREAS)}) as x(a), unnest({list(htmlx.BED_SEARCHES)}) as y(b)",
    "capped_fields": """select concat('https://m.example/', p_partkey) as source_url, substr(repeat(concat(p_partkey, '.'), 150), 1, 400) as kept, cast(null as varchar) as ref from part
        union all select concat('https://c.example/', p_partkey), concat('["', array_to_string(list_transform(range(1, least(8, p_partkey % 12 + 1) + 1), lambda i: concat('a', i)), '","'), '"]'), concat('ab_', p_partkey, ':7') from part""",
    "enriched_listings": """select concat(c_custkey, ' Elm Street') as address_raw, case when c_custkey % 5 <> 0 and c_custkey % 3 <> 0 then cast(concat('40.', c_custkey) as double) end as lat,
        case when c_custkey % 5 <> 0 and c_custkey % 4 <> 0 then cast(concat('-73.', c_custkey) as double) end as lon, concat('say "', c_custkey, '"') as note,
        case when c_custkey % 5 = 0 then concat('{"geocode_confidence":"0.75","geocode_label":"L', c_custkey, '"}') else '{}' end as added from customer""",
}

QUERIES = {f.__name__: f for f in (survey_files, search_files, generated_entries, search_addresses, capped_fields, enriched_listings, fresh_leads)}
