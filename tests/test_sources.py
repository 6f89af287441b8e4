import json
import random
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from hearthline.sources import htmlx, jsonx, registry
from tests import json_plain



def payload_a():
    return json.dumps({"d": {"__count": 3, "results": [{"ApartmentName": f"{n}B", "PropertyAddress": "10 Main Street", "MinimumRent": 3000 + n, "Beds": n, "Baths": 1, "SQFT": 700, "AvailableDate": "2026-09-01", "PropertyUrl": f"https://x/{n}"} for n in range(3)]}})


def payload_b():
    return json.dumps({"response": {"result": {"units": [{"unitNumber": f"07-{c}", "unitSpk": "zz", "is_rental": True, "address": {"line1": "5 Elm St", "city": "X"}, "marketRent": "4,100", "bedrooms": "1"} for c in "ABC"]}}})


def decoy():
    return json.dumps({"nav": [{"label": "a"}, {"label": "b"}], "amenities": ["x"] * 5, "listings": [{"streetAddress": f"{i} Oak Ave", "rent": 2500, "unit": str(i), "bedrooms": 1} for i in range(6)]})


def test_records_and_field_maps(spark):
    df = spark.createDataFrame([("a?x=1", "GET", payload_a()), ("b", "GET", payload_b()), ("c", "GET", decoy()), ("d", "GET", "[]"), ("e", "GET", "nonsense")], "url string, method string, body string")
    got = {r.url: r for r in jsonx.field_maps(df).collect()}
    assert set(got) == {"a?x=1", "b", "c"}
    assert got["a?x=1"].fields == {"address": "PropertyAddress", "price": "MinimumRent", "unit_raw": "ApartmentName", "beds": "Beds", "baths": "Baths", "sqft": "SQFT", "available_on": "AvailableDate", "detail_url": "PropertyUrl"}
    assert got["b"].fields["address"] == "address.line1" and got["b"].fields["price"] == "marketRent" and got["b"].fields["unit_raw"] == "unitNumber"
    assert got["c"].n_records == 6 and got["c"].score == 13 and got["a?x=1"].score == 13


def test_json_api(spark):
    df = spark.createDataFrame([("u", payload_b())], "url string, body string")
    rows = jsonx.json_api(df, "s", {"address": "address.line1", "unit_raw": "unitNumber", "price": "marketRent", "beds": "bedrooms"}).orderBy("unit_raw").collect()
    assert [(r.address, r.unit_raw, r.price_raw, r.beds_raw) for r in rows] == [("5 Elm St", f"07-{c}", "4,100", "1") for c in "ABC"]
    rows = jsonx.json_api(spark.createDataFrame([("u", payload_a())], "url string, body string"), "s", {"address": "PropertyAddress", "price": "MinimumRent"}, root="d.results").collect()
    assert [r.price_num for r in rows] == [3000.0, 3001.0, 3002.0]


def test_paths():
    assert jsonx.path_of("data.items.0.price") == "$['data']['items'][0]['price']"


def test_records_at_a_root(spark):
    text = json.dumps({"a": {"b": [{"r": [{"c": 5}, 3, {"c": "[]"}]}], "s": "[{}]"}})
    for root, want in (("a.b.0.r", [{"c": 5}, {"c": "[]"}]), ("a.s", []), ("a.b", [{"r": [{"c": 5}, 3, {"c": "[]"}]}]), ("a.x.0", []), ("a.b.9", []), ("a", [])):
        (x,) = spark.createDataFrame([(text,)], "t string").select(jsonx.records("t", root).alias("r")).collect()
        assert [json.loads(n) for n in x.r] == want, root


def test_endpoints(spark):
    rows = [("https://shop.example/api?p=1", "GET", "application/json", payload_a(), "o", 1), ("https://shop.example/api?p=2", "GET", "application/json", payload_a(), "o", 2), ("https://www.google.com/x", "GET", "application/json", payload_a(), "o", 3), ("https://shop.example/t", "GET", "text/html", payload_a(), "o", 4)]
    df = spark.createDataFrame(rows, "url string, method string, content_type string, body string, origin string, seq int")
    out = jsonx.endpoints(df).collect()
    assert [r.url for r in out] == ["https://shop.example/api?p=1"]
    spec = json.loads(jsonx.endpoints(df).select(jsonx.source_spec(df, F.lit("id1")).alias("s")).first().s)
    assert spec["type"] == "jsonapi" and spec["operator"] == "id1" and spec["fields"]["price"] == "MinimumRent"


CARD = """<article class="card"><a href="/apartmentlistings/{ref}.html" class="card__title">{beds} at 70 Pine Street</a><p class="card__adress">70 Pine Street (Financial District, MN)</p>
<div class="card__price">${price}/month net effective rent</div><div class="card__info">Posted &lt; 11 hours Acme Rentals</div><div class="card__labels">No Fee</div>
<div class="card__facilities"><ul><li>1 bed</li><li>1.5 bath</li><li>Gym</li></ul></div></article>"""


def test_cards(spark):
    html = CARD.format(ref="a" * 20, beds="1-Bedroom", price="5,608") + CARD.format(ref="b" * 20, beds="Studio", price="5,727") + '<article class="card"><p>nothing</p></article>'
    df = spark.createDataFrame([("p1", html.replace("&lt;", "<"), 1), ("p2", CARD.format(ref="a" * 20, beds="x", price="1"), 2)], "url string, html string, seq int")
    rows = {r.source_ref: r for r in htmlx.cards(df, "cards", F.lit("2026-08-31 12:00:00").cast("timestamp"), "https://x.example").collect()}
    assert set(rows) == {"a" * 20, "b" * 20}
    r = rows["a" * 20]
    assert (r.address, r.price_raw, r.baths_raw, r.borough_hint, r.no_fee, r.listed_at) == ("70 Pine Street", "5,608", "1.5", "Manhattan", True, "2026-08-31 01:00:00")
    assert r.extra["manager"] == "Acme Rentals" and json.loads(r.extra["amenities"]) == ["Gym"] and r.detail_url.endswith(".html")


def test_details_and_links(spark):
    html = "<h1>200 Water Street, #708</h1><p>Studio, 1 Bath, $4,795</p><p>New York 10038. 2 months free</p>"
    df = spark.createDataFrame([("https://x.example/units/708-a?q=1", html), ("https://x.example/about", "<h1>Our story</h1>")], "url string, html string")
    (r,) = htmlx.details(df, "idx").collect()
    assert (r.address, r.unit_raw, r.price_raw, r.beds_raw, r.baths_raw, r.borough_hint, r.source_ref, r.extra["months_free"]) == ("200 Water Street", "708", "4,795", "Studio", "1", "Manhattan", "708-a", "2")
    index = spark.createDataFrame([("https://x.example/i", '<a href="/u/2?x">b</a><a href="/u/1">a</a><a href="/u/2#y">', 1)], "url string, html string, seq int")
    assert [r.link for r in htmlx.detail_links(index, r'/u/\d+').collect()] == ["https://x.example/u/2", "https://x.example/u/1"]


def test_markup(spark):
    node = {"@graph": [{"@type": "Apartment", "name": "12B", "address": {"streetAddress": "1 A St", "addressLocality": "Chelsea"}, "offers": [{"price": 4200}], "floorSize": {"value": 700}}, {"@type": ["Offer", "Thing"], "name": "x", "description": "Apartment for rent at 42-20 24th Street, Long Island City, NY.", "price": "3100"}, {"@type": "Apartment", "name": "12B", "address": "1 A St"}, {"@type": "WebPage", "name": "no"}], "numberOfItems": 9}
    html = f'<script type="application/ld+json">{json.dumps(node)[:-1]},}}</script><script type="application/ld+json">broken</script>'
    df = spark.createDataFrame([("u", html)], "url string, html string")
    rows = {r.title: r for r in htmlx.markup(df, "ld").collect()}
    assert set(rows) == {"12B", "x"}
    assert (rows["12B"].address, rows["12B"].price_raw, rows["12B"].sqft_raw, rows["12B"].borough_hint) == ("1 A St", "4200", "700", "Chelsea")
    assert (rows["x"].address, rows["x"].price_raw, rows["x"].borough_hint) == ("42-20 24th Street", "3100", "Long Island City")
    (c,) = htmlx._shape(df).collect()
    assert (c.nodes, c.declared) == (2, 9)
    assert [r.verdict for r in htmlx.verdicts(df).collect()] == ["SPA"]


def test_links_and_verdicts(spark):
    html = '<a href="/availability">Availability</a><a href="/team/apartments">x</a><a href="https://acme.rentcafe.com/a/b">Apply</a><a href="/buildings/10-main-st">10 East 21st Street</a><a href="mailto:x">m</a>' + "x" * 50000
    df = spark.createDataFrame([("https://www.acme.example/", html), ("https://b.example/", "<p>rentcafe.com</p> $3,000 $3,100 $3,200 studio")], "url string, html string")
    assert [r.link for r in htmlx.navigation(df).orderBy("place").collect()][0] == "https://www.acme.example/availability"
    assert [r.link for r in htmlx.building_links(df).orderBy("place").collect()] == ["https://www.acme.example/buildings/10-main-st", "https://acme.rentcafe.com/a/b"]
    got = {r.url: (r.verdict, r.note) for r in htmlx.verdicts(df).collect()}
    assert got["https://www.acme.example/"][0] == "PMS" and got["https://b.example/"][1] == "Yardi RentCafe (ref only) (fingerprint only)"
    assert {r.url: r.verdict for r in htmlx.building_verdicts(df).collect()} == {"https://www.acme.example/": "VENDOR", "https://b.example/": "INLINE"}
    assert {r.link for r in htmlx.portfolio_links(df).collect()} >= {"https://www.acme.example/buildings/10-main-st"}


def test_survey(spark):
    f = spark.createDataFrame([("a", 1, 403, None), ("b", 1, None, "getaddrinfo failed"), ("c", 1, None, "timeout"), ("c", 2, 200, None), ("d", 1, None, "timeout")], "domain string, attempt int, status int, error string")
    assert {r.domain: r.verdict for r in htmlx.reachable(f).collect()} == {"a": "BLOCKED", "b": "DEAD", "c": "OK", "d": "BLOCKED"}
    ranked = spark.createDataFrame([("s", "home", "HTML", 3, True, 0), ("s", "nav1", "HTML", 3, False, 1), ("s", "nav2", "HTML", 3, False, 2), ("t", "home", "JSONLD", 0, True, 0), ("t", "nav", "JSONLD", 0, False, 1)], "site string, url string, verdict string, rank int, is_home boolean, pos int")
    assert {r.site: r.url for r in htmlx.best_pages(ranked).collect()} == {"s": "nav1", "t": "home"}


def test_robots_as_the_standard_parser_reads_them(spark):
    r = random.Random(4)
    line = lambda: r.choice([
        f"User-agent: {r.choice(['*', 'bot', 'Other', 'otherbot'])}", f"Disallow: {r.choice(['', '/', '/x', '/x/y', '/a b', '/q?', '/q?z=1', '/%7Ec', '/s*'])}", f"Allow: {r.choice(['/x', '/x/y', '/'])}",
        "", "", "# said", " Crawl-delay: 3", "Sitemap: https://s", "nonsense", "disallow : /sp # why",
    ])
    files = [(f"s{k}", "\n".join(line() for _ in range(r.randint(0, 14)))) for k in range(120)] + [("none", None), ("crlf", "User-agent: bot\r\nDisallow: /x\r\n\r\nUser-agent: *\r\nDisallow: /")]
    urls = ["https://h.example", "https://h.example/", "https://h.example/x", "https://h.example/x/y/z", "https://h.example/a%20b/c", "https://h.example/q?z=1&y=2", "https://h.example/~c/d", "https://h.example/s*t", "https://h.example/sp#f"]
    asked = [(s, a, u) for s, _ in [*files, ("missing", "")] for a in ("bot/1.0", "Otherbot", "zzz") for u in urls]
    got = htmlx.robots_verdicts(spark.createDataFrame(asked, "site string, agent string, url string"), spark.createDataFrame(files, "site string, body string")).collect()
    parsers = {}
    for s, body in files:
        if body is not None:
            parsers[s] = RobotFileParser()
            parsers[s].parse(body.splitlines())
    want = lambda x: "none" if x.site not in parsers else "allow" if parsers[x.site].can_fetch(x.agent, x.url) else "DISALLOW"
    # a parser without a last-read time refuses everything; parse() sets it
    wrong = [(x.site, x.agent, x.url, x.verdict, dict(files).get(x.site)) for x in got if x.verdict != want(x)]
    assert len(got) == len(asked) and not wrong, (len(wrong), wrong[:3])


def test_posts_and_lotteries(spark):
    body = json.dumps({"data": {"children": [{"data": {"id": "1", "title": "No fee studio for rent $2,100", "selftext": "12 Bank Street, Astoria", "author": "u", "permalink": "/r/1"}}, {"data": {"id": "2", "title": "Looking for a room", "selftext": "$900 Astoria"}}, {"data": {"id": "3", "title": "sublet", "selftext": "nice"}}]}})
    (r,) = jsonx.posts(spark.createDataFrame([("ch", body)], "channel string, body string"), "posts").collect()
    assert (r.source_ref, r.price_num, r.beds_raw, r.no_fee, r.borough_hint) == ("1", 2100.0, "studio", True, "astoria")
    rows = [{"lottery_id": "7", "lottery_name": "Elm", "development_type": "Rental", "lottery_status": "Active", "borough": "BRONX", "postcode": "10451", "latitude": "40.1", "longitude": "-73", "applied_income_ami_low": "3", "unit_distribution_studio": "4", "lottery_start_date": "2026-01-02"}, {"lottery_id": "8", "development_type": "Rental", "lottery_status": "Closed"}, {"lottery_id": "9", "development_type": "Sale", "lottery_status": "Active"}, {"lottery_id": "10", "development_type": "Rental", "lottery_status": "active ", "latitude": "Multiple", "postcode": "1", "lottery_start_date": "2026-01-01"}]
    df = spark.createDataFrame([(json.dumps(x),) for x in rows], "body string")
    got = {r.extra["lottery_id"]: r for r in jsonx.lotteries(df, "lot").collect()}
    assert set(got) == {"7", "10"}
    assert (got["7"].address, got["7"].borough_hint, json.loads(got["7"].extra["ami_bands"])) == ("Elm 10451", "Bronx", {"low": "3"}) and got["10"].address == "Lottery 10" and "lat" not in got["10"].extra


def test_registry(spark, tmp_path):
    with pytest.raises(ValueError):
        registry.build({"type": "nope", "id": "x"}, None)
    assert [s["id"] for s in registry.enabled([{"id": "a"}, {"id": "b", "enabled": False}])] == ["a"]
    (tmp_path / "s.json").write_text(json.dumps({"sources": [{"id": "a", "type": "htmlindex", "min_expected": 3}]}))
    specs = registry.read_sources(spark, str(tmp_path / "s.json"))
    assert registry.expectations(spark, specs).collect()[0].min_expected == 3
    (tmp_path / "r.csv").write_text("name,domain,tier\n# comment,x,1\nA,a.com,1\nB,,2\n")
    assert [r.name for r in registry.read_csv(spark, str(tmp_path / "r.csv")).collect()] == ["A"]
    (tmp_path / "c.json").write_text(json.dumps([{"name": "n", "max_price": 3000, "boroughs": ["Queens"]}]))
    assert registry.read_criteria(spark, str(tmp_path / "c.json")).collect()[0].boroughs == ["Queens"]
    page = spark.createDataFrame([("https://x.example/1", "<h1>1 A St, #2</h1>")], "url string, html string")
    assert registry.build(specs[0], page).collect()[0].source == "a"
    assert len(htmlx.searches("b")) == 24


def test_field_maps_after_a_shuffle(spark):
    """Payloads of unlike keys, dealt anew: each keeps its own map."""
    shapes = [
        ("address", {"address": "1 A St", "rent": 2000, "unit": "1"}, {"address": "address", "price": "rent", "unit_raw": "unit"}), ("street", {"street": "1 A St", "price": 2000}, {"address": "street", "price": "price"}), ("deep", {"a": {"b": {"line1": "x", "c": {"rent": 1}}}}, {"address": "a.b.line1"}),
        ("flag", {"rent": True, "marketRent": 3000}, {"price": "marketRent"}), ("none", {"x": 1}, None),
    ]
    rows = [(f"u{k}", "GET", json.dumps([shapes[k % 5][1]] * 3), k) for k in range(1000)]
    got = {r.url: r.fields for r in jsonx.field_maps(spark.createDataFrame(rows, "url string, method string, body string, seq long").repartition(13)).collect()}
    assert got == {f"u{k}": shapes[k % 5][2] for k in range(1000) if shapes[k % 5][2]}


def random_value(r, deep=0):
    kind = r.random()
    if deep < 5 and kind < 0.35:
        return {r.choice("zyxwvutsa") + r.choice(["", "1", " é", "."]): random_value(r, deep + 1) for _ in range(r.randint(0, 4))}
    if deep < 5 and kind < 0.6:
        return [random_value(r, deep + 1) for _ in range(r.randint(0, 5))]
    return r.choice([None, True, False, 0, 7, -1.5, "", "text", '{"looks": "like"}', "[1, {}]", 'q"\\ \n', "é漢"])


def test_walks_equal_plain_ones(spark):
    """Objects, record lists and dotted keys of random payloads, in order; broken texts and trailing commas; no Python in the plan."""
    r = random.Random(8)
    values = [random_value(r) for _ in range(150)] + [{"rows": [{"b": 1, "a": {"c": [{"d": k}]}} for k in range(9)], "other": [{"x": 1}] * 9}]
    texts = [json.dumps(v, ensure_ascii=k % 2 == 0, indent=2 if k % 3 == 0 else None) for k, v in enumerate(values)]
    texts += ['  {"a": [1, 2,], "b": {"c": {},},}  ', "{'a': 1}", "nothing", "", None, '{"a": 1} more', "[[[[[[[[{}]]]]]]]]"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    out = df.select("k", jsonx.object_nodes("t").alias("nodes"), jsonx.records("t").alias("recs"), jsonx.flat_keys(jsonx.cleaned("t")).alias("keys"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for x in out.collect():
        value = json_plain.loads(texts[x.k])
        assert [json.loads(n) for n in x.nodes or []] == json_plain.objects(value), texts[x.k]
        assert [json.loads(n) for n in x.recs] == json_plain.record_list(value), texts[x.k]
        assert [tuple(k) for k in x["keys"] or []] == (json_plain.plain_paths(value) if isinstance(value, dict) else []), texts[x.k]


def test_deep_payloads(spark):
    deep = '{"a":' * 150 + "[1,{}]" + "}" * 150
    df = spark.createDataFrame([(deep,)], "t string")
    (x,) = df.select(F.size(jsonx.object_nodes("t")).alias("n")).collect()
    assert x.n == 151


def test_plain_keys():
    value = {"a": 1, "b": {"c": None, "d": {"e": "x", "f": {"g": 1}}, "h": [1]}, "i": True}
    assert json_plain.plain_paths(value) == [("a", False), ("b.c", False), ("b.d.e", False), ("i", True)]


def test_endpoints_of_one_address(spark):
    """Of captures of one address and method the first stays, whatever the order they are dealt in."""
    body = lambda n: json.dumps({"rows": [{"address": f"{n} A St", "rent": 2000 + n, "pad": "x" * 80}] * 3})
    rows = [("https://a.example/x?q=1", "GET", "application/json", body(k), "o", k) for k in range(20)]
    for parts in (1, 7):
        (e,) = jsonx.endpoints(spark.createDataFrame(rows, "url string, method string, content_type string, body string, origin string, seq long").repartition(parts)).collect()
        assert e.seq == 0 and json.loads(e.sample)["address"] == "0 A St"


def test_registry_texts():
    assert registry.entries('[{"id": "a"}]') == [{"id": "a"}] and registry.entries('{"sources": []}') == []
    pytest.importorskip("yaml")
    assert registry.entries("sources:\n  - id: a\n    type: jsonld\n  - id: b\n    enabled: false\n") == [{"id": "a", "type": "jsonld"}, {"id": "b", "enabled": False}]


def test_pages_do_not_move(spark):
    """Verdicts come from one pass over the pages: no join, no exchange."""
    df = spark.createDataFrame([("https://x.example/", "<p>x</p>")], "url string, html string")
    for out in (htmlx.verdicts(df), htmlx.building_verdicts(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


def test_addresses_are_resolved_as_urljoin_does(spark):
    r = random.Random(1)
    piece = lambda: r.choice(["a", "b.html", "..", ".", "", "c-d", "x y", "é"])
    way = lambda: "/".join(piece() for _ in range(r.randint(0, 4)))
    bases = ["https://a.example", "http://A.example:80/", "https://a.example/x/y.html?q=1#f", *(f"https://h.example/{way()}" for _ in range(20))]
    hrefs = ["", "#top", "?q=2", "//other.example/p", "mailto:x@y", "javascript:void(0)", "HTTPS://b.example/Z", "http://b.example", "/", "/a/../b", "../..", " /sp ", "a\nb", "https:rel/x", "tel:1", "./", "x?y=/../z", "http://[bad/x", "//[::1]/x"]
    hrefs += [way() + r.choice(["", "?a=b", "#f", "?a#f"]) for _ in range(40)] + ["/" + way() for _ in range(30)]

    def want(base, href):
        try:
            return urljoin(base, href)
        except ValueError:
            return None

    rows = [(b, h) for b in bases for h in hrefs]
    out = spark.createDataFrame([*rows, (None, "x"), ("https://a.example", None)], "b string, h string").select("b", "h", htmlx.resolve_url("b", "h").alias("u"))
    assert not [x for x in out.collect() if x.u != (want(x.b, x.h) if x.b and x.h is not None else None)]
    assert "Python" not in htmlx.navigation(spark.createDataFrame([("https://a.example", "")], "url string, html string"))._jdf.queryExecution().executedPlan().toString()


def test_building_pages_move_no_body_before_the_choice(spark):
    """The last landing counts; keys and hashes alone are shuffled, bodies only once they are chosen."""
    pages = spark.createDataFrame([("https://b.example/1?x=1", "old", 1), ("https://b.example/1", "new", 2), ("https://b.example/1#a", "mid", 1), ("https://b.example/2", "two", 9), ("https://b.example/2", "two", 9), ("https://b.example/3", None, 1)], "url string, html string, seq long")
    links = spark.createDataFrame([("https://p.example", f"https://b.example/{k}", "x", k) for k in (1, 2, 3, 4)], "url string, link string, label string, place int")
    out = htmlx.building_pages(links, pages)
    assert [(x.url[-1], x.html) for x in out.orderBy("place").collect()] == [("1", "new"), ("2", "two"), ("3", None), ("4", None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("html") and "LeftSemi" in plan
    physical = out._jdf.queryExecution().sparkPlan().toString()
    below = physical.split("LeftSemi")[1]
    assert "Aggregate" not in below and "BroadcastHashJoin" in physical.split("LeftSemi")[0] + "LeftSemi"


def test_vendors_by_one_pattern(spark):
    hosts = [*htmlx.VENDORS, *("x." + h for h in htmlx.VENDORS), "rentcafe.com.example", "my" + "resman.com", "", "example.com"]
    got = {x.h: x.v for x in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", htmlx.vendor_of(F.col("h")).alias("v")).collect()}
    assert got == {h: next((n for d, n in htmlx.VENDORS.items() if h.endswith(d)), None) for h in hosts}


def test_of_equal_landings_the_least_text_counts(spark):
    """Without an order the least text of an address counts, also where the texts begin alike or are missing."""
    same = "é" * htmlx.BEGINNING
    pages = spark.createDataFrame([(f"https://b.example/{k % 3}?q={k}", (same, "", "z")[k % 3] + f"{97 - k:02}") for k in range(30)] + [("https://b.example/1", None)], "url string, html string")
    links = spark.createDataFrame([("https://p.example", f"https://b.example/{k}", "x", k) for k in range(3)], "url string, link string, label string, place int")
    for parts in (1, 7):
        got = htmlx.building_pages(links, pages.repartition(parts)).orderBy("place").collect()
        assert [x.html for x in got] == [same + "70", "69", "z68"]


def test_a_house_number_is_no_zip(spark):
    """A house number or unit of five digits isn't read as the ZIP, wherever the address stands; a ZIP of the same digits is."""
    page = "<title>%s</title><h1>%s</h1><p>2 Beds, 1 Bath, $4,100</p><i>%s</i>"
    rows = [(f"https://x.example/{k}", page % (h, h, z)) for k, (h, z) in enumerate([("10500 Water Street, #10500A", "New York 10038"), ("10500 Water Street, #10301", "NY 10038"), ("11201 Elm St", ""), ("10038 Elm St, #5", "New York 10038"), ("9 Elm St, New York 10038, #5", "")])]
    got = {r.source_url[-1]: (r.extra.get("zip"), r.borough_hint) for r in htmlx.details(spark.createDataFrame(rows, "url string, html string"), "d").collect()}
    assert got == {"0": ("10038", "Manhattan"), "1": ("10038", "Manhattan"), "2": (None, None), "3": ("10038", "Manhattan"), "4": ("10038", "Manhattan")}


def test_links_of_each_landing(spark):
    """Of an address that landed twice each landing has its own best links."""
    pages = spark.createDataFrame([("https://a.example/", k, f'<a href="/available-apartments/{k}">Available apartments</a><a href="/buildings/{k}-main-st">{k} Main Street</a>') for k in range(8)], "url string, seq long, html string")
    for links, best in ((htmlx.navigation, "available-apartments/{}"), (htmlx.building_links, "buildings/{}-main-st"), (htmlx.portfolio_links, "buildings/{}-main-st")):
        got = {r.seq: (r.url, r.link) for r in links(pages).where("place = 1").collect()}
        assert got == {k: ("https://a.example/", f"https://a.example/{best.format(k)}") for k in range(8)}


def test_nested_values_by_one_reading(spark):
    """The nested values of a text, told by their beginnings where no text in it looks like one, and by variants where one does."""
    texts = ['{"b": {"x": 1}, "a": [1], "s": "t"}', '[{"a": 1}, "x", [2], null]', '{"s": "{}", "o": {"x": []}}', '["[1", [1]]', '{"s": "\\u007b}", "o": {}}', '{"s": "\\u005B", "o": {}}', '{"a": "say \\"{\\"", "o": {}}', "{}", '{"a": 1}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", jsonx.within(F.col("t"), ~jsonx.looks_nested(F.col("t"))).alias("n"), jsonx.looks_nested(F.col("t")).alias("looks")).collect()
    for x in got:
        value = json.loads(x.t)
        assert [json.loads(n) for n in x.n] == [v for v in (value.values() if isinstance(value, dict) else value) if isinstance(v, (dict, list))], x.t
    assert [x.looks for x in got] == [False, False, True, True, True, True, True, False, False]


def test_small_tables_are_spread(spark, tmp_path):
    """Pages made of a table of one file aren't read by one task, and payloads move once, as lines."""
    from hearthline.plans import catalog, landed, mixed

    spark.sql("select cast(1 as long) p_partkey, 'n' p_name, 2.0 p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select cast(1 as long) l_orderkey, cast(1 as long) l_partkey, 1 l_linenumber, 2.0 l_quantity").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    tasks = 4 * spark.sparkContext.defaultParallelism
    for made in (catalog.page_markup, mixed.declared_lists, mixed.declared_buildings):
        assert f", {tasks})" in plan(made(spark, str(tmp_path))), made
    for made in (landed.field_maps, catalog.json_records):
        assert f", {tasks})" in plan(made(spark, str(tmp_path))) and plan(made(spark, str(tmp_path))).count("Exchange") == 1, made
