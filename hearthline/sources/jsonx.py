"""Landed JSON: every object of a payload, the record list in it, paths, and guessed field maps.

Everything is an expression. A payload is walked level by level in its own order:
maps of texts keep the order of keys, which a variant loses, and variants tell nested
values from texts that look like them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions import text as X

# Key patterns of the fields of a listing, in order of preference.
SIGNALS = {
    "address": (r"^address", r"street", r"addr", r"^line1$", r"property.*address", r"building.*(name|address)"),
    "price": (r"gross.?rent", r"market.?rent", r"^min.*rent", r"^rent$", r"rent$", r"\brent\b", r"^price$", r"price", r"amount"),
    "unit_raw": (r"^unit.?(number|name)$", r"^apartment$", r"^unit$", r"apartment.?(number|name)", r"^apt", r"^number$", r"^unit"),
    "beds": (r"bed", r"^br$", r"bedroom"),
    "baths": (r"bath", r"^ba$"),
    "sqft": (r"sq.?f", r"square.?feet", r"area", r"size"),
    "available_on": (r"avail", r"move.?in", r"ready.?date"),
    "detail_url": (r"url", r"link", r"permalink", r"href"),
}
WEIGHTS = {"address": 5, "price": 3, "unit_raw": 3, "beds": 2}
SKIP_HOSTS = (
    r"(?i)google|facebook|doubleclick|segment|hotjar|sentry|datadog|newrelic|cloudflareinsights|gtm\.|analytics|intercom|"
    r"hubspot|optimizely|cdn\.jsdelivr|unpkg|fonts\."
)
LEAST_BODY, LEAST_RECORDS = 200, 3


STRICT = {"allowSingleQuotes": "false"}
DEEPEST, LEVELS = 1000, 3
LOOKS_NESTED = r"\"(?:[{\[]|\\u00[57][bB])"


def cleaned(text: Column | str) -> Column:
    """A JSON text without white space around it, trailing commas forgiven; null if it isn't one (a repeated key makes it none)."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"^\s+|\s+$", "")
    # within brackets, as the parser stops after a first value
    valid = lambda x: F.when(F.size(F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))).try_cast("array<variant>")) == 1, x)
    return X.bound(t, lambda t: F.coalesce(valid(t), X.bound(F.regexp_replace(t, r",\s*([}\]])", "$1"), valid)))


def _is_object(text: Column) -> Column:
    return text.startswith("{")


def looks_nested(text: Column) -> Column:
    """Whether a text within a JSON text may look like an object or a list: only then must variants tell them apart."""
    return text.rlike(LOOKS_NESTED)


def _known(text: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of a text and of whether no text in it looks nested, both computed once."""
    return X.bound(F.struct(text.alias("t"), (~looks_nested(text)).alias("p")), lambda x: f(x["t"], x["p"]))


def within(text: Column, plain: Column) -> Column:
    """The texts of the objects and lists directly in one, in its order; `plain` says that no text in it looks like one, so that one reading tells."""
    none = F.array().cast("array<string>")
    nested = lambda values: F.filter(values, lambda x: x.startswith("{") | x.startswith("["))
    at_once = F.when(_is_object(text), nested(F.map_values(F.from_json(text, "map<string,string>", STRICT)))).when(text.startswith("["), nested(F.from_json(text, "array<string>", STRICT))).otherwise(none)
    told = lambda c: c["text"]
    return F.when((F.locate("{", text, 2) == 0) & (F.locate("[", text, 2) == 0), none).when(plain, at_once).otherwise(F.transform(F.filter(inside(text), lambda c: c["nested"]), told))


def inside(text: Column) -> Column:
    """The values directly in an object or list, in its order: key (a list's is its index), text, nested (an object or a list) and v (the variant).

    The text is read twice, as texts, which keep the order of the keys, and as variants, which tell a nested value from a text that looks like one.
    """
    read = lambda kind: F.from_json(text, kind, STRICT)

    def told(key: Column, own: Column, value: Column) -> Column:
        nested = value.try_cast("map<string,variant>").isNotNull() | value.try_cast("array<variant>").isNotNull()
        return F.struct(key.alias("key"), own.alias("text"), F.coalesce(nested, F.lit(False)).alias("nested"), value.alias("v"))

    pairs = F.arrays_zip(F.map_entries(read("map<string,string>")).alias("s"), F.map_values(read("map<string,variant>")).alias("v"))
    items = F.arrays_zip(read("array<string>").alias("s"), read("array<variant>").alias("v"))
    of_object = F.transform(pairs, lambda e: told(e["s"]["key"], e["s"]["value"], e["v"]))
    of_list = F.transform(items, lambda e, i: told(i.cast("string"), e["s"], e["v"]))
    return F.when(_is_object(text), of_object).when(text.startswith("["), of_list).otherwise(F.array().cast("array<struct<key:string,text:string,nested:boolean,v:variant>>"))


def nodes(text: Column) -> Column:
    """The texts of all objects and lists of a cleaned JSON text, each before those inside it.

    Level by level: every round takes the nested values of the round before, with their
    places, by which all are put in order at the end. Rounds without any are free, and
    what holds no bracket but its own isn't read.
    """
    return _known(text, _nodes)


def _nodes(text: Column, plain: Column) -> Column:
    braces = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(b), F.lit(""))) for b in "{["), F.lit(0))
    root = F.when(text.rlike(r"^[{\[]"), F.array(F.struct(F.array().cast("array<int>").alias("at"), text.alias("text")))).otherwise(F.array().cast("array<struct<at:array<int>,text:string>>"))

    def below(n: Column) -> Column:
        return F.transform(within(n["text"], plain), lambda t, i: F.struct(F.concat(n["at"], F.array(i)).alias("at"), t.alias("text")))

    def step(held: Column, _: Column) -> Column:
        more = lambda found: F.struct(F.concat(held["all"], found).alias("all"), found.alias("last"))
        return F.when(F.size(held["last"]) == 0, held).otherwise(X.bound(F.flatten(F.transform(held["last"], below)), more))

    rounds = F.when(braces > 0, F.sequence(F.lit(1), F.least(braces, F.lit(DEEPEST)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, F.struct(root.alias("all"), root.alias("last")), step, lambda held: F.transform(F.array_sort(held["all"]), lambda n: n["text"]))


def object_nodes(text: Column | str) -> Column:
    """Each object of a JSON text as JSON text; null for none."""
    return X.bound(cleaned(text), lambda t: F.filter(nodes(t), _is_object))


def nodes_of_all(blocks: Column) -> Column:
    """Each object of several JSON texts as JSON text."""
    return F.flatten(F.filter(F.transform(blocks, object_nodes), lambda found: found.isNotNull()))


def _objects_of(a_list: Column, plain: Column) -> Column:
    return F.filter(within(a_list, plain), _is_object)


def _at(text: Column, dotted: str) -> Column:
    """The object or list at a dotted path, as text."""
    for part in filter(None, dotted.split(".")):
        here = F.lit(part)
        text = F.try_element_at(F.filter(inside(text), lambda c: c["nested"] & (c["key"] == here)), F.lit(1))["text"]
    return text


def records(text: Column | str, root: str | None = None) -> Column:
    """The records of a payload: the objects of the list at a root path, or of the list that holds most of them (LEAST_RECORDS at least), the first on a tie."""
    none = F.array().cast("array<string>")
    if root:
        return F.coalesce(X.bound(_at(cleaned(text), root), lambda t: F.when(t.startswith("["), _known(t, _objects_of))), none)
    held = lambda t, plain: F.transform(F.filter(_nodes(t, plain), lambda n: n.startswith("[")), lambda n: _objects_of(n, plain))
    best = lambda lists: F.aggregate(lists, none, lambda kept, new: F.when(F.size(new) > F.size(kept), new).otherwise(kept))
    found = X.bound(cleaned(text), lambda t: _known(t, lambda t, plain: best(held(t, plain))))
    return X.bound(F.coalesce(found, none), lambda r: F.when(F.size(r) >= LEAST_RECORDS, r).otherwise(none))


def flat_keys(record: Column | str, levels: int = LEVELS) -> Column:
    """path and flag (a boolean) of the values of a record that are neither objects nor lists, with dotted paths of at most `levels` keys, in its order."""

    def plain(text: Column, before: Column, deep: int) -> Column:
        none = F.array().cast("array<struct<path:string,flag:boolean>>")

        def one(c: Column) -> Column:
            path = F.concat(before, c["key"])
            own = F.when(~c["nested"], F.array(F.struct(path.alias("path"), F.coalesce(F.schema_of_variant(c["v"]) == "BOOLEAN", F.lit(False)).alias("flag"))))
            return own.when(_is_object(c["text"]), plain(c["text"], F.concat(path, F.lit(".")), deep + 1)).otherwise(none) if deep < levels else own.otherwise(none)

        return F.flatten(F.transform(inside(text), one))

    return X.bound(F.col(record) if isinstance(record, str) else record, lambda t: F.when(_is_object(t), plain(t, F.lit(""), 1)).otherwise(F.array().cast("array<struct<path:string,flag:boolean>>")))


def path_of(dotted: str) -> str:
    """A dotted path as a variant path."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in dotted.split(".") if p)


def dig(value: Column | str, dotted: str, kind: str = "string") -> Column:
    """The plain value at a dotted path of a variant, null where there is none."""
    v = F.col(value) if isinstance(value, str) else value
    return F.try_variant_get(v, path_of(dotted), kind) if dotted else F.lit(None).cast(kind)


def field_of(keys: Column, patterns: tuple[str, ...]) -> Column:
    """The path of the first key that the first matching pattern matches, in its last part or as a whole."""
    fits = lambda p: lambda k: F.substring_index(k["path"], ".", -1).rlike(f"(?i){p}") | k["path"].rlike(f"(?i){p}")
    found = F.coalesce(*[F.try_element_at(F.filter(keys, fits(p)), F.lit(1))["path"] for p in patterns])
    # one pattern over all keys, a line each, leaves out fields that none of them has
    lines = F.array_join(F.transform(keys, lambda k: F.concat(k["path"], F.lit("\n"), F.substring_index(k["path"], ".", -1))), "\n")
    return F.when(lines.rlike(f"(?im){'|'.join(patterns)}"), found)


def field_maps(payloads: DataFrame) -> DataFrame:
    """Guessed fields of each payload: url, method, origin, n_records, fields (map), score, sample, and seq if it has one.

    payloads has url, method, body and optionally origin and seq. The first pattern
    that a key (or its last part) matches wins, and of its keys the first; booleans
    don't count. Each payload is judged in its own row.
    """
    rows = X.once(payloads, "recs", records("body")).where(F.size("recs") >= LEAST_RECORDS)
    rows = X.once(rows, "keys", F.filter(flat_keys(F.get("recs", F.lit(0))), lambda k: ~k["flag"]))
    found = [F.struct(F.lit(field).alias("field"), field_of(F.col("keys"), SIGNALS[field]).alias("path")) for field in sorted(SIGNALS)]
    rows = X.once(rows, "fields", F.map_from_entries(F.filter(F.array(*found), lambda x: x["path"].isNotNull()))).where(F.size("fields") > 0)
    score = sum((F.when(F.map_contains_key("fields", f), w).otherwise(0) for f, w in WEIGHTS.items()), F.floor(F.least(F.size("recs"), F.lit(40)) / 10))
    origin = F.col("origin") if "origin" in payloads.columns else F.lit("")
    more = ["seq"] if "seq" in payloads.columns else []
    return rows.select("url", "method", origin.alias("origin"), F.size("recs").alias("n_records"), "fields", score.cast("int").alias("score"), F.get("recs", F.lit(0)).alias("sample"), *more)


def endpoints(captures: DataFrame) -> DataFrame:
    """Endpoints that look like listings, best first: of each address (without its query) the first capture.

    captures has url, method, content_type, body, origin and seq (their order; ties by url, method and sample).
    """
    kept = captures.where(F.col("content_type").contains("json") & (F.length("body") >= LEAST_BODY) & ~F.try_parse_url("url", F.lit("HOST")).rlike(SKIP_HOSTS))
    found = field_maps(kept).where(F.map_contains_key("fields", "address") | F.map_contains_key("fields", "unit_raw"))
    first = Window.partitionBy(F.substring_index("url", "?", 1)).orderBy("seq", "url", "method", "sample")
    return found.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").orderBy(F.desc("score"), F.desc("n_records"), "seq", "url", "method")


def source_spec(candidates: DataFrame, source_id: Column, operator: Column | None = None, borough_hint: Column | None = None) -> Column:
    """A candidate as the text of a source entry, to be reviewed before use."""
    return F.to_json(F.struct(F.lit("jsonapi").alias("type"), source_id.alias("id"), F.col("url"), F.coalesce(operator if operator is not None else F.lit(None), source_id).alias("operator"), (borough_hint if borough_hint is not None else F.lit(None).cast("string")).alias("borough_hint"), F.col("fields"), F.lit(True).alias("enabled"), F.format_string("auto-discovered; %d records, score %d", "n_records", "score").alias("notes")))


def json_api(payloads: DataFrame, source: str, fields: dict[str, str], root: str | None = None, operator: str = "", borough_hint: str | None = None, no_fee: bool | None = None) -> DataFrame:
    """Raw records of landed JSON payloads (url, body) by a field map; records without an address are left out."""
    rows = X.once(payloads.select("url", F.explode(records("body", root)).alias("r")), "v", F.try_parse_json("r"))
    get = lambda f, kind="string": dig("v", fields.get(f, ""), kind)
    number = lambda f: F.when(F.schema_of_variant(dig("v", fields.get(f, ""), "variant")).rlike("BIGINT|DOUBLE|DECIMAL|INT|FLOAT"), get(f, "double")) if fields.get(f) else F.lit(None).cast("double")
    return rows.select(
        F.lit(source).alias("source"), F.col("url").alias("source_url"), get("address").alias("address"), get("unit_raw").alias("unit_raw"), get("price").alias("price_raw"), number("price").alias("price_num"),
        get("beds").alias("beds_raw"), number("beds").alias("beds_num"), get("baths").alias("baths_raw"), number("baths").alias("baths_num"), get("sqft").alias("sqft_raw"), number("sqft").alias("sqft_num"),
        get("available_on").alias("available_on"), get("listed_at").alias("listed_at"), get("title").alias("title"), get("detail_url").alias("detail_url"), F.coalesce(get("borough"), F.lit(borough_hint)).alias("borough_hint"),
        F.lit(no_fee).cast("boolean").alias("no_fee"), get("source_ref").alias("source_ref"), F.create_map(F.lit("operator"), F.lit(operator or source)).alias("extra"),
    ).where(F.coalesce("address", F.lit("")) != "")


def lotteries(rows: DataFrame, source: str, only_open: bool = True, limit: int | None = 1000) -> DataFrame:
    """Raw records of an open-data table of housing lotteries (JSON lines as strings in `body`): the newest starts up to limit, or all.

    Columns named by a prefix become maps; `Multiple` stands for several buildings.
    """
    v = F.try_parse_json("body")
    get = lambda f: F.try_variant_get(F.col("v"), f"$.{f}", "string")
    all_ = F.from_json("body", "map<string,string>")
    rows = rows.withColumn("v", v).where(get("development_type") == "Rental")
    if limit is not None:
        rows = rows.orderBy(F.desc(get("lottery_start_date")), get("lottery_id")).limit(limit)
    if only_open:
        rows = rows.where(F.lower(F.trim(get("lottery_status"))) == "active")
    several = (F.coalesce(get("latitude"), F.lit("")) == "Multiple") | (F.coalesce(get("postcode"), F.lit("")) == "Multiple")
    name = F.coalesce(F.nullif(get("lottery_name"), F.lit("")), F.concat(F.lit("Lottery "), F.coalesce(get("lottery_id"), F.lit("None"))))
    zip_ = F.when(~several, get("postcode"))
    prefixed = lambda p: F.to_json(F.transform_keys(F.map_filter(all_, lambda k, x: k.startswith(p)), lambda k, x: F.replace(k, F.lit(p), F.lit(""))))
    boroughs = {"MANHATTAN": "Manhattan", "BROOKLYN": "Brooklyn", "BRONX": "Bronx", "QUEENS": "Queens", "STATEN ISLAND": "Staten Island"}
    pairs = {"kind": F.lit("affordable_lottery"), "lottery_id": get("lottery_id"), "status": get("lottery_status"), "deadline": get("lottery_end_date"), "unit_count": get("unit_count"), "community_board": get("community_board"), "ami_bands": prefixed("applied_income_ami_"), "unit_mix": prefixed("unit_distribution_"), "lat": F.when(~several, get("latitude")), "lon": F.when(~several, get("longitude")), "multi_building": several.cast("string")}
    extra = F.map_filter(F.create_map(*(x for k, c in pairs.items() for x in (F.lit(k), c))), lambda k, x: x.isNotNull())
    return rows.select(F.lit(source).alias("source"), F.concat(F.lit("lottery:"), get("lottery_id")).alias("source_url"), F.trim(F.concat_ws(" ", name, zip_)).alias("address"), name.alias("title"), F.try_element_at(X.mapped(boroughs), F.upper(get("borough"))).alias("borough_hint"), F.lit(True).alias("no_fee"), extra.alias("extra"))


def posts(pages: DataFrame, source: str) -> DataFrame:
    """Raw records of landed pages (channel, body) of a message board: offers with a price and a place."""
    schema = "data struct<children: array<struct<data: struct<id:string,title:string,selftext:string,author:string,permalink:string>>>>"
    rows = pages.select("channel", F.explode(F.from_json("body", schema)["data"]["children"]).alias("c")).select("channel", "c.data.*")
    title, body = F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit(""))
    rows = rows.where(X.is_offer(title, body)).withColumn("f", X.post_fields(title, body)).where(F.col("f.price").isNotNull() & (F.col("f.address").isNotNull() | F.col("f.neighborhood").isNotNull()))
    fee = F.when(F.concat_ws(" ", title, body).rlike(r"(?iU)\bno[\s-]?fee\b"), True)
    extra = F.map_filter(F.create_map(F.lit("channel"), F.col("channel"), F.lit("author"), F.col("author"), F.lit("excerpt"), F.substring(body, 1, 300), F.lit("neighborhood"), F.col("f.neighborhood")), lambda k, x: x.isNotNull())
    return rows.select(F.lit(source).alias("source"), F.col("channel").alias("source_url"), F.coalesce("f.address", "f.neighborhood").alias("address"), F.col("f.price").cast("double").alias("price_num"), F.col("f.beds").alias("beds_raw"), F.substring(title, 1, 200).alias("title"), F.col("permalink").alias("detail_url"), F.col("f.neighborhood").alias("borough_hint"), fee.alias("no_fee"), F.col("id").alias("source_ref"), extra.alias("extra"))
