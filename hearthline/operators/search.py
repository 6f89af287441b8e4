"""Inventory queries, saved searches and their messages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.cluster import cut
from hearthline.functions import text as T

SEARCHES = 10_000
#: Price cells and bedroom cells of the index of searches, and its most entries in one broadcast.
CUTS, BEDS, UNKNOWN = 32, 8, -1
ENTRIES = 4_000_000
#: Matches of one message; searches that are broadcast for their counts.
PAGE, SMALL = 500, 100_000
#: Pages of a span of a search's order, at least, and matches that spans are told by.
SPAN, SAMPLE = 32, 20_000
RANKS = {"low": 0, "medium": 1, "high": 2}


def active(state: DataFrame, limit: int = 100, max_price: int | None = None, min_beds: float | None = None, borough: str | None = None) -> DataFrame:
    """Listings on the market, newest first; a bound leaves out rows without the value. Ties by fingerprint."""
    out = state.where("gone_at is null")
    if max_price is not None:
        out = out.where(F.col("price") <= max_price)
    if min_beds is not None:
        out = out.where(F.col("beds") >= min_beds)
    if borough:
        out = out.where(F.col("borough") == borough)
    return out.orderBy(F.desc("first_seen"), "fingerprint").limit(limit)


def new_since(state: DataFrame, since: Column) -> DataFrame:
    return state.where(F.col("gone_at").isNull() & (F.col("first_seen") > since))


def look_back(now: Column, hours: float) -> Column:
    """The start of a window of so many hours before now."""
    return F.timestamp_micros(F.unix_micros(now) - F.lit(round(hours * 3_600_000_000)))


def summary(state: DataFrame, events: DataFrame) -> DataFrame:
    shape = state.agg(
        F.count("*").alias("listings_total"), F.count_if(F.col("gone_at").isNull()).alias("listings_active"), F.count("bbl").alias("with_bbl"), F.count_if(F.col("unit_key") != "").alias("with_unit"),
        F.count_if(F.col("confidence") == "high").alias("high_confidence"), F.count_distinct("bbl").alias("distinct_buildings"),
    )
    return shape.join(F.broadcast(events.agg(F.count("*").alias("events"))))


def _rank(c: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))
    return F.coalesce(F.try_element_at(ranks, c), F.lit(0))


def _verdicts(rows: DataFrame) -> DataFrame:
    """The listings `l` of rows with the search `c` beside them judged: `search`, `reject` and `reasons`."""
    l, c = (lambda name: F.col(f"l.{name}")), (lambda name: F.col(f"c.{name}"))  # noqa: E731, E741
    floor = F.coalesce(c("min_confidence"), F.lit("medium"))
    asked = lambda name: c(name).isNotNull()
    places = F.coalesce(F.size(c("boroughs")), F.lit(0)) > 0
    reject = F.coalesce(
        F.when(_rank(F.coalesce(l("confidence"), F.lit(""))) < _rank(floor), "below confidence floor"),
        F.when(asked("max_price") & l("price").isNull(), "no price published"),
        F.when(asked("max_price") & (l("price") > c("max_price")), F.concat(F.lit("price "), l("price").cast("string"), F.lit(" > "), c("max_price").cast("string"))),
        F.when(asked("min_beds") & (l("beds").isNull() | (l("beds") < c("min_beds"))), "too few bedrooms"),
        F.when(asked("max_beds") & (l("beds") > c("max_beds")), "more bedrooms than requested"),
        F.when(places & ~F.coalesce(F.array_contains(c("boroughs"), l("borough")), F.lit(False)), F.concat(F.lit("borough "), F.coalesce(l("borough"), F.lit("None")))),
        F.when(F.coalesce(c("require_no_fee"), F.lit(False)) & ~F.coalesce(l("no_fee"), F.lit(False)), "not confirmed no-fee"),
        F.when(asked("min_sqft") & (l("sqft").isNull() | (l("sqft") < c("min_sqft"))), "under minimum square footage"),
    )
    within = F.when(asked("max_price"), F.concat(F.lit("$"), F.format_number(l("price"), 0), F.lit("/mo within budget")))
    reasons = F.array_compact(F.array(within, F.when(l("beds").isNotNull(), F.concat(T.short_number(l("beds")), F.lit(" bed"))), F.when(places, l("borough"))))
    return rows.select("l.*", c("name").alias("search"), reject.alias("reject"), F.when(reject.isNull(), reasons).alias("reasons"))


def _in_blocks(f: Callable[[DataFrame, DataFrame], DataFrame], listings: DataFrame, criteria: DataFrame, blocks: int) -> DataFrame:
    """f of the listings and of each block of the searches, by hash of the search."""
    if blocks <= 1:
        return f(listings, criteria)
    return reduce(DataFrame.unionByName, [f(listings, criteria.where(F.pmod(F.xxhash64(*criteria.columns), F.lit(blocks)) == b)) for b in range(blocks)])


def judge(listings: DataFrame, criteria: DataFrame) -> DataFrame:
    """Every listing against every saved search: `reject` (the first reason, else null) and `reasons`.

    criteria has the columns of schemas.CRITERIA; it is a stated set of queries, sent
    around in blocks of at most SEARCHES by hash of the search. Unset bounds are null.
    zip_codes is carried and not evaluated. To find the matches alone, use matching().
    """
    n = criteria.count()

    def block(listings: DataFrame, criteria: DataFrame) -> DataFrame:
        return _verdicts(listings.select(F.struct("*").alias("l")).join(F.broadcast(criteria.select(F.struct("*").alias("c")))))

    return _in_blocks(block, listings, criteria, -(-n * 2 // SEARCHES) if n > SEARCHES else 1)


def _beds_cell(beds: Column) -> Column:
    """Whole bedrooms between 0 and BEDS; null without a number."""
    return F.when(F.isnan(beds), BEDS).when(beds.isNotNull(), F.least(F.lit(BEDS), F.greatest(F.lit(0), F.floor(beds)))).cast("int")


def _price_cell(price: Column, cuts: list[int]) -> Column:
    """How many cuts lie below the price: a search's own cell and those before it hold all prices up to its bound."""
    return sum(((price > x).cast("int") for x in cuts), F.lit(0))


def covered(criteria: DataFrame, cuts: list[int]) -> DataFrame:
    """id, borough, price and beds: the cells in which a listing may match the search, for criteria with an id.

    `*` is the borough cell of searches that name none, UNKNOWN the price or beds cell
    of listings that don't give them, which only searches without that (lower) bound take.
    """
    place = F.when(F.coalesce(F.size("boroughs"), F.lit(0)) > 0, F.transform(F.array_distinct(F.array_compact("boroughs")), lambda b: F.concat(F.lit("="), b))).otherwise(F.array(F.lit("*")))
    unknown = F.array(F.lit(UNKNOWN))
    price = F.when(F.col("max_price").isNull(), F.concat(unknown, F.sequence(F.lit(0), F.lit(len(cuts))))).otherwise(F.sequence(F.lit(0), _price_cell(F.col("max_price"), cuts)))
    low, high = F.coalesce(_beds_cell(F.col("min_beds")), F.lit(0)), F.coalesce(_beds_cell(F.col("max_beds")), F.lit(BEDS))
    beds = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    beds = F.when(F.col("min_beds").isNull(), F.concat(unknown, beds)).otherwise(beds)
    return criteria.select("id", F.explode(place).alias("borough"), price.alias("price"), beds.alias("beds")).withColumn("price", F.explode("price")).withColumn("beds", F.explode("beds"))


def candidates(listings: DataFrame, criteria: DataFrame, cuts: list[int]) -> DataFrame:
    """`l` and `c`: the listings beside the searches (with an id) whose cells hold them.

    A listing meets its two cells (its borough's, and that of searches without one) by
    equality with a broadcast index from cell to searches, of at most ENTRIES entries.
    """
    index = covered(criteria, cuts).groupBy("borough", "price", "beds").agg(F.collect_list("id").alias("ids"))
    place = F.array_compact(F.array(F.lit("*"), F.concat(F.lit("="), "l.borough")))
    unknown = F.lit(UNKNOWN)
    rows = listings.select(F.struct("*").alias("l")).select("l", F.explode(place).alias("borough"), F.coalesce(_price_cell(F.col("l.price"), cuts), unknown).alias("price"), F.coalesce(_beds_cell(F.col("l.beds")), unknown).alias("beds"))
    met = rows.join(F.broadcast(index), ["borough", "price", "beds"]).select("l", F.explode("ids").alias("id"))
    return met.join(F.broadcast(criteria.select("id", F.struct("*").alias("c"))), "id").select("l", "c")


def matching(listings: DataFrame, criteria: DataFrame) -> DataFrame:
    """The listings that match a saved search, with `search` and `reasons`: what judge() doesn't reject.

    Searches are indexed by cells of borough, price and bedrooms, so a listing is judged
    for the searches of its cells alone; what the cells leave open is decided as judge() does.
    """
    held = cut(criteria.withColumn("id", F.monotonically_increasing_id()))  # the queries: their numbers must stay
    shares = [k / CUTS for k in range(1, CUTS + 1)]
    n, bounds = held.agg(F.count("*"), F.percentile_approx("max_price", shares)).first()
    cuts = sorted(set(bounds or []))
    entries = covered(held, cuts).count()
    blocks = max(-(-n * 2 // SEARCHES) if n > SEARCHES else 1, -(-entries * 2 // ENTRIES) if entries > ENTRIES else 1)
    return _in_blocks(lambda x, c: _verdicts(candidates(x, c, cuts)), listings, held, blocks).where("reject is null").drop("reject")


def shared(criteria: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The searches told apart by what they ask alone, and who asks it: criteria of which `name` is a key, and (search, name) for each name.

    Names that ask the same (a name in several rows: the same rows) share one key, so their
    matches are found once; named() gives what was made of them to every name.
    """
    asked = F.to_json(F.struct(*[c for c in criteria.columns if c != "name"]))
    key = F.sha2(F.array_join(F.array_sort(F.collect_list(asked)), "\n"), 256)
    members = cut(criteria.groupBy("name").agg(key.alias("search")))
    first = members.groupBy("search").agg(F.min("name").alias("first"))
    wanted = criteria.join(first, F.col("name").eqNullSafe(F.col("first"))).withColumn("name", F.col("search"))
    return wanted.select(criteria.columns), members


def named(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of a search of shared() once for each of its names."""
    return rows.join(members, "search").select(*[F.col("name").alias("search") if c == "search" else F.col(c) for c in rows.columns])


def message(reasons: str = "reasons") -> Column:
    """A match in four lines."""
    price = F.when(F.coalesce("price", F.lit(0)) != 0, F.concat(F.lit("$"), F.format_number("price", 0), F.lit("/mo"))).otherwise("price on request")
    unit = F.when(F.coalesce("unit_key", F.lit("")) != "", F.concat(F.lit(" #"), F.col("unit_key"))).otherwise("")
    area = F.when(F.coalesce("sqft", F.lit(0)) != 0, F.concat(F.lit(" · "), F.col("sqft").cast("string"), F.lit(" sqft"))).otherwise("")
    fee = F.when(F.coalesce("no_fee", F.lit(False)), " · no fee").otherwise("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(price, F.lit(" — "), text("address"), unit, F.lit("\n  "), F.concat_ws(", ", reasons), area, fee, F.lit("\n  first seen "), text("first_seen"), F.lit(" via "), text("source"), F.lit("\n  "), F.coalesce(T.first_filled("detail_url", "source_url"), F.lit("")))


def digests(matches: DataFrame, page: int = PAGE) -> DataFrame:
    """Messages of the saved searches that have matches: search, page, pages, n, subject, body; see bodies()."""
    return subjects(bodies(matches, page))


def bodies(matches: DataFrame, page: int = PAGE) -> DataFrame:
    """What the messages of the saved searches that have matches hold: search, page, pages, n, body.

    A message holds at most `page` matches, oldest first; a search with more gets several,
    numbered in the subject. Lines move once, to the span of the order that they stand in;
    what spans hold of each search is counted before, so a page within one is made there,
    and only those over a span's edge are put together after. No task gathers all of a
    search with many pages. matches is read four times and not stored.
    """
    rows = matches.select("search", "first_seen", "fingerprint", message().alias("line"))
    sizes = cut(rows.groupBy("search").agg(F.count("*").alias("n")))  # as many as searches
    few, most, all_ = sizes.agg(F.count("*") <= SMALL, F.max("n"), F.sum("n")).first()
    spans = min(CUTS, -(-(most or 0) // (SPAN * page)))
    key = F.struct("first_seen", "fingerprint")
    some = [] if spans < 2 else rows.where(F.pmod(F.xxhash64("first_seen", "fingerprint"), F.lit(-(-all_ // SAMPLE))) == 0).select(key.alias("key")).orderBy("key").collect()
    kinds = [rows.schema[c].dataType for c in ("first_seen", "fingerprint")]
    edge = lambda x: F.struct(*[F.lit(v).cast(kind) for v, kind in zip(x["key"], kinds, strict=True)])
    edges = [edge(some[k * len(some) // spans]) for k in range(1, spans)] if some else []
    stride = F.greatest(F.lit(1), F.floor(F.lit(spans * SPAN * page) / F.col("n")))  # a search of fewer matches has wider spans
    dealt = rows.join(F.broadcast(sizes) if few else sizes, "search")
    dealt = dealt.withColumn("span", F.floor(sum(((key >= x).cast("int") for x in edges), F.lit(0)) / stride).cast("int"))
    counts = cut(dealt.groupBy("search", "span").agg(F.count("*").alias("here")))
    upto = Window.partitionBy("search").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # of at most CUTS spans
    counts = cut(counts.withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0))))
    at = ["search", "span"]
    inside = F.row_number().over(Window.partitionBy(*at).orderBy("first_seen", "fingerprint", "line"))
    placed = dealt.repartition(*at).join(counts.hint("shuffle_hash"), at).withColumn("place", F.col("before") + inside)
    placed = placed.withColumn("page", (F.floor((F.col("place") - 1) / page) + 1).cast("int"))
    pieces = placed.groupBy(*at, "n", "before", "here", "page").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    whole = ((F.col("page") - 1) * page >= F.col("before")) & (F.least(F.col("page") * page, F.col("n")) <= F.col("before") + F.col("here"))
    text = lambda lines: F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("body")
    over = pieces.where(~whole).groupBy("search", "n", "page").agg(F.sort_array(F.flatten(F.collect_list("lines"))).alias("lines"))
    out = reduce(DataFrame.unionByName, [x.select("search", "n", "page", text("lines")) for x in (pieces.where(whole), over)])
    return out.withColumn("pages", F.ceil(F.col("n") / page).cast("int")).select("search", "page", "pages", "n", "body")


def subjects(pages: DataFrame) -> DataFrame:
    """Pages of bodies() with their subject."""
    subject = F.concat(F.col("n").cast("string"), F.when(F.col("n") > 1, " new matches for ").otherwise(" new match for "), F.col("search"))
    subject = F.concat(subject, F.when(F.col("pages") > 1, F.concat(F.lit(" ("), "page", F.lit("/"), "pages", F.lit(")"))).otherwise(""))
    return pages.select("search", "page", "pages", "n", subject.alias("subject"), "body")


def deliver(messages: DataFrame, sink: Callable[[str, str], None]) -> int:
    """Hand each message (as many as saved searches) to the sink, one at a time; returns how many."""
    sent = 0
    for row in messages.select("subject", "body").toLocalIterator():
        sink(row.subject, row.body)
        sent += 1
    return sent
