"""Addresses, units, boroughs, bedrooms, rents and identity as column expressions.

Everything here is a Column of built-in functions, so it stays in generated code.
Patterns use (?U) where words and digits are meant in the Unicode sense.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations, places and patterns that listings are read with.
STREET_TYPES = {
    "street": "st", "str": "st", "avenue": "ave", "av": "ave", "boulevard": "blvd", "place": "pl", "road": "rd",
    "drive": "dr", "court": "ct", "terrace": "ter", "parkway": "pkwy", "plaza": "plz", "lane": "ln", "square": "sq",
    "turnpike": "tpke", "highway": "hwy", "circle": "cir", "expressway": "expy",
}
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}
BOROUGHS = ("Staten Island", "Brooklyn", "Queens", "Bronx", "Manhattan")
NEIGHBORHOODS = {
    "long island city": "Queens", "astoria": "Queens", "sunnyside": "Queens", "forest hills": "Queens", "flushing": "Queens",
    "jackson heights": "Queens", "ridgewood": "Queens", "rego park": "Queens", "elmhurst": "Queens",
    "williamsburg": "Brooklyn", "bushwick": "Brooklyn", "park slope": "Brooklyn", "bed-stuy": "Brooklyn",
    "bedford-stuyvesant": "Brooklyn", "dumbo": "Brooklyn", "greenpoint": "Brooklyn", "crown heights": "Brooklyn",
    "fort greene": "Brooklyn", "prospect heights": "Brooklyn", "bay ridge": "Brooklyn", "sunset park": "Brooklyn",
    "harlem": "Manhattan", "chelsea": "Manhattan", "soho": "Manhattan", "tribeca": "Manhattan", "upper east side": "Manhattan",
    "upper west side": "Manhattan", "east village": "Manhattan", "west village": "Manhattan", "murray hill": "Manhattan",
    "hell's kitchen": "Manhattan", "financial district": "Manhattan",
    "mott haven": "Bronx", "riverdale": "Bronx", "fordham": "Bronx", "st. george": "Staten Island",
}
ZIP_RANGES = (
    (10001, 10282, "Manhattan"), (10301, 10314, "Staten Island"), (10451, 10475, "Bronx"), (11201, 11256, "Brooklyn"),
    (11004, 11005, "Queens"), (11101, 11120, "Queens"), (11351, 11697, "Queens"),
)
BOROUGH_CODES = {"MN": "Manhattan", "BK": "Brooklyn", "BX": "Bronx", "QN": "Queens", "SI": "Staten Island"}
#: How a public register of housing writes the short forms.
LONG_FORMS = {
    "st": "STREET", "ave": "AVENUE", "av": "AVENUE", "blvd": "BOULEVARD", "pl": "PLACE", "rd": "ROAD", "dr": "DRIVE", "ct": "COURT", "ln": "LANE",
    "pkwy": "PARKWAY", "ter": "TERRACE", "plz": "PLAZA", "sq": "SQUARE", "n": "NORTH", "s": "SOUTH", "e": "EAST", "w": "WEST",
}
BOROUGH_IDS = {"Manhattan": "1", "Bronx": "2", "Brooklyn": "3", "Queens": "4", "Staten Island": "5"}
UNIT_PREFIX = r"(?iU)\b(apartment|apt|unit|suite|ste|residence|res|no|number|#)\b\.?\s*"
EXPLICIT_UNIT = r"(?iU)(?:#|\bapt\b\.?|\bunit\b|\bresidence\b)\s*([A-Za-z0-9\-]+)"
DESCRIPTOR = (
    r"(?iU)\b(\d+(\.\d)?[\s-]*)?(studio|bed\s?rooms?|bedrooms?|beds?|baths?|bathrooms?|"
    r"br|ba|bd|den|loft|convertible|duplex|penthouse|sq\.?\s?ft)\b\.?"
)
ADDRESS_PHRASE = (
    r"(?iU)\b\d{1,4}(?:-\d{1,3})?\s+(?:[NSEW]\.?\s+|(?:north|south|east|west)\s+)?(?:[A-Za-z0-9'.]+\s+){0,3}?"
    r"(?:street|st|avenue|ave|road|rd|place|pl|boulevard|blvd|drive|dr|lane|ln|court|ct|terrace|ter|"
    r"parkway|pkwy|plaza|plz|square|sq|way|broadway|concourse|circle|cir)\b\.?"
)
UNIT_TOKEN = r"(?U)\b([A-Za-z]?\d{1,4}[A-Za-z]?)\b(?=([\s\S]*))"
BEDS = r"(?iU)(\d+(?:\.\d)?)\s*[-\s]?(?:bed\s?rooms?|beds?|bd|br)\b"
STUDIO = r"(?iU)\bstudios?\b|\bstu\b|\bjr\.?\s*1\b"
HALF = r"(?iU)\bden\b|\bflex\b|\bconvertible\b"
AREA = r"(?i)([\d,]{3,6})\s*(?:sq\.?\s*ft|sf|square feet)"
HOUSE = r"(?U)^\s*(\d{1,4}(?:-\d{1,3})?)\b"
CONCESSION = r"(?i)(\d+)\s*months?\s*(?:free|op\b)"
OFFER = (
    r"(?iU)\b(for rent|available|no fee|nofee|lease break|leasebreak|sublet|subletting|renting out|open house|"
    r"showing|apartment available|room available|taking over)\b"
)
SEEKING = (
    r"(?iU)\b(looking for|in search of|\bISO\b|need(ed)? (a|an)? ?(apartment|room)|any (leads|recs)|help me find|wanted|"
    r"advice|question|is this (normal|legal)|am i being|should i|rate my|thoughts on)\b"
)
POST_PRICE = r"(?i)\$\s?([1-9][\d,]{2,6})(?:\s*(?:/|per\s*)?\s*(?:mo|month))?"
POST_BEDS = r"(?iU)\b(studio|\d+\s*(?:bed\s?rooms?|beds?|br|bd))\b"
POST_ADDRESS = (
    r"(?iU)\b(\d{1,4}(?:-\d{1,3})?\s+(?:[NSEW]\.?\s+|(?:north|south|east|west)\s+)?"
    r"(?:\d{1,3}(?:st|nd|rd|th)|[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\s+"
    r"(?:street|st|avenue|ave|road|rd|place|pl|boulevard|blvd|drive|dr|lane|ln|court|ct|terrace|parkway|pkwy)\b)"
)
POST_PLACES = (
    "astoria", "long island city", "sunnyside", "ridgewood", "bushwick", "williamsburg", "greenpoint", "bed-stuy",
    "bedford-stuyvesant", "crown heights", "prospect heights", "park slope", "sunset park", "bay ridge", "fort greene",
    "clinton hill", "flatbush", "harlem", "washington heights", "inwood", "chelsea", "east village", "west village",
    "lower east side", "upper east side", "upper west side", "hell's kitchen", "murray hill", "flushing",
    "jackson heights", "forest hills", "elmhurst", "mott haven", "dumbo",
)
BEYOND_ASCII, PARTING = r"[^\x00-\x7F]", "\x1f"
#: The composed Korean syllables, and the letters that they are made of, first, middle and last.
SYLLABLES = "\uac00", "\ud7a3"
JAMO = tuple("".join(map(chr, range(a, b))) for a, b in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3)))
RENT_BAND, AREA_BAND, MOST_BEDS, POST_RENT_BAND = (500, 100_000), (80, 20_000), 12, (500, 30_000)


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_text(c), F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*map(blank_to_null, columns))


def mapped(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


@lru_cache(1)
def _folds() -> tuple[str, str, str, str]:
    """By compatibility decomposition of every code point, without combining marks: the characters that become one other and what
    they become (those beyond its end are dropped), and the characters that become several with their texts, parted by PARTING (the first is empty); Korean syllables follow a rule."""
    source, target, dropped, several, texts = [], [], [], [], [""]
    for code in [*range(0x80, ord(SYLLABLES[0])), *range(ord(SYLLABLES[1]) + 1, 0xD800), *range(0xE000, 0x110000)]:
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if bare == c:
            continue
        if len(bare) == 1:
            source.append(c)
            target.append(bare)
        elif bare:
            several.append(c)
            texts.append(bare)
        else:
            dropped.append(c)
    return "".join(source + dropped), "".join(target), "".join(several), PARTING.join(texts)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it; keeps expressions small."""
    return F.element_at(F.transform(F.array(value), f), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: what follows doesn't repeat its expression, and no filter is moved before it."""
    return df.withColumn(name, F.explode(F.array(value)))


def strip_accents(c: Column | str) -> Column:
    """Compatibility decomposition without combining marks, for every code point.

    Plain ASCII skips all of it. What becomes one character is translated at once; only
    where other non-ASCII characters remain is the text taken apart for those that become several.
    """
    source, target, several, texts = _folds()
    held, spread = F.lit(several), F.split(F.lit(texts), PARTING)  # the latter is folded to a constant

    def syllable(x: Column) -> Column:
        at = F.ascii(x) - ord(SYLLABLES[0])
        place = lambda letters, n: F.substring(F.lit(letters), n + 1, 1)
        return F.concat(place(JAMO[0], F.floor(at / 588).cast("int")), place(JAMO[1], F.floor(at % 588 / 28).cast("int")), F.when(at % 28 > 0, place(JAMO[2], at % 28 - 1)).otherwise(""))

    def apart(s: Column) -> Column:
        chars = F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
        return F.array_join(F.transform(chars, lambda x: F.when(x < "\x80", x).when(x.between(*SYLLABLES), syllable(x)).otherwise(F.coalesce(F.nullif(F.get(spread, F.instr(held, x)), F.lit("")), x))), "")

    def fold(s: Column) -> Column:
        return F.when(~s.rlike(BEYOND_ASCII), s).otherwise(bound(F.translate(s, source, target), lambda t: F.when(~t.rlike(BEYOND_ASCII), t).otherwise(apart(t))))

    return bound(_text(c), fold)


def normalize_street(c: Column | str) -> Column:
    """Lower case, no marks or punctuation, short street types and directions; empty for null."""
    s = F.replace(F.lower(strip_accents(c)), F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(F.regexp_replace(s, "[.,]", " "), r"(?U)[^\w\s\-]", " ")
    s = F.regexp_replace(s, r"(?U)\b(\d+)(st|nd|rd|th)\b", "$1")
    words = F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")
    short = lambda w, names: F.coalesce(F.try_element_at(names, w), w)
    words = F.transform(words, lambda w: short(short(w, mapped(DIRECTIONS)), mapped(STREET_TYPES)))
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def register_street(c: Column | str) -> Column:
    """The normalised street in upper case with its short forms spelled out."""
    words = F.transform(F.split(normalize_street(c), " "), lambda w: F.coalesce(F.try_element_at(mapped(LONG_FORMS), w), w))
    return F.upper(F.array_join(words, " "))


def normalize_unit(c: Column | str) -> Column:
    """Comparable key of a unit; empty, never null, when there is none."""
    s = F.regexp_replace(F.upper(strip_accents(c)), UNIT_PREFIX, "")
    return F.coalesce(F.regexp_replace(F.regexp_replace(s, "[^A-Z0-9]", ""), r"^0+(?=\d)", ""), F.lit(""))


def house_number(c: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(_text(c), HOUSE, 1), F.lit(""))


def street_part(c: Column | str) -> Column:
    """What follows the house number, or everything without one."""
    return F.coalesce(F.regexp_replace(_text(c), r"(?U)^\s*(\d[\w-]*)\s+", ""), F.lit(""))


def unit_from_title(title: Column | str, address: Column | str) -> Column:
    """A unit named in a title: one marked as such, else the last telling token before the first dash.

    Bedroom words and address phrases are taken out first, and tokens equal to the
    address's own house number don't count. A letter at the end or a leading zero
    makes a token telling; other numbers count only if no capitalised word follows.
    """
    t = _text(title)
    marked = F.regexp_extract(t, EXPLICIT_UNIT, 1)
    head = F.element_at(F.split(t, r"(?U)\s+[-–—]\s+"), 1)
    head = F.regexp_replace(F.regexp_replace(head, DESCRIPTOR, " "), ADDRESS_PHRASE, " ")
    own = normalize_unit(house_number(address))
    tokens = F.arrays_zip(F.regexp_extract_all(head, F.lit(UNIT_TOKEN), F.lit(1)).alias("token"), F.regexp_extract_all(head, F.lit(UNIT_TOKEN), F.lit(2)).alias("rest"))
    telling = lambda x: x["token"].rlike("[A-Za-z]$") | x["token"].startswith("0")
    fresh = F.filter(tokens, lambda x: (own == "") | (normalize_unit(x["token"]) != own))
    strong = F.filter(fresh, telling)
    weak = F.filter(fresh, lambda x: ~telling(x) & ~F.regexp_replace(x["rest"], r"^[ :,\-–—]+", "").rlike("^[A-Z][a-z]"))
    last = F.coalesce(F.try_element_at(strong, F.lit(-1))["token"], F.try_element_at(weak, F.lit(-1))["token"])
    return F.coalesce(F.when(marked != "", normalize_unit(marked)).otherwise(normalize_unit(last)), F.lit(""))


def first_named(low: Column, names: dict[str, str]) -> Column:
    """What the first of the names (in their order, wherever they stand) that a text holds stands for.

    At each place a look ahead finds the first name that begins there, so one pass of one pattern finds what asking for each name would.
    """
    ranked = {n: f"{k:04}{of}" for k, (n, of) in enumerate(names.items())}
    found = F.regexp_extract_all(low, F.lit(f"(?=({'|'.join(map(re.escape, names))}))"), F.lit(1))
    return F.substring(F.array_min(F.transform(found, lambda n: F.try_element_at(mapped(ranked), n))), 5, 100)


def infer_borough(c: Column | str) -> Column:
    """A borough named in the text, else that of a neighbourhood named in it, in fixed order."""
    return first_named(F.lower(strip_accents(c)), {b.lower(): b for b in BOROUGHS} | {n: b for n, b in NEIGHBORHOODS.items() if n not in {x.lower() for x in BOROUGHS}})


def borough_from_zip(c: Column | str) -> Column:
    z = F.when(_text(c).rlike(r"^\d+$"), F.expr("0") + _text(c).try_cast("long"))
    return F.coalesce(*[F.when(z.between(a, b), name) for a, b, name in ZIP_RANGES])


def _number(c: Column | str) -> Column:
    return _text(c).try_cast("double")


def parse_price(text: Column | str | None, number: Column | str | None = None) -> Column:
    """Whole dollars of a monthly rent inside RENT_BAND, else null; a value that came as a number is not re-read as text."""
    digits = F.regexp_replace(_text(text), "[^0-9.]", "")
    value = F.when(~digits.rlike(r"\..*\."), digits.try_cast("double"))
    value = F.coalesce(_number(number), value) if number is not None else value
    return F.when(value.between(*RENT_BAND), F.bround(value, 0).cast("int"))


def parse_beds(text: Column | str, number: Column | str | None = None) -> Column:
    """Bedrooms: studio 0, half a room more for a den, flex or convertible one; 0 to 12, else null."""
    t = _text(text)
    named = F.nullif(F.regexp_extract(t, BEDS, 1), F.lit("")).try_cast("double") + F.when(t.rlike(HALF), 0.5).otherwise(0.0)
    bare = F.when(t.rlike(r"(?U)^\s*\d+(\.\d)?\s*$"), F.trim(t).try_cast("double"))
    value = F.when(t.rlike(STUDIO), 0.0).when(t.rlike(BEDS), named).otherwise(bare)
    value = F.coalesce(_number(number), value) if number is not None else value
    return F.when(value.between(0, MOST_BEDS), value)


def parse_area(text: Column | str, number: Column | str | None = None) -> Column:
    """Square feet inside AREA_BAND, else null."""
    t = _text(text)
    found = F.coalesce(F.nullif(F.regexp_extract(t, AREA, 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^\s*([\d,]{3,6})\s*$", 1), F.lit("")))
    value = F.replace(found, F.lit(","), F.lit("")).try_cast("int")
    value = F.coalesce(_number(number).cast("int"), value) if number is not None else value
    return F.when(value.between(*AREA_BAND), value)


def months_free(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_text(c), CONCESSION, 1), F.lit("")).try_cast("int")


def fingerprint(bbl, unit_key, street, beds, source=None, source_ref=None, bin=None) -> Column:
    """Identity without the price: building and unit; else building and the publisher's own id; else building, or street, and beds."""
    building, unit, ref = first_filled(bin if bin is not None else F.lit(None), bbl), blank_to_null(unit_key), blank_to_null(source_ref if source_ref is not None else F.lit(None))
    own = F.concat(F.lit("ref:"), F.coalesce(_text(source if source is not None else F.lit("")), F.lit("")), F.lit(":"), ref)
    beds = F.coalesce(_text(beds), F.lit(""))
    basis = (
        F.when(building.isNotNull() & unit.isNotNull(), F.concat(building, F.lit("|"), unit))
        .when(building.isNotNull() & ref.isNotNull(), F.concat(building, F.lit("|"), own))
        .when(building.isNotNull(), F.concat(building, F.lit("||"), beds))
        .otherwise(F.concat(F.lit("nobbl|"), normalize_street(street), F.lit("|"), F.coalesce(unit, own, F.lit("")), F.lit("|"), beds))
    )
    return F.substring(F.sha1(basis.cast("binary")), 1, 20)


def tax_lot(borough, block, lot) -> Column:
    """Ten digits: borough, block (5) and lot (4)."""
    return F.format_string("%d%05d%04d", *(_text(c).try_cast("int") for c in (borough, block, lot)))


def geo_key(address: Column | str, hint: Column | str) -> Column:
    """The lookup key that all spellings of an address share."""
    place = F.coalesce(infer_borough(hint), infer_borough(address), F.trim(_text(hint)), F.lit(""))
    return F.trim(F.concat_ws(" ", normalize_street(address), place))


def is_offer(title: Column | str, body: Column | str) -> Column:
    """The title doesn't seek, and it or the body's first 600 characters offer."""
    t, b = F.coalesce(_text(title), F.lit("")), F.coalesce(_text(body), F.lit(""))
    return ~t.rlike(SEEKING) & (t.rlike(OFFER) | F.substring(b, 1, 600).rlike(OFFER))


def post_fields(title: Column | str, body: Column | str) -> Column:
    """price (the least plausible one), beds, address and neighbourhood of a post."""
    text = F.concat(F.coalesce(_text(title), F.lit("")), F.lit("\n"), F.coalesce(_text(body), F.lit("")))
    prices = F.transform(F.regexp_extract_all(text, F.lit(POST_PRICE), F.lit(1)), lambda p: F.replace(p, F.lit(","), F.lit("")).try_cast("int"))
    return F.struct(
        F.array_min(F.filter(prices, lambda p: p.between(*POST_RENT_BAND))).alias("price"),
        F.nullif(F.regexp_extract(text, POST_BEDS, 1), F.lit("")).alias("beds"),
        F.nullif(F.trim(F.regexp_extract(text, POST_ADDRESS, 1)), F.lit("")).alias("address"),
        first_named(F.lower(text), {p: p for p in POST_PLACES}).alias("neighborhood"),
    )


def plain_text(html: Column | str) -> Column:
    """Tags out, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_text(html), r"<[^>]+>", " "), r"\s+", " "))


def short_number(c: Column | str) -> Column:
    """A number without a trailing .0."""
    return F.regexp_replace(_text(c), r"\.0$", "")
