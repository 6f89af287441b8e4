import unicodedata

import pytest
from pyspark.sql import functions as F

from hearthline.functions import text as T
from hearthline.functions import times


def run(spark, rows, schema, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


CASES = {
    "street": (T.normalize_street, [("350 West 42nd Street", "350 w 42 st"), ("350 W. 42nd St.", "350 w 42 st"), ("1500 Ave. of the Americas", "1500 ave of the americas"), ("42-20 24th Street", "42-20 24 st"), ("Ünter & Straße, 1ST", "unter and straße 1"), (None, ""), ("", "")]),
    "unit": (T.normalize_unit, [("#12B", "12B"), ("Apt 12-B", "12B"), ("Unit 12 b", "12B"), ("004B", "4B"), (None, ""), ("000", "0")]),
    "beds": (T.parse_beds, [("1 QPS 004B - Studio", 0.0), ("1 QPS 018C - 1 Bedroom", 1.0), ("2 Bed / 2 Bath", 2.0), ("3BR", 3.0), ("1 Bedroom + Den", 1.5), ("2", 2.0), ("Luxury rental", None), ("13 beds", None), (None, None)]),
    "price": (T.parse_price, [("3763", 3763), ("$4,002/mo", 4002), ("120000", None), ("430", None), ("call for price", None), ("1.2.3", None), ("2500.5", 2500), ("2501.5", 2502), (None, None)]),
    "borough": (T.infer_borough, [("Long Island City", "Queens"), ("Chelsea", "Manhattan"), ("123 Main St, Brooklyn, NY", "Brooklyn"), ("Hoboken", None), (None, None)]),
    "zip": (T.borough_from_zip, [("10001", "Manhattan"), ("11109", "Queens"), ("11256", "Brooklyn"), ("07030", None), ("x", None), (None, None)]),
    "house": (T.house_number, [("42-20 24th Street", "42-20"), ("Broadway", ""), (None, "")]),
    "area": (T.parse_area, [("750 sq ft", 750), ("1,200sf", 1200), ("900", 900), ("50", None), ("about 30", None)]),
    "months": (T.months_free, [("2 months free", 2), ("1 Month OP", 1), ("none", None)]),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    f, cases = CASES[name]
    assert run(spark, [(c[0],) for c in cases], "raw string", f("raw")) == [c[1] for c in cases]


def test_unit_from_title(spark):
    cases = [
        ("1 QPS 004B - Studio", "", "4B"), ("1 QPS 018C - 1 Bedroom", "", "18C"), ("101 West 15th Street 227 - 1 Bedroom", "", "227"), ("10 Downing Street 003P - Studio", "", "3P"),
        ("350 W 42nd St #12B, 2 Bed", "", "12B"), ("Studio Apartment", "", ""), ("1-Bedroom at 70 Pine Street", "", ""), ("Studio at 8 Spruce Street", "", ""), ("2-Bedroom at The Nathaniel", "", ""),
        ("70 Pine Street 12B - 1 Bedroom", "", "12B"), ("1-Bedroom at 42-20 24th Street", "", ""), ("Studio at Gateway: 365 South End", "365 South End Avenue", ""),
        ("Studio at Sullivan Mews: 113 Sullivan", "113 Sullivan Street", ""), ("101 West 15th Street 227 - 1 Bedroom", "101 West 15th Street", "227"),
        ("Studio at Garden Town: 645 East 14th", "635 East 14th Street", ""), ("1-Bedroom at City East: 227 East 66th", "209 East 66th Street", ""), ("Apt 12B North Tower", "70 Pine Street", "12B"), (None, None, ""),
    ]
    assert run(spark, [c[:2] for c in cases], "title string, address string", T.unit_from_title("title", "address")) == [c[2] for c in cases]


def test_fingerprint(spark):
    rows = [
        ("1010327501", "12B", "350 W 42 St", 1.0, None, "a", None), ("1010327501", "12B", "350 West 42nd Street", 1.0, None, "a", None), ("1010327501", "12C", "350 W 42 St", 1.0, None, "a", None),
        ("1009720001", "07A", "x", 1.0, "1082851", "a", None), ("1009720001", "07A", "y", 1.0, "1082865", "a", None), ("9", "07A", "x", 1.0, "1082851", "b", "r"),
        ("9", "", "x", 1.0, None, "b", "r"), ("9", "", "x", 1.0, None, "c", "r"), ("9", "", "x", 1.0, None, "b", None), ("9", "", "x", None, None, "b", None), (None, "", "350 W. 42nd St.", 0.5, None, "b", None), (None, "", "350 West 42 Street", 0.5, None, "b", None),
    ]
    got = run(spark, rows, "bbl string, unit string, street string, beds double, bin string, source string, ref string", T.fingerprint(F.col("bbl"), F.col("unit"), F.col("street"), F.col("beds"), F.col("source"), F.col("ref"), F.col("bin")))
    groups = [0, 0, 1, 2, 3, 2, 4, 5, 6, 7, 8, 8]
    assert all(len(x) == 20 for x in got)
    assert all((got[i] == got[j]) == (groups[i] == groups[j]) for i in range(12) for j in range(12))
    import hashlib

    assert got[0] == hashlib.sha1(b"1010327501|12B").hexdigest()[:20] and got[10] == hashlib.sha1(b"nobbl|350 w 42 st||0.5").hexdigest()[:20]


def test_times(spark):
    cases = [("2026-08-27 22:07:40", "2026-08-27 22:07:40"), ("2026-08-27T22:07:40Z", "2026-08-27 22:07:40"), ("2026-08-27T22:07:40+02:00", "2026-08-27 20:07:40"), ("2026-08-27T22:07:40.9", "2026-08-27 22:07:40"), ("08/27/2026", "2026-08-27 00:00:00"), ("08/27/2026 10:11:12", "2026-08-27 10:11:12"), ("2026", None), ("soon", None), ("", None), (None, None)]
    got = run(spark, [(c[0],) for c in cases], "raw string", times.to_utc("raw").cast("string"))
    assert got == [c[1] for c in cases]
    posted = [("today", "2026-08-31 12:00:00"), ("yesterday", "2026-08-30 12:00:00"), ("11 hours", "2026-08-31 01:00:00"), ("3 days ago", "2026-08-28 12:00:00"), ("2 weeks", "2026-08-17 12:00:00"), ("later", None), (None, None)]
    got = run(spark, [(c[0],) for c in posted], "raw string", times.posted_to_timestamp("raw", F.lit("2026-08-31 12:00:00").cast("timestamp")).cast("string"))
    assert got == [c[1] for c in posted]


def test_posts(spark):
    rows = [("No fee 2BR for rent $3,200/mo", "at 123 West 45th Street in Astoria, deposit $600", True), ("Looking for a room", "available now", False), ("Studio", "sublet", True), ("Thoughts on this?", "for rent", False), (None, None, False)]
    df = spark.createDataFrame(rows, "title string, body string, want boolean")
    out = df.select("want", T.is_offer("title", "body").alias("got"), T.post_fields("title", "body").alias("f")).collect()
    assert [r.got for r in out] == [r.want for r in out]
    assert out[0].f.asDict() == {"price": 600, "beds": "2BR", "address": "123 West 45th Street", "neighborhood": "astoria"}


def test_accents_of_every_code_point(spark):
    """Equal to the compatibility decomposition without combining marks, alone and inside other text."""
    codes = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    bare = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    rows = [(chr(c),) for c in codes] + [("".join(f"a{chr(c)}" for c in codes[i : i + 50]),) for i in range(0, len(codes), 997)] + [("plain",), ("",), (None,), ("ﬁn é 𝐀 한 x̂",)]
    df = spark.createDataFrame(rows, "t string").repartition(8)
    wrong = [(x.t, x.s) for x in df.select("t", T.strip_accents("t").alias("s")).collect() if x.s != (None if x.t is None else bare(x.t))]
    assert not wrong, wrong[:5]
