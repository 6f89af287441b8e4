"""Schemas of raw records, listings, events, runs and the lead-time ledger."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()), "array<string>": T.ArrayType(T.StringType()),
}


def parse(columns: str) -> T.StructType:
    """A schema of `name type` pairs; needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in columns.split(", "))])


RAW = parse(
    "source string, source_url string, address string, unit_raw string, price_raw string, price_num double, beds_raw string, beds_num double, "
    "baths_raw string, baths_num double, sqft_raw string, sqft_num double, available_on string, listed_at string, title string, detail_url string, "
    "borough_hint string, no_fee boolean, source_ref string, extra map<string,string>"
)
LISTING = parse(
    "fingerprint string, source string, source_url string, detail_url string, address string, address_raw string, bbl string, bin string, borough string, "
    "lat double, lon double, unit_key string, unit_raw string, price int, beds double, baths double, sqft int, available_on string, listed_at timestamp, "
    "no_fee boolean, first_seen timestamp, last_seen timestamp, confidence string, extra map<string,string>"
)
STATE = T.StructType([*LISTING.fields, T.StructField("gone_at", T.TimestampType())])
EVENT = parse("fingerprint string, observed_at timestamp, event string, old_price int, new_price int, seq int")
LEDGER = parse("fingerprint string, our_first_seen timestamp, aggregator string, aggregator_seen timestamp, lead_hours double, basis string, matched_by string, matched_fp string")
RUN = parse("source string, started_at timestamp, finished_at timestamp, ok boolean, n_raw long, n_new long, n_updated long, n_gone long, n_unresolved long, error string")
GEO = parse("query string, bbl string, bin string, label string, borough string, lat double, lon double, confidence double, provider string")
CRITERIA = parse("name string, max_price int, min_beds double, max_beds double, boroughs array<string>, zip_codes array<string>, require_no_fee boolean, min_sqft int, min_confidence string")
