"""From raw records to listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions import text as T
from hearthline.functions import times
from hearthline.schemas import LISTING, RAW


def conform(raw: DataFrame) -> DataFrame:
    """raw with all columns of schemas.RAW, missing ones null."""
    have = set(raw.columns)
    return raw.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in RAW], *[c for c in raw.columns if c not in RAW.names])


def normalize(raw: DataFrame, geo: DataFrame, now: Column) -> DataFrame:
    """Listings of the raw records that have an address; geo has the columns of operators.geo.lookup.

    An address that wasn't found keeps its record, at low confidence. Columns of
    raw beyond the schema go along.
    """
    raw = conform(raw).withColumn("address", F.trim("address")).where("address != ''")
    more = [c for c in raw.columns if c not in RAW.names]
    geo = geo.where("found").select("query", F.struct("bbl", "bin", "label", "borough", "lat", "lon", "confidence").alias("g"))
    rows = raw.withColumn("query", T.geo_key("address", "borough_hint")).join(geo, "query", "left")
    hit, g = F.col("g").isNotNull(), lambda c: F.col(f"g.{c}")
    own = T.normalize_unit("unit_raw")
    beds = F.when(F.col("beds_raw").isNotNull() | F.col("beds_num").isNotNull(), T.parse_beds("beds_raw", "beds_num")).otherwise(T.parse_beds("title"))
    rows = rows.withColumn("unit_key", F.when(own != "", own).otherwise(T.unit_from_title(F.coalesce("title", F.lit("")), "address")))
    rows = rows.withColumn("beds", F.coalesce(beds, T.parse_beds(F.col("extra")["description"])))
    confidence = F.when(hit & (F.col("unit_key") != ""), "high").when(hit, "medium").otherwise("low")
    extra = F.map_concat(F.coalesce("extra", F.create_map().cast("map<string,string>")), F.when(hit, F.map_filter(F.create_map(F.lit("geocode_label"), g("label"), F.lit("geocode_confidence"), g("confidence").cast("string")), lambda k, v: v.isNotNull())).otherwise(F.create_map().cast("map<string,string>")))
    out = {
        "fingerprint": T.fingerprint(g("bbl"), F.col("unit_key"), F.col("address"), F.col("beds"), F.col("source"), F.col("source_ref"), g("bin")),
        "address_raw": F.col("address"), "address": F.when(hit, g("label")).otherwise(F.col("address")), "bbl": g("bbl"), "bin": g("bin"),
        "borough": F.when(hit, g("borough")).otherwise(F.col("borough_hint")),
        "lat": F.when(hit, g("lat")).otherwise(F.col("extra")["lat"].try_cast("double")), "lon": F.when(hit, g("lon")).otherwise(F.col("extra")["lon"].try_cast("double")),
        "price": T.parse_price("price_raw", "price_num"), "baths": T.parse_beds("baths_raw", "baths_num"), "sqft": T.parse_area("sqft_raw", "sqft_num"),
        "listed_at": times.to_utc("listed_at"), "first_seen": now, "last_seen": now, "confidence": confidence, "extra": extra,
    }
    return rows.select(*[(out[f.name] if f.name in out else F.col(f.name)).cast(f.dataType).alias(f.name) for f in LISTING], *more)
