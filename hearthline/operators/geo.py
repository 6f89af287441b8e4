"""Address lookup: a left join to a cached dimension, a second provider, and the outcomes to remember."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions import text as T

MIN_CONFIDENCE, REGISTER_CONFIDENCE, NEGATIVE = 0.7, 0.9, -1.0


def lookup(addresses: DataFrame, cache: DataFrame, primary: DataFrame, register: DataFrame | None = None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per distinct query key of addresses (address, borough_hint), with its resolution.

    cache and primary have the columns of schemas.GEO; in primary a missing key is
    an empty answer and `failed` (optional) marks a provider that was down. register
    has boroid, lowhousenumber, streetname, bin, block, lot, housenumber and is asked only where the
    primary gave nothing. outcome: hit, negative, resolved, fallback, low, empty, failed.
    """
    keyed = addresses.select(T.geo_key("address", "borough_hint").alias("query"), "address", F.coalesce(T.infer_borough("borough_hint"), T.infer_borough("address")).alias("_b"))
    # one question per key, whatever number of listings ask it
    keys = keyed.where("query != ''").groupBy("query").agg(F.min_by(F.struct("address", "_b"), F.struct("address", "_b")).alias("_a")).select("query", "_a.address", "_a._b")
    fields = ["bbl", "bin", "label", "borough", "lat", "lon", "confidence", "provider"]

    def struct(df: DataFrame, alias: str) -> DataFrame:
        """One answer per key: the most confident, then the least of all fields."""
        held = F.struct(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])
        failed = [F.col("failed")] if "failed" in df.columns else []
        order = F.struct(-F.coalesce("confidence", F.lit(0.0)), held, *failed)
        return df.groupBy("query").agg(F.min_by(held, order).alias(alias), *[F.min_by(c, order).alias("failed") for c in failed])

    out = keys.join(struct(cache, "_c"), "query", "left").join(struct(primary, "_p"), "query", "left")
    if register is not None:
        house, street = F.regexp_extract("address", r"(?U)^\s*(\d[\w-]*)\s+", 1), T.street_part("address")
        boro = F.try_element_at(T.mapped(T.BOROUGH_IDS), F.col("_b"))
        rows = register.select(
            F.col("boroid").cast("string").alias("_i"), F.col("lowhousenumber").cast("string").alias("_h"), F.col("streetname").alias("_s"),
            F.struct(F.when(F.col("block").cast("string").rlike(r"^\d+$") & F.col("lot").cast("string").rlike(r"^\d+$"), T.tax_lot("boroid", "block", "lot")).alias("bbl"), F.col("bin").cast("string").alias("bin"), F.concat_ws(" ", "housenumber", "streetname").alias("label")).alias("_r"),
        ).groupBy("_i", "_h", "_s").agg(F.min("_r").alias("_r"))
        out = out.withColumns({"_i": boro, "_h": house, "_s": T.register_street(street)}).join(rows, ["_i", "_h", "_s"], "left").drop("_i", "_h", "_s")
        label = F.concat(F.col("_r.label"), F.lit(", "), F.upper(F.coalesce("_b", F.lit(""))))
        out = out.withColumn("_r", F.when(F.col("_r.bbl").isNotNull(), F.struct(F.col("_r.bbl").alias("bbl"), F.col("_r.bin").alias("bin"), label.alias("label"), F.col("_b").alias("borough"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(REGISTER_CONFIDENCE).alias("confidence"), F.lit("register").alias("provider"))))
    else:
        out = out.withColumn("_r", F.lit(None).cast("struct<bbl:string,bin:string,label:string,borough:string,lat:double,lon:double,confidence:double,provider:string>"))
    failed = F.coalesce("failed", F.lit(False)) if "failed" in primary.columns else F.lit(False)
    outcome = (
        F.when(F.col("_c").isNotNull() & F.col("_c.bbl").isNull() & (F.col("_c.confidence") == NEGATIVE), "negative")
        .when(F.col("_c").isNotNull(), "hit")
        .when((F.col("_p").isNull() | failed) & F.col("_r").isNotNull(), "fallback")
        .when(failed, "failed")
        .when(F.col("_p").isNull(), "empty")
        .when(F.col("_p.confidence") < min_confidence, "low")
        .otherwise("resolved")
    )
    out = out.withColumn("outcome", outcome)
    taken = F.when(F.col("outcome") == "hit", F.col("_c")).when(F.col("outcome") == "resolved", F.col("_p")).when(F.col("outcome") == "fallback", F.col("_r"))
    return out.select("query", "outcome", taken.alias("g")).select("query", "outcome", F.col("outcome").isin("hit", "resolved", "fallback").alias("found"), "g.*")


def remember(resolved: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache with what was learnt: answers, and negatives for addresses that don't exist; failures never."""
    new = resolved.where(F.col("outcome").isin("resolved", "fallback", "low", "empty"))
    keep = lambda c: F.when(F.col("found"), F.col(c))
    new = new.select("query", *[keep(c).alias(c) for c in ("bbl", "bin", "label", "borough", "lat", "lon")], F.when(F.col("found"), F.col("confidence")).otherwise(F.lit(NEGATIVE)).alias("confidence"), keep("provider").alias("provider"))
    return cache.unionByName(new.join(cache.select("query"), "query", "left_anti"), allowMissingColumns=True)


def statistics(resolved: DataFrame) -> DataFrame:
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return resolved.agg(n("hit", "negative").alias("hit"), n("resolved", "fallback", "low", "empty", "failed").alias("miss"), n("failed").alias("fail"), n("low").alias("low_confidence"), n("fallback").alias("fallback"))
