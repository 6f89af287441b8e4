"""Filter interaction audit: direct relational replay of five filters in every order.

1. One pass over the texts gives each document its flags: bit k of `fails` is the
   k-th filter of FILTERS. A to D look at the text alone. E needs the least doc_id
   of each text, found table-wide by the SHA-256 of the text; digests with more than
   a thousandth of all rows (so at most 1000) are looked up by broadcast, the others
   by a shuffled join, so a text that fills a third of the table stays spread.
2. The flags of every document are crossed with the 120 broadcast orders, the step
   of the first failure is computed, the five steps are exploded, and conditional
   counts are aggregated. The partial aggregates of a task hold 600 rows a part, so
   what is shuffled doesn't depend on the number of documents.

Documents are rows: repeated rows count as often as they stand. Null and empty texts
have no words, fail A alone of A to D, and are all the same text for E. A null lang is
the part ''. A null doc_id is smaller than none, greater than none and has no labels.
Of several labels of one doc_id any quality of 1 or toxic of 1 counts. Texts are read
whole. An empty table gives no rows. Columns other than doc_id, text and lang are left
aside, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.llm.common import cut, store, table

FILTERS = "ABCDE"
HEAVY = 1000
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = 1 << 10  #: places that rows without doc_id are dealt to


def own_flags(text: Column) -> Column:
    """Bits of the filters that look at one text (A to D); text is never null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    failed = (
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    bits = F.lit(0)
    for k, x in enumerate(failed):
        bits = bits + F.when(x, 1 << k).otherwise(0)
    return bits


def flags(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """doc_id, part and fails for every row of docs (doc_id, text, lang)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = store(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_flags(F.col("text")).alias("fails")))
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null")
    copies = cut(copies)
    bound = max(1, -(-rows.count() // heavy))
    often = F.broadcast(copies.where(F.col("n") > bound).select("digest", "least"))  # fewer than `heavy` rows
    seldom = copies.where(F.col("n") <= bound).select("digest", "least")
    found = rows.join(often, "digest").unionByName(rows.join(often, "digest", "left_anti").join(seldom, "digest", "left"))
    copied = F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
    return found.select("doc_id", "part", (F.col("fails") + copied).alias("fails"))


def labelled(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, good and toxic for every row of marked (doc_id, part, fails)."""
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = known.withColumn("place", F.lit(0))
    place = F.when(F.col("doc_id").isNull(), 1 + F.monotonically_increasing_id() % NO_ID).otherwise(0).cast("int")
    rows = marked.select("part", "fails", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), place.alias("place"))
    no = F.lit(False)
    return rows.join(known, ["doc_id", "place"], "left").select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def orders(spark: SparkSession) -> DataFrame:
    """filter_order, and its filters' places in FILTERS as o1 to o5: 120 rows."""
    rows = [("".join(p), *(FILTERS.index(x) for x in p)) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"o{k} int" for k in range(1, 6)))


def replay(rows: DataFrame) -> DataFrame:
    """Counts per part, filter_order and step for rows of (part, fails, good, toxic)."""
    fails = [F.expr(f"(shiftright(fails, o{k}) & 1) = 1") for k in range(1, 6)]
    first = F.lit(6)
    for k in reversed(range(5)):
        first = F.when(fails[k], k + 1).otherwise(first)
    each = rows.crossJoin(F.broadcast(orders(rows.sparkSession))).withColumn("first", first)
    place = F.lit(None).cast("int")
    for k in range(1, 6):
        place = F.when(F.col("step") == k, F.col(f"o{k}")).otherwise(place)
    steps = each.withColumn("step", F.explode(F.array(*map(F.lit, range(1, 6))))).withColumn("bit", F.call_function("shiftleft", F.lit(1), place))
    here, fails = F.col("first") == F.col("step"), F.col("fails").bitwiseAND(F.col("bit")) != 0

    def number(x: Column) -> Column:
        return F.sum(F.when(x, 1).otherwise(0).cast("long"))

    counts = {
        "kept": F.col("first") > F.col("step"),
        "removed": here,
        "redundant": fails & (F.col("first") < F.col("step")),
        "unique_fails": F.col("fails") == F.col("bit"),
        "good_lost": here & F.col("good"),
        "toxic_lost": here & F.col("toxic"),
    }
    found = steps.groupBy("part", "filter_order", "step").agg(*[number(x).alias(name) for name, x in counts.items()])
    letter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # 120 rows
    return found.withColumn("shapley", F.sum("removed").over(letter))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return replay(labelled(flags(docs), labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
