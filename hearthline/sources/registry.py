"""Registries of sources, saved searches and survey results, from files that Spark reads."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.cluster import numbered
from hearthline.operators.normalize import conform
from hearthline.sources import htmlx, jsonx

#: Adapters by type: each makes raw records of landed pages or payloads.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {"jsonld": htmlx.markup, "jsonapi": jsonx.json_api, "htmlindex": htmlx.details, "cards": htmlx.cards, "lotteries": jsonx.lotteries, "posts": jsonx.posts}
META = ("type", "enabled", "notes", "min_expected", "id")


def build(spec: dict, landed: DataFrame, **more) -> DataFrame:
    """Raw records of one source entry, with schemas.RAW's meaning; unknown types are an error."""
    if spec.get("type") not in ADAPTERS:
        raise ValueError(f"unknown source type: {spec.get('type')!r}")
    return ADAPTERS[spec["type"]](landed, spec["id"], **{k: v for k, v in spec.items() if k not in META}, **more)


def build_all(specs: list[dict], landed: DataFrame) -> DataFrame:
    """Raw records of all entries (schemas.RAW), each built from the landings of its own `source`.

    Every entry reads its part alone: where the landings are stored by source, the others are pruned.
    """
    parts = [conform(build(s, landed.where(F.col("source") == s["id"]).drop("source"))).select(schemas.RAW.names) for s in specs]
    return reduce(DataFrame.unionByName, parts)


def enabled(specs: list[dict]) -> list[dict]:
    return [s for s in specs if s.get("enabled", True)]


def expectations(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """(source, min_expected) of the entries, 1 where none is given."""
    return spark.createDataFrame([(s["id"], int(s.get("min_expected", 1))) for s in specs], "source string, min_expected int")


def entries(text: str) -> list[dict]:
    """The entries of a registry's text, JSON or YAML: the whole document, or its `sources`."""
    import json

    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise ValueError("a registry that isn't JSON needs a YAML parser, which isn't installed") from e
        found = yaml.safe_load(text)
    return (found.get("sources") or []) if isinstance(found, dict) else found or []


def read_sources(spark: SparkSession, path: str) -> list[dict]:
    """The entries of one registry file."""
    return entries("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one configuration file


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV registry with a header; lines that begin with # and rows without a domain are left out."""
    rows = spark.read.csv(path, header=True, comment="#")
    return rows.where(F.coalesce(F.trim("domain"), F.lit("")) != "") if "domain" in rows.columns else rows


def survey_rows(rows: DataFrame, verdicts: list[str], tier: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of some verdicts and a tier, the first `limit` by name."""
    rows = rows.where(F.col("verdict").isin(verdicts))
    rows = rows if tier is None else rows.where(F.col("tier") == tier)
    return rows if limit is None else rows.orderBy("name").limit(limit)


def queue(rows: DataFrame, vendor: str | None = None, tier: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A slice of the discovery queue in order of its seq, filtered by vendor substring and tier."""
    if vendor:
        rows = rows.where(F.lower("vendor").contains(vendor.lower()))
    if tier:
        rows = rows.where(F.col("tier") == tier)
    rows = rows.orderBy("seq").offset(offset)
    return rows if limit is None else rows.limit(limit)


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CRITERIA).json(path, multiLine=True)


def ranked_survey(rows: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Survey rows with their place by verdict rank and name."""
    rank = F.coalesce(*[F.when(F.col("verdict") == v, r) for v, r in ranks.items()], F.lit(99))
    return numbered(rows, [rank, F.lower("name"), F.col("name")], "place")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(columns).write.mode("overwrite").csv(path, header=True)


def write_specs(candidates: DataFrame, path: str) -> None:
    """Generated source entries as JSON lines."""
    candidates.select(jsonx.source_spec(candidates, F.concat(F.lit("found_"), F.substring(F.sha1("url"), 1, 8))).alias("value")).write.mode("overwrite").text(path)
