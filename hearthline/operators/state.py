"""Tables of a crawl history as versioned snapshots below one folder of a shared store.

A table is dealt to buckets by a hash of its key. A version writes the buckets that
changed, whole, under its own number; only then is the version added to the list of
versions (the manifest), an append that readers see at once or not at all. The
manifest says for each bucket of each table which version wrote it last. So a job
that dies in between leaves the old version current, a table or bucket that didn't
change isn't copied, and what a crawl writes follows the keys that it touches, not
the state. The number of buckets is fixed by the first version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthline import schemas

TABLES: dict[str, StructType] = {"listings": schemas.STATE, "ledger": schemas.LEDGER, "geo": schemas.GEO}
KEYS = {"listings": "fingerprint", "ledger": "fingerprint", "geo": "query"}
LOGS: dict[str, StructType] = {"events": schemas.EVENT, "runs": schemas.RUN}
BUCKETS = 32


@dataclass(frozen=True)
class Part:
    """All rows of some buckets of a table, to be written in place of what they held."""

    rows: DataFrame
    buckets: list[int]


def migrate(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the columns that the schema has gained since it was written; others stay."""
    return df.sparkSession.createDataFrame([], schema).unionByName(df, allowMissingColumns=True)


class History:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        """buckets counts for a new history; an existing one keeps its own."""
        self.spark, self.path, self._buckets, self._settled = spark, path.rstrip("/"), buckets, False

    def _file(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._file(path)
        return fs.exists(where)

    def _children(self, path: str) -> list[str]:
        fs, where = self._file(path)
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def _versions(self) -> DataFrame | None:
        """version, buckets and, per table, the version that wrote each bucket (0: it is empty); null before the first."""
        path = f"{self.path}/versions"
        if not self._exists(path):
            return None
        return self.spark.read.schema(", ".join(["version long, buckets int", *[f"{t} array<long>" for t in TABLES]])).parquet(path)

    def _current(self) -> dict:
        rows = self._versions()
        last = rows.orderBy(F.desc("version")).first() if rows is not None else None
        return last.asDict() if last else {"version": 0, "buckets": self._buckets} | {t: [0] * self._buckets for t in TABLES}

    def version(self) -> int:
        """The current version, 0 before the first."""
        return self._current()["version"]

    def bucket(self, table: str, key: str | None = None) -> Column:
        """The bucket of a row of the table, by its key column."""
        if not self._settled:
            now = self._current()
            self._buckets, self._settled = now["buckets"], now["version"] > 0
        return F.pmod(F.xxhash64(F.coalesce(F.col(key or KEYS[table]), F.lit(""))), F.lit(self._buckets)).cast("int")

    def touched(self, table: str, rows: DataFrame, key: str | None = None) -> list[int]:
        """The buckets that hold the keys of rows; as many as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket(table, key)).distinct().collect())

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table's current rows, or those of some buckets."""
        schema, at = TABLES[table], self._current()[table]
        paths = [f"{self.path}/{table}/v={at[b]}/bucket={b}" for b in (range(len(at)) if buckets is None else buckets) if at[b]]
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def log(self, table: str) -> DataFrame:
        """Rows of an append-only table up to the current version."""
        path, schema = f"{self.path}/{table}", LOGS[table]
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return migrate(self.spark.read.parquet(path).where(F.col("version") <= self.version()).drop("version"), schema)

    def commit(self, tables: dict[str, DataFrame | Part], logs: dict[str, DataFrame]) -> int:
        """Write the next version: a DataFrame is a whole table, a Part some of its buckets; all else stays where it is."""
        now = self._current()
        v = now["version"] + 1
        at = {name: list(now[name]) for name in TABLES}
        for name, given in tables.items():
            part = given if isinstance(given, Part) else Part(given, list(range(now["buckets"])))
            path = f"{self.path}/{name}/v={v}"
            part.rows.withColumn("bucket", self.bucket(name)).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)
            written = {int(x.removeprefix("bucket=")) for x in self._children(path) if x.startswith("bucket=")}
            if written - set(part.buckets):
                raise ValueError(f"rows of {name} outside of the buckets that are replaced")
            for b in part.buckets:
                at[name][b] = v if b in written else 0
        for name, rows in logs.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/version={v}")
        self._publish(v, now["buckets"], at)
        return v

    def _publish(self, version: int, buckets: int, at: dict[str, list[int]]) -> None:
        row = self.spark.createDataFrame([(version, buckets, *[at[t] for t in TABLES])], ", ".join(["version long, buckets int", *[f"{t} array<long>" for t in TABLES]]))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def prune(self, keep: int = 2) -> int:
        """Remove the buckets that none of the newest `keep` versions reads; returns how many. Logs stay whole.

        Readers of an older version must have ended, and no other job may be writing.
        """
        rows = self._versions()
        if rows is None:
            return 0
        kept = rows.orderBy(F.desc("version")).limit(max(1, keep)).collect()
        removed = 0
        for name in TABLES:
            used = {(v, b) for r in kept for b, v in enumerate(r[name])}
            for folder in self._children(f"{self.path}/{name}"):
                v, path = int(folder.removeprefix("v=")), f"{self.path}/{name}/{folder}"
                held = {int(x.removeprefix("bucket=")) for x in self._children(path) if x.startswith("bucket=")}
                whole = not any((v, b) in used for b in held)
                for drop in [path] if whole else [f"{path}/bucket={b}" for b in held if (v, b) not in used]:
                    fs, where = self._file(drop)
                    fs.delete(where, True)
                removed += sum((v, b) not in used for b in held)
        return removed

    def recent_runs(self, n: int = 12) -> DataFrame:
        return self.log("runs").orderBy(F.desc("started_at"), "source").limit(n)
