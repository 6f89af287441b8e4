"""Change capture as a stateful stream: state is held where a source's listings are, and a crawl meets its own source alone.

Listings are dealt to BUCKETS buckets of their source; the state of one (source,
bucket) is two maps, of the listings on the market and of those that are gone, each
in PAGES pages of fingerprints and their last known prices. A crawl reads the first
map of its source's buckets, which is what a sweep has to compare with anyway, and of
the second the pages of what isn't in the first; it writes the pages that changed. So
the calls to the state follow the pages, not the listings: each is a round trip
between Python and the JVM. The states of other sources aren't touched, whatever
their size, and the batch fold's join with the whole state is gone. Each crawl sends a
tick to all buckets of its source, so that a bucket of which the crawl saw nothing is
swept as well.

State lives in the stream's checkpoint (RocksDB with a change log), so a query that
dies goes on from its last finished batch, and the sink's files are written once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import MapState
from pyspark.sql.streaming.query import StreamingQuery

from hearthline.cluster import ship

BUCKETS, PAGES = 256, 16
OBSERVATION = "source string, bucket int, page int, crawl timestamp, ordinal long, fingerprint string, price int"
EVENT = "fingerprint string, source string, event string, crawl timestamp, old_price int, new_price int"
PAGE = "fingerprints array<string>, prices array<int>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dealt(observations: DataFrame, buckets: int) -> DataFrame:
    """Observations (fingerprint, source, crawl, ordinal, price) with their bucket and page, and each task's ticks: rows without fingerprint for all buckets of its crawls."""
    bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(buckets)).cast("int").alias("bucket")
    page = F.pmod(F.shiftright(F.xxhash64("fingerprint"), 32), F.lit(PAGES)).cast("int").alias("page")
    rows = observations.select("source", bucket, page, F.col("crawl").cast("timestamp").alias("crawl"), F.col("ordinal").cast("long").alias("ordinal"), "fingerprint", F.col("price").cast("int").alias("price"))

    def ticks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple] = set()
        for batch in batches:
            yield batch
            crawls = pa.Table.from_batches([batch]).group_by(["source", "crawl"]).aggregate([])
            fresh = [x for x in zip(crawls["source"].to_pylist(), crawls["crawl"].to_pylist(), strict=True) if x not in met]
            met.update(fresh)
            for source, crawl in fresh:
                same = {"source": source, "page": 0, "crawl": crawl, "ordinal": 0}  # no null ordinals: long ones would become doubles
                columns = [pa.array(range(buckets) if f.name == "bucket" else [same.get(f.name)] * buckets, f.type) for f in batch.schema]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows.mapInArrow(ticks, OBSERVATION)


class Listings(StatefulProcessor):
    """Events of one bucket of one source; crawls of a micro-batch are taken in order of time, 1 to the last, and 0 is what was held before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getMapState("active", "page int", PAGE)
        self.gone = handle.getMapState("gone", "page int", PAGE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows), ignore_index=True)
        crawls, run = np.unique(seen["crawl"].to_numpy(), return_inverse=True)
        seen, last = seen.assign(run=run + 1)[seen["fingerprint"].notna()], len(crawls)
        held = _read(self.active.iterator())
        strange = seen.loc[~seen["fingerprint"].isin(held["fingerprint"]), "page"]
        met = set(strange) | set(held.loc[~held["fingerprint"].isin(seen.loc[seen["run"] == last, "fingerprint"]), "page"]) | set(seen.loc[seen["run"] < last, "page"])
        past = _read(((p,), self.gone.getValue((p,))) for p in sorted(met) if self.gone.containsKey((p,)))
        # every listing once: those held, those gone, and the rest of what was seen
        known = pd.concat([held.assign(run=0), past.assign(run=-1), seen[["page", "fingerprint"]].assign(price=np.nan, run=-2)], ignore_index=True).drop_duplicates("fingerprint", ignore_index=True)
        before, old = known["run"].to_numpy(), known["price"].to_numpy(dtype=float)
        n, code = len(known), pd.Index(known["fingerprint"]).get_indexer(seen["fingerprint"])
        order = np.lexsort((seen["ordinal"].to_numpy(), seen["run"].to_numpy(), code))
        code, run, price = code[order], seen["run"].to_numpy()[order], seen["price"].to_numpy(dtype=float)[order]
        # what was known before each row and after it: the last price of its listing that isn't null
        place = np.arange(len(code))
        first = np.r_[True, code[1:] != code[:-1]][: len(code)]
        final = np.r_[code[1:] != code[:-1], True][: len(code)]
        start = np.maximum.accumulate(np.where(first, place, 0)) if len(code) else place
        given = np.maximum.accumulate(np.where(np.isnan(price), -1, place)) if len(code) else place
        after = np.where(given >= start, price[given], old[code])
        prior = np.where(first, old[code], np.r_[np.nan, after[:-1]][: len(code)])
        since = np.where(first, before[code], np.r_[0, run[:-1]][: len(code)])
        until = np.where(final, last + 1, np.r_[run[1:], 0][: len(code)])
        new = since == -2
        none = np.full(len(code), np.nan)
        back, changed, left = ~new & (run - since > 1), ~new & ~np.isnan(price) & ~np.isnan(prior) & (price != prior), until - run > 1
        opened = np.full(n, last + 1)
        opened[code[first]] = run[first]
        lost = (before == 0) & (opened > 1)
        names = known["fingerprint"].to_numpy()
        made = [
            (names[code[on]], what, crawls[at[on] - 1], was[on], now[on])
            for what, on, at, was, now in (("new", new, run, none, price), ("relisted", back, run, prior, price), ("price_change", changed, run, prior, price), ("gone", left, run + 1, none, none))
        ]
        made.append((names[lost], "gone", crawls[np.zeros(lost.sum(), dtype=int)], np.full(lost.sum(), np.nan), np.full(lost.sum(), np.nan)))
        for fingerprint, what, at, was, now in made:
            if len(fingerprint):
                yield pd.DataFrame({"fingerprint": fingerprint, "source": key[0], "event": what, "crawl": at, "old_price": pd.array(was, "Int32"), "new_price": pd.array(now, "Int32")})
        latest, stands = old.copy(), np.where(before == 0, -1, before)  # what a crawl didn't see is gone
        latest[code[final]] = after[final]
        stands[code[final]] = np.where(run[final] == last, 0, -1)
        moved = (before != stands) | ~((old == latest) | (np.isnan(old) & np.isnan(latest)))
        known = known.assign(price=latest)
        _write(self.active, known, stands == 0, moved & ((before == 0) | (stands == 0)))
        _write(self.gone, known, stands == -1, moved & ((before == -1) | (stands == -1)))

    def close(self) -> None:
        pass


def _read(pages: Iterable[tuple]) -> pd.DataFrame:
    """The listings of pages of state: page, fingerprint, price."""
    parts = [pd.DataFrame({"page": k[0], "fingerprint": v[0], "price": pd.Series(v[1], dtype=float)}) for k, v in pages]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"page": pd.Series(dtype=int), "fingerprint": pd.Series(dtype=object), "price": pd.Series(dtype=float)})


def _write(state: MapState, known: pd.DataFrame, kept: np.ndarray, moved: np.ndarray) -> None:
    """Write the pages of which a listing moved: those listings of them that are kept."""
    touched = set(known.loc[moved, "page"])
    rows = known[kept & known["page"].isin(touched).to_numpy()]
    pages = {int(p): x for p, x in rows.groupby("page")}
    for page in sorted(int(p) for p in touched):
        if page in pages:
            held = pages[page]
            state.updateValue((page,), (held["fingerprint"].tolist(), [None if p != p else int(p) for p in held["price"].tolist()]))
        else:
            state.removeKey((page,))


def events(observations: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The events of a stream of observations; a micro-batch holds whole crawls of its sources, in order of time from batch to batch.

    They equal diff.history() over all crawls so far. Null fingerprints are left out
    (their crawl still counts). Sources that hold very many listings want more buckets:
    one bucket's listings on the market are held by one task.
    """
    session = observations.sparkSession
    ship(session)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return dealt(observations, buckets).groupBy("source", "bucket").transformWithStateInPandas(Listings(), EVENT, "append", "none")


def start(observations: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """Write the events of a stream of observations as Parquet files below `out`."""
    writer = events(observations, buckets).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
