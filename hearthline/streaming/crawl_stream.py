"""Crawls as a stream: each micro-batch of landed raw records is one crawl of the sources in it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from hearthline.operators.state import History
from hearthline.plans.crawl import crawl


def start(raw: DataFrame, history: History, primary: DataFrame, checkpoint: str, clock, min_expected: dict[str, int] | None = None, sweep: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Fold a stream of raw records (schemas.RAW) into a history.

    clock(batch_id) gives the time of a batch. A batch holds whole crawls of its
    sources (as landed files do); a batch already folded before a failure is
    recognised by its time in the runs and skipped.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        now: datetime = clock(batch_id)
        if not history.log("runs").where(f"started_at = timestamp'{now}'").isEmpty():
            return
        names = [r.source for r in batch.select("source").distinct().collect()]  # as many as sources
        sources = {n: (lambda n=n: batch.where(batch["source"] == n)) for n in sorted(names)}
        if sources:
            crawl(history, sources, min_expected or {}, primary, None, now, sweep)

    return raw.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
