"""The stateful stream gives the events that diff.history() finds in all crawls at once."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from hearthline.operators import diff
from hearthline.plans import histories
from hearthline.streaming import event_stream

SCHEMA = "fingerprint string, source string, crawl timestamp, ordinal long, price int"
COLUMNS = ("fingerprint", "source", "event", "crawl", "old_price", "new_price")


def crawls(days, seed):
    """Crawls of three sources, one of which skips days; listings come, go and come back, with null prices and repeated rows."""
    r = random.Random(seed)
    out = []
    for day in range(days):
        rows, n = [], 0
        for source in ("a", "b", "c"):
            if source == "b" and day % 3 == 1:
                continue
            at = datetime(2026, 1, 1) + timedelta(days=day)
            for k in range(12):
                for _ in range(r.choice([0, 1, 1, 1, 2])):
                    n += 1
                    rows.append((f"{source}{k}", source, at, n, r.choice([None, 100, 100, 110])))
            if source == "c" and day == 4:  # a crawl that saw one listing of no identity
                rows = [x for x in rows if x[1] != "c"] + [(None, "c", at, 1, 5)]
        out.append(rows)
    return out


def keyed(rows):
    return sorted((tuple(x[c] for c in COLUMNS) for x in rows), key=str)


def test_stream_equals_history_over_restarts(spark, tmp_path):
    landed = crawls(9, 4)
    parts = (landed[:3], landed[3:4], landed[4:])  # three starts; several crawls of a source in a file, and several files
    for n, part in enumerate(parts):
        for k, rows in enumerate([sum(part[:2], []), *part[2:]]):
            spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/in/{n}-{k}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
        query = event_stream.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", buckets=3)
        query.awaitTermination()
        assert query.exception() is None
    whole = spark.createDataFrame(sum(landed, []), SCHEMA)
    got = spark.read.schema(event_stream.EVENT).parquet(f"{tmp_path}/out").collect()
    want = diff.history(whole).where(F.col("fingerprint").isNotNull()).collect()
    assert {x.event for x in want} == {"new", "gone", "relisted", "price_change"}
    assert keyed(got) == keyed(want)


def test_a_crawl_leaves_other_sources_alone(spark, tmp_path):
    """Nothing is said of a source that a batch doesn't hold, and a source's empty buckets are swept by its ticks."""
    at = [datetime(2026, 1, 1 + k) for k in range(3)]
    files = [
        [(f"a{k}", "a", at[0], k, 10) for k in range(20)] + [("b1", "b", at[0], 1, 7)],
        [("b2", "b", at[1], 1, 8)],
        [("a3", "a", at[2], 1, 11)],
    ]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    event_stream.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", buckets=4).awaitTermination()
    got = {(x.fingerprint, x.event, x.crawl) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {x for x in got if x[0][0] == "b"} == {("b1", "new", at[0]), ("b1", "gone", at[1]), ("b2", "new", at[1])}
    assert {x for x in got if x[2] == at[2]} == {(f"a{k}", "gone", at[2]) for k in range(20) if k != 3} | {("a3", "price_change", at[2])}


class Counted:
    """A map state that counts the calls, each of which is a round trip to the JVM."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def called(self, x):
        self.calls += 1
        return x

    def iterator(self):
        return self.called(iter(list(self.held.items())))

    def containsKey(self, key):
        return self.called(key in self.held)

    def getValue(self, key):
        return self.called(self.held[key])

    def updateValue(self, key, value):
        self.called(self.held.__setitem__(key, value))

    def removeKey(self, key):
        self.called(self.held.pop(key))


class Handle:
    def __init__(self):
        self.maps = {}

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, Counted())


def test_calls_to_the_state_follow_its_pages():
    """3000 listings of a bucket come, go and come back with no more calls than pages allow."""
    handle, listings, found = Handle(), event_stream.Listings(), []
    listings.init(handle)
    for day, names in enumerate((range(3000), range(1500), range(1000, 3000), [])):
        rows = [("a", 0, k % event_stream.PAGES, datetime(2026, 1, 1 + day), k, f"a{k}", 100 + day) for k in names] + [("a", 0, 0, datetime(2026, 1, 1 + day), 0, None, None)]
        seen = pd.DataFrame(rows, columns=[x.split()[0] for x in event_stream.OBSERVATION.split(", ")])
        found.append(pd.concat(list(listings.handleInputRows(("a", 0), iter([seen[:700], seen[700:]]), None)))["event"].value_counts().to_dict())
    assert found == [{"new": 3000}, {"price_change": 1500, "gone": 1500}, {"relisted": 1500, "price_change": 2000, "gone": 1000}, {"gone": 2000}]
    assert sum(x.calls for x in handle.maps.values()) <= 4 * (1 + 4 * event_stream.PAGES)
    assert not handle.maps["active"].held and sum(len(x[0]) for x in handle.maps["gone"].held.values()) == 3000


def test_slices_are_landed_by_several_tasks(spark, tmp_path, monkeypatch):
    """A slice has as many files as tasks that read its rows, and is still one micro-batch."""
    rows = sum(crawls(9, 4), [])
    spark.createDataFrame([(n, at + timedelta(days=(at.day - 1) * 3 - 731), k, source, float(p or 0), "{}") for n, (k, source, at, _, p) in enumerate((int(f[1:] or 0), s, at, o, p) for f, s, at, o, p in rows if f)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    work = f"{tmp_path}/work"
    monkeypatch.setattr(histories, "_work", lambda spark: work)
    got = histories.stream_events(spark, str(tmp_path)).collect()
    want = diff.history(histories._view(spark, str(tmp_path), "observations")).collect()
    assert keyed(got) == keyed(want)
    assert spark.read.parquet(f"{work}/in").select(F.input_file_name()).distinct().count() > 3
    assert spark.read.text(f"{work}/checkpoint/commits").select(F.input_file_name()).distinct().count() == 3
