import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from hearthline.cluster import RELEASE
from hearthline.llm import common
from hearthline.llm.components import components
from tests.llm import brute


def test_word_hashes():
    r = random.Random(1)
    texts = [bytes(r.choice(b"abAB \n\t\x0b\x1c\xc3\xa9") for _ in range(r.randint(0, 60))) for _ in range(800)] + [b"", b" ", b"x" * 300_000 + b" y " + b"z" * 200_000, b"A b"]
    h, n = common.word_hashes(texts)
    words = [w for t in texts for w in t.lower().split()]
    assert n.tolist() == [len(t.split()) for t in texts]
    seen = {}
    assert all(seen.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    _, n = common.word_hashes(texts, kind=common.LETTERS)
    assert n.tolist() == [len(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) for t in texts]
    cased, _ = common.word_hashes([b"A a"], lower=False)
    assert cased[0] != cased[1] and len(common.word_hashes([])[0]) == 0


def test_rolling():
    h, _ = common.word_hashes([b"a b c a b c a"])
    g = common.rolling(h, 3)
    assert len(g) == 5 and g[0] == g[3] and g[1] == g[4] and len(np.unique(g)) == 3 and len(common.rolling(h[:2], 3)) == 0


def test_known_and_without(spark, docs):
    ids = docs.where("doc_id % 3 = 0").select("doc_id").limit(5)
    wanted = {r.doc_id for r in ids.collect()}
    rows = [r.doc_id for r in docs.collect()]
    for bits in (7, 24):
        key = lambda x: (x is None, x)
        assert sorted((r.doc_id for r in common.known(docs, ids, bits).collect()), key=key) == sorted((i for i in rows if i in wanted), key=key)
        assert sorted((r.doc_id for r in common.without(docs, ids, bits).collect()), key=key) == sorted((i for i in rows if i not in wanted), key=key)
    assert common.known(docs, ids.limit(0)).count() == 0 and common.without(docs, ids.limit(0)).count() == len(rows)


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    want = brute.components({x for p in pairs for x in p if p[0] != p[1]}, pairs)
    edges = spark.createDataFrame(pairs + pairs[:9] + [(None, 3)], "u long, v long")
    assert {x.id: x.component for x in components(edges).collect()} == want
    assert components(edges.limit(0)).count() == 0


def test_store(docs):
    assert common.store(docs.select("doc_id", F.lit(1).alias("one"))).count() == docs.count()


def test_equal_rows_are_numbered(spark):
    """Rows that are a good part of all get numbers, wherever they stood; no row is lost or gained, nulls are equal to nulls."""
    rows = [(None, None, 1)] * 250 + [(7, "a", 2)] * 120 + [(k, "b", 3) for k in range(300)] + [(5, "c", 4)] * 2
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, source string, h long").repartition(parts)
        got = [tuple(x) for x in common.copies_numbered(df, heavy=100, chunk=64).collect()]
        assert sorted(((a, b, c) for a, b, c, _ in got), key=str) == sorted(rows, key=str)
        assert sorted(n for *_, c, n in got if c == 1) == list(range(1, 251)) and sorted(n for *_, c, n in got if c == 2) == list(range(1, 121))
        assert {n for *_, c, n in got if c > 2} == {0}
    assert common.copies_numbered(df.where("false")).count() == 0


def test_components_shuffle_three_times_a_round(spark, monkeypatch):
    """Each round deals its edges anew three times at most, and hubs take as few rounds as pairs."""
    from hearthline.llm import components as module

    shuffles, real = [], module.cut

    def counted(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles.append(plan.count("Exchange hashpartitioning"))
        return real(df)

    monkeypatch.setattr(module, "cut", counted)
    for hub in (-1, 10**6):
        shuffles.clear()
        out = module.components(spark.createDataFrame([(hub, i) for i in range(300)], "u long, v long").repartition(5))
        assert {(x.id, x.component) for x in out.collect()} == {(i, min(hub, 0)) for i in [hub, *range(300)]}
        assert len(shuffles) == 2 and max(shuffles) <= 3


def test_what_is_written_releases_its_shuffles(spark):
    """Else they stay until the driver's garbage is collected: a long job's disk is the sum of all it shuffles."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in re.findall(r"shuffle_\d+_\d+_\d+\.data", files.getAllFiles().mkString(" "))}
    before = shuffles()
    df = spark.range(5000).withColumn("k", F.xxhash64("id")).repartition(3, "k")
    written = [write(x) for write in (common.cut, common.store) for x in (df, df.groupBy("k").count())]
    until = time.time() + 10
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert [x.count() for x in written] == [5000] * 4
    assert spark.conf.get(RELEASE) == "false"
