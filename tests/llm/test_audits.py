"""op11 to op13 against plain versions written from their definitions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import filter_audit, language_id, source_divergence

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, part string, fails int, digest binary, least long, place int, value long, rank int, term string, c long, p long, b binary, h long, letters boolean"


def mixed(seed=1, n=160):
    """Rows with nulls in every column, empty and long texts, copies, repeated rows and clashing columns."""
    r = random.Random(seed)
    words = {"en": ["the", "of", "And", "house", "red", "tower", "mill"], "fr": ["le", "été", "maison", "DE", "rouge", "où"]}
    rows = []
    for k in range(n):
        lang = r.choice(["en", "en", "fr", None])
        vocabulary = words.get(lang, ["x1y", "zed"]) + [f"n{r.randint(0, 40)}w" for _ in range(3)]
        text = " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 90, 140])))
        if k % 17 == 0:
            text += " # 50%"
        if k % 11 == 0:
            text = text.upper()
        rows.append([k, text, lang, r.choice(["s1", "s2", "s3", None])])
    rows += [[n + 1, rows[5][1], "en", "s1"], [n + 1, rows[5][1], "en", "s1"], [None, rows[5][1], "en", "s2"], [n + 2, None, "en", "s4"], [n + 3, "", None, None], [n + 4, " \t12 3", "de", "s1"]]
    rows += [[n + 5, "wörd " * 30_000 + "end", "fr", "s1"], [None, None, None, None], [n + 6, "x" * 100_000, "en", "s9"]]
    return [(*x, 1, "p", 2, b"d", 3, 4, 5, 6, "t", 7, 8, b"b", 9, False) for x in rows]


@pytest.fixture(scope="module")
def rows():
    return mixed()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, CLASHING).repartition(5).cache()


def plain_divergence(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, by_source = Counter(), defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                df.update(set(d[2]))
                by_source[d[1]].update(d[2])
        kept = [t for t in df if df[t] >= least]
        v, whole = len(kept), sum(by_source.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        q = shares(whole)
        p = {s: shares(c) for s, c in by_source.items()}
        for s in p:
            found = {("pair", o): sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in p if o != s}
            found |= {("term", t): (p[s][t] - q[t]) ** 2 // q[t] for t in kept if by_source[s][t] and p[s][t] > q[t]}
            for part, last in (("pair", len(found)), ("term", ranks)):
                order = sorted((-value, item.encode()) for (kind, item), value in found.items() if kind == part)
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(order[:last], 1)]
    return sorted(out)


@pytest.mark.parametrize("width, small", [(source_divergence.WIDTH, source_divergence.SMALL), (4, 0), (64, 2)])
def test_source_divergence_equals_definition(frame, rows, width, small):
    """Also with a sketch so small that it lets nearly all pass, and groups that are not broadcast."""
    found = source_divergence.audit(frame, width=width, small=small, ranks=5).collect()
    assert sorted(tuple(x[c] for c in ("lang", "source", "part", "item", "value", "rank")) for x in found) == plain_divergence([x[:4] for x in rows], ranks=5)


def test_sketch_never_underestimates(spark):
    texts = [("aa bb cc" if k % 2 else "aa dd", "en") for k in range(7)] + [("once only bb", "fr")]
    df = spark.createDataFrame([(t.encode(), x) for t, x in texts], "b binary, lang string").repartition(3)
    for width in (4, 1 << 12):
        bits = source_divergence.sketch(df, width)
        assert bits.shape == (source_divergence.DEPTH, width // 8 or 1)
        batch = df.toArrow().combine_chunks().to_batches()[0]
        t = source_divergence.Terms(batch)
        frequent = [(x, lang) for x in ("aa", "bb", "cc", "dd") for lang in ("en",)]
        words, langs = [x.decode() for x in t.words.to_pylist()], batch.column(1).dictionary_encode().dictionary.to_pylist()
        for word, lang in frequent:
            for row, slot in zip(bits, t.slots(np.array([langs.index(lang)]), np.array([words.index(word)]), width), strict=True):
                assert (row[slot[0] >> 3] >> (7 - (slot[0] & 7))) & 1
    assert not np.unpackbits(bits).sum() > source_divergence.DEPTH * 4  # with room, rare terms of `fr` set nothing


def test_empty_tables(frame, spark):
    none = frame.where("false")
    assert source_divergence.audit(none).count() == 0
    assert filter_audit.audit(none, labels(spark, [])).count() == 0
    assert language_id.identify(none).count() == 0


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, part string, place int")


def plain_audit(rows, marks):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    counts = defaultdict(Counter)
    for i, text, lang, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "".join(
            x
            for x, failed in zip(
                "ABCDE",
                (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search("[#$%&*|]", text), i is not None and i > least[text]),
                strict=True,
            )
            if failed
        )
        good, toxic = (any(m[k] == 1 for m in marks if m[0] == i and i is not None) for k in (1, 2))
        for order in map("".join, permutations("ABCDE")):
            first = next((k for k, x in enumerate(order, 1) if x in fails), 6)
            for step, x in enumerate(order, 1):
                c = counts[lang or "", order, step]
                c.update(kept=first > step, removed=first == step, redundant=x in fails and first < step, unique_fails=fails == x, good_lost=first == step and good, toxic_lost=first == step and toxic)
    total = Counter()
    for (part, order, step), c in counts.items():
        total[part, order[step - 1]] += c["removed"]
    return {k: (*(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), total[k[0], k[1][k[2] - 1]]) for k, c in counts.items()}


@pytest.mark.parametrize("heavy", [1000, 3])
def test_filter_audit_equals_definition(frame, rows, spark, heavy, monkeypatch):
    """heavy = 3: the empty text's digest is looked up by broadcast, the others by a join."""
    real = filter_audit.flags
    monkeypatch.setattr(filter_audit, "flags", lambda docs: real(docs, heavy))
    marks = [(k, k % 3 % 2, int(k % 5 == 0), "x", 9) for k in range(0, 150, 2)] + [(4, 1, None, "x", 9), (6, None, 1, "y", 9), (None, 1, 1, "y", 9)]
    found = filter_audit.audit(frame, labels(spark, marks)).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(x.part, x.filter_order, x.step): tuple(x[c] for c in names) for x in found}
    assert len(got) == len(found) == 600 * len({x[2] or "" for x in rows})
    assert got == plain_audit([x[:4] for x in rows], marks)


def test_filter_audit_counts_partially_before_it_shuffles(frame, spark):
    plan = filter_audit.replay(filter_audit.labelled(filter_audit.flags(frame), labels(spark, [])))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "partial_sum" in plan and "CartesianProduct" not in plan


WORDS = {
    "en": "the quick weather should thinking through another which there their would house bring".split(),
    "fr": "être avec maison leurs quelque beaucoup toujours français où déjà jamais ceux voilà".split(),
    "de": "über Straße nicht zwischen schön könnten würde haben gewesen zwölf durch grüßen".split(),
}


def labelled_texts(n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        lang = r.choice(sorted(WORDS))
        out.append((k, " ".join(r.choice(WORDS[lang]) for _ in range(r.choice([2, 8, 60, 400]))), lang))
    return out


def test_language_id_held_out_accuracy(spark):
    rows = labelled_texts(400, 3)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !!", "fr"), (None, rows[0][1], None), (None, rows[1][1], "zz"), (1003, "über " * 40_000, None), (7, rows[7][1], rows[7][2]), (1004, "\x00\x00abc", "en")]
    df = spark.createDataFrame([(*x, 1, 2, "x") for x in rows + odd], "doc_id long, text string, lang string, h long, nth int, b string").repartition(4)
    found = {}
    for x in language_id.identify(df).collect():
        found.setdefault(x.doc_id, []).append(x)
    assert sum(map(len, found.values())) == len(rows) + len(odd)
    assert found[7][0] == found[7][1]
    held = [(found[i][0].lang_pred, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i][0].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [found[i][0].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and {found[i][0].score for i in (1000, 1001, 1002)} == {0.0}
    assert found[1003][0].lang_pred == "de"
    assert all(0 <= x.score <= 1 and x.lang_pred in {"en", "fr", "de", "zz", "und"} for xs in found.values() for x in xs)
    nothing = language_id.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {x.lang_pred for x in nothing.collect()} == {"und"}


def test_network_equals_a_plain_convolution():
    net, r = language_id.Network(3), random.Random(2)
    text = bytes(r.randint(0, 255) for _ in range(700)).lower()
    data, start, used, owner = language_id.windows([text, b"", b"ab"])
    x = language_id.cut_out(data, start, used)
    assert owner.tolist() == [0, 0, 0, 1, 2] and used[-2:].tolist() == [0, 2]
    assert bytes(x[0]) == text[:256] and bytes(x[1]) == text[253:509] and bytes(x[4]) == b"ab" + bytes(254)
    pooled = []
    for window in x:
        row = []
        for k, w in enumerate(net.widths):
            one_hot = np.eye(256, dtype=np.float32)[window]
            answers = [np.einsum("wc,wcf->f", one_hot[i : i + w], net.tables[k]) for i in range(256 - w + 1)]
            row.append(np.maximum(np.max(answers, 0) + net.offsets[k], 0))
        pooled.append(np.concatenate(row))
    z = np.array(pooled) @ net.out + net.bias
    plain = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(net.probabilities(x), plain / plain.sum(1, keepdims=True), atol=1e-5)


def test_network_gradients():
    net, r = language_id.Network(3, filters=4), np.random.default_rng(1)
    x, y = r.integers(97, 123, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    loss = lambda: float(-np.log(net.probabilities(x)[np.arange(5), y]).mean())
    for w, g in zip(net.weights(), net.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = w[at], 1e-2
        w[at] = kept + step
        up = loss()
        w[at] = kept - step
        down = loss()
        w[at] = kept
        assert abs((up - down) / (2 * step) - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_language_sample_is_bounded(spark):
    df = spark.createDataFrame([(k, f"text {k % 50} " * 900, f"l{k % 3}") for k in range(300)], "doc_id long, text string, lang string")
    rows = df.select("doc_id", "lang", F.col("text").cast("binary").alias("b"), F.lit(True).alias("letters"))
    found = language_id.sample(rows, languages=2, per_language=10, texts=12, per_text=3)
    assert set(found.column("lang").to_pylist()) == {"l0", "l1"} and len(found) == 2 * 6 * 3
