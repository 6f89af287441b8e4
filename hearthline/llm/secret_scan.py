"""Secret scans: pattern candidates, and a random forest that removes the false ones.

Candidates are long runs of key characters that hold a digit or mix cases, and
values assigned with `=` or `:` after a telling name. A run that holds such an
assignment is cut there, so that the value is judged alone. Features of a candidate:
its length, its character classes and the transitions between them, dictionary
coverage, path-like marks, and the neighbouring words. A random forest trained
on labelled findings gives the probability that it is a secret.

The labelled findings are a parameter; by default they are made by rule with a
fixed seed (keys of several shapes in code and in prose, against paths, names,
placeholders, numbers, identifiers and long words). At most FINDINGS of them are
used, so the forest is of bounded size; it is trained once and sent with the
task. Every text is searched whole, alone, with no shuffle.

Null texts count as empty: no candidates. A value of any length is one candidate,
up to a further `&name=`; one inside another belongs to it, unless only a telling
name stands before. What is left empty once marks are stripped is no candidate.
Texts of any length are searched whole. Repeated rows, and rows of a null doc_id,
give repeated results; an empty table gives no rows. Spans have no ties: they don't
overlap. `scan_documents` leaves other columns aside by name, `redact` keeps them.
Offsets count code points of the text.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import by_batch, record, table, text_bytes, tune

FINDINGS = 6000
TREES, DEPTH, LEAF = 30, 9, 5
CUT = 0.5
MOST_AT_ONCE = 20_000
RUN = re.compile(rb"[A-Za-z0-9+/_=.-]{16,}")
ASSIGNED = re.compile(rb"[:=][ \t]*[\"']?")
VALUE = re.compile(rb"[^\s\"'`<>{}()\[\],;]+")
PARAMETER = re.compile(rb"&[A-Za-z_][\w.%-]{0,63}=")
NAME = re.compile(rb"(?i)[:=\"' \t]*(?:(?:[a-z0-9]+[_.-]){0,8}(?:token|secret|passw(?:or)?d|pwd|api-?key|auth|bearer|credentials?|key))?[:=\"' \t]*")
TELLING = re.compile(rb"(?i)(token|secret|passw(?:or)?d|pwd|api[_-]?key|apikey|auth|bearer|credential|private[_-]?key|access[_-]?key|key)\W{0,4}$")
NAMED = re.compile(rb"(?i)(token|secret|passw|pwd|api|auth|bearer|credential|private|access|key)")
MOCK = re.compile(rb"(?i)(example|sample|dummy|placeholder|your|test|changeme|xxxx|fake|todo|insert|sha|md5|commit|checksum|digest|uuid|isbn|version)")
EDGE = b"=.-_/+"
#: Words whose letters count as dictionary coverage (with suffix-free matching).
DICTIONARY = sorted("the and for you with this that from have not are was http https www com org net file path name user home data test example sample value string number index config server client request response default module import class function return public static license version document section page image video table column row key token secret password access account address message service system process thread memory cache queue event stream source target input output result error warning info debug build release update delete insert select create remove change tion ing ment able ation".split(), key=lambda w: (-len(w), w))
WORDS = re.compile(b"|".join(w.encode() for w in DICTIONARY))


def _entropy(value: bytes) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _kinds(value: bytes) -> list[int]:
    return [0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 for c in value]


VOWELS = frozenset(b"aeiouyAEIOUY")


def features(value: bytes, before: bytes, after: bytes) -> list[float]:
    n, kinds = len(value), _kinds(value)
    count = Counter(kinds)
    letters = [c in VOWELS for c, k in zip(value, kinds, strict=True) if k < 2]
    low = value.lower()
    covered = sum(len(m) for m in WORDS.findall(low))
    return [
        float(n),
        count[2] / n,
        count[1] / n,
        count[3] / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        sum(a != b for a, b in zip(letters, letters[1:], strict=False)) / max(1, len(letters) - 1),
        sum(letters) / max(1, len(letters)),
        _entropy(value),
        len(set(value)) / n,
        float(all(c in b"0123456789abcdefABCDEF" for c in value)),
        covered / n,
        float(value.count(b"/") + value.count(b".")),
        float(value.count(b"-") + value.count(b"_")),
        float(bool(TELLING.search(before[-24:].rstrip(b" \t\"':=")))),
        float(bool(NAMED.search(before))),
        float(bool(MOCK.search(before)) or bool(MOCK.search(value))),
        float(before.rstrip()[-1:] in (b"=", b":", b'"', b"'")),
        float(after[:1] in (b'"', b"'")),
    ]


def assigned(text: bytes) -> list[tuple[int, int, int]]:
    """Spans of values after a telling name, in order and without overlaps, each with the place of its `=` or `:`."""
    out: list[tuple[int, int, int]] = []
    last = 0  # where the run of value characters last met ends
    for m in ASSIGNED.finditer(text):
        if not TELLING.search(text[max(0, m.start() - 24) : m.start()].rstrip(b" \t\"'")):
            continue
        start = m.end()
        if out and start < out[-1][1]:  # inside a value: a name of its own is cut off, all else belongs to that value
            if m.start() - out[-1][0] <= 100 and out[-1][1] - start >= 6 and NAME.fullmatch(text[out[-1][0] : m.start()]):
                out[-1] = (start, out[-1][1], m.start())
            continue
        if start >= last:
            run = VALUE.match(text, start)
            last = run.end() if run else start
        if last - start < 6:
            continue
        end = last
        if (more := PARAMETER.search(text, start, last)) and more.start() - start >= 6:
            end = more.start()
        if v := text[start:end].rstrip(b".!?"):
            out.append((start, start + len(v), m.start()))
    return out


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte spans, in order, without overlaps; a run is cut where an assigned value and its name meet."""
    values = assigned(text)
    found = [(a, b) for a, b, _ in values]
    at = 0
    for m in RUN.finditer(text):
        while at < len(values) and values[at][1] <= m.start():
            at += 1
        pieces, begin, k = [], m.start(), at
        while k < len(values) and values[k][2] < m.end():
            pieces.append((begin, values[k][2]))
            begin, k = max(begin, values[k][1]), k + 1
        for begin, end in [*pieces, (begin, m.end())]:
            piece = text[begin:end]
            v = piece.strip(EDGE)
            if len(v) >= 16 and (not v.isalpha() or not (v.islower() or v.isupper() or v[1:].islower())):
                start = begin + piece.index(v[:1])
                if any(48 <= c <= 57 for c in v) or not v.islower():
                    found.append((start, start + len(v)))
    return sorted(found)


def context(text: bytes, span: tuple[int, int]) -> tuple[bytes, bytes, bytes]:
    a, b = span
    return text[a:b], text[max(0, a - 40) : a], text[b : b + 16]


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[bytes, bytes, bytes, int]]:
    """(value, before, after, label), made by rule: as many secrets as false findings."""
    r = random.Random(seed)
    hexa, mixed, words = "0123456789abcdef", string.ascii_letters + string.digits, [w for w in DICTIONARY if len(w) > 3]
    syllables = [c + v for c in "bcdfghlmnprstvw" for v in "aeiou"] + ["tion", "ing", "er", "th", "ent", "on", "re"]
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    word = lambda: r.choice(words) if r.random() < 0.4 else "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 6))) + " "
    name = lambda: r.choice(["token", "secret", "password", "api_key", "apikey", "API-KEY", "access_key", "auth_token", "SECRET_KEY", "client_secret", "key", "bearer"])
    uuid = lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
    given = lambda q: r.choice([" = ", "=", ": ", ":"]) + q
    out = []
    for i in range(n):
        q = r.choice(['"', "'", "", '"'])
        if i % 2:
            value = r.choice([
                lambda: pick(hexa, r.choice([32, 40, 40, 40, 64, 24])), lambda: pick(mixed, r.randint(20, 64)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
                lambda: "ghp_" + pick(mixed, 36), lambda: "sk_live_" + pick(mixed, 24), lambda: pick(mixed + "+/", r.randint(30, 60)) + r.choice(["", "=", "=="]),
                lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(mixed, 24), lambda: pick(mixed + "!@#$%^&*", r.randint(10, 24)), lambda: "eyJ" + pick(mixed, 30) + "." + pick(mixed, 40) + "." + pick(mixed, 30), uuid,
            ])()
            before = prose() + (name() + given(q) if r.random() < 0.85 or len(value) < 20 or value.count("-") == 4 else r.choice(["", "use " + q]))
            out.append((value.encode(), before.encode()[-40:], (q + r.choice([" ", "\n", ",", "."]) + prose()).encode()[:16], 1))
        else:
            value = r.choice([
                lambda: "/".join(word() for _ in range(r.randint(3, 6))) + r.choice([".txt", ".html", ".py", "", str(r.randint(1, 99))]), lambda: "_".join(word() for _ in range(r.randint(3, 5))) + str(r.randint(0, 99)), lambda: "".join(word().capitalize() for _ in range(r.randint(3, 6))),
                lambda: "".join(word() for _ in range(r.randint(4, 8))), lambda: "".join(word() for _ in range(r.randint(4, 8))).upper(), lambda: pick(string.digits, r.randint(16, 20)), lambda: r.choice(["x", "0", "1", "-", "a1"]) * r.randint(16, 24), lambda: "your_" + word() + "_key_here", lambda: "example-" + word() + "-" + word(),
                lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}.{r.randint(0, 59):02}", uuid, lambda: word() + str(r.randint(0, 9)) + "." + word() + r.choice([".example.com", ".mail3.example.com"]), lambda: r.choice(["changeme", "password", "12345678", "test1234", "placeholder"]), lambda: "|".join(word() for _ in range(3)),
                lambda: pick(hexa, r.choice([40, 64])),
            ])()
            lead = r.choice(["sha256:", "commit ", "checksum = ", "md5 "] if re.fullmatch("[0-9a-f]{40,64}", value) else ["", "id ", "request "] if re.fullmatch("[0-9a-f-]{36}", value) else ["", "", "", name() + given(q)])
            out.append((value.encode(), (prose() + lead).encode()[-40:], (q + " " + prose()).encode()[:16], 0))
    return out


class Forest:
    """Random forest of two classes: Gini splits at quantiles, a bootstrap and a random third of features a node."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 3) -> None:
        self.trees = []
        for t in range(trees):
            rng = np.random.default_rng((seed, t))
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows].astype(float), depth, leaf, rng, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x, y, depth, leaf, rng, nodes) -> int:
        at = len(nodes)
        nodes.append([-1.0, 0.0, 0.0, 0.0, float(y.mean())])  # feature, cut, left, right, share of the class
        if depth == 0 or len(y) < 2 * leaf or y.min() == y.max():
            return at
        best = (np.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            for c in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 13))):
                left = x[:, f] <= c
                n = int(left.sum())
                if leaf <= n <= len(y) - leaf:
                    p, q = y[left].mean(), y[~left].mean()
                    g = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                    if g < best[0]:
                        best = (g, int(f), float(c))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            a = self._grow(x[left], y[left], depth - 1, leaf, rng, nodes)
            b = self._grow(x[~left], y[~left], depth - 1, leaf, rng, nodes)
            nodes[at][:4] = [best[1], best[2], a, b]
        return at

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := nodes[at, 0] >= 0).any():
                r = rows[inner]
                n = nodes[at[r]]
                at[r] = np.where(x[r, n[:, 0].astype(np.int64)] <= n[:, 1], n[:, 2], n[:, 3]).astype(np.int64)
            total += nodes[at, 4]
        return total / max(1, len(self.trees))


def train(findings: list[tuple[bytes, bytes, bytes, int]] | None = None, limit: int = FINDINGS) -> Forest:
    findings = (labelled_findings(limit) if findings is None else findings)[:limit]
    return Forest(np.array([features(*f[:3]) for f in findings]), np.array([f[3] for f in findings]))


@lru_cache(1)
def default_forest() -> Forest:
    return train()


def judged(texts: list[bytes], forest: Forest, most: int = MOST_AT_ONCE) -> list[list[tuple[int, int, float]]]:
    """For each text its candidates as byte spans with their probabilities; the forest sees at most `most` of them at a time."""
    spans = [(k, s) for k, t in enumerate(texts) for s in candidates(t)]
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    for i in range(0, len(spans), most):
        some = spans[i : i + most]
        p = forest.probability(np.array([features(*context(texts[k], s)) for k, s in some]))
        for (k, (a, b)), x in zip(some, np.round(p, 6).tolist(), strict=True):
            out[k].append((a, b, x))
    return out


def in_chars(text: bytes, spans: list[tuple[int, int, float]]) -> list[dict]:
    """Byte spans, in order, as spans of code points; one pass over the text."""
    out, at, n = [], 0, 0
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80 if spans else None
    for a, b, p in spans:
        start = n + int(np.count_nonzero(lead[at:a]))
        n = start + int(np.count_nonzero(lead[a:b]))
        at = b
        out.append({"start": start, "end": n, "score": p})
    return out


def replaced(text: bytes, spans: list[tuple[int, int, float]], mark: bytes) -> bytes:
    """The text with the mark in place of each span, put together from its pieces."""
    pieces, at = [], 0
    for a, b, _ in spans:
        pieces += [text[at:a], mark]
        at = b
    return b"".join([*pieces, text[at:]])


def scan_documents(docs: DataFrame, forest: Forest | None = None, cut: float = CUT) -> DataFrame:
    """Per row: doc_id, n_candidates, n_secrets, max_score and the spans of the secrets (start, end, score)."""
    tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(forest or default_forest())  # bounded by trees and depth
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = judged(texts, held.value)
        secrets = [in_chars(t, [s for s in x if s[2] >= cut]) for t, x in zip(texts, found, strict=True)]
        return record(doc_id=batch.column(0), n_candidates=pa.array(map(len, found), pa.int64()), n_secrets=pa.array(map(len, secrets), pa.int64()), max_score=pa.array([max((p for _, _, p in x), default=0.0) for x in found], pa.float64()), secrets=pa.array(secrets, pa.list_(span)))

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), run, "doc_id long, n_candidates long, n_secrets long, max_score double, secrets array<struct<start:long,end:long,score:double>>")


def redact(docs: DataFrame, forest: Forest | None = None, cut: float = CUT, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in `text` replaced by the mark; null texts stay null, other columns stay."""
    tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(forest or default_forest())

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        texts = [None if t is None else t.encode() for t in s]
        found = judged([t or b"" for t in texts], held.value)
        out = [None if t is None else replaced(t, [s for s in x if s[2] >= cut], mark.encode()).decode("utf-8", "replace") for t, x in zip(texts, found, strict=True)]
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", clean(F.col("text").cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: secrets are replaced, no document goes."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
