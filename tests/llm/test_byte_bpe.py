import hashlib
import random

import public_tokenizers
import pytest

from hearthline.llm.byte_bpe import ByteBPE, decode_documents, digest_documents, encode_documents

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        own = ByteBPE.from_text(f.read(), public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def texts():
    r = random.Random(7)
    out = ["", " ", "a", "a" * 5000, "ab" * 3000, "-=" * 999, "0123456789" * 400, "Größe über naïve 漢字 🙂" * 9, "\x00\n\t \r\n  x", "\x1c\x1d x\x1e\x1f\x85 y\xa0 z", "'s't're hello   world  "]
    for alphabet in ("ab", "abcdefgh", "aeioutnshr", "=-#", "éèüa", " ation", "0123456789"):
        out += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 700))) for _ in range(40)]
    return out


def test_equals_the_library(pair):
    own, library = pair
    for t in texts():
        assert own.encode(t) == library.encode_ordinary(t), t[:80]
        assert own.decode(own.encode(t)) == t.encode()


def test_heap_equals_merge(pair):
    own, _ = pair
    for t in texts():
        if t and len(t) < 800:
            assert own.heap(t.encode()) == own.merge(t.encode())


def test_documents(spark, pair):
    rows = [(i, t, "x") for i, t in enumerate(texts()[:60])] + [(None, None, None), (3, None, "x"), (3, "twice", "x"), (3, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = sorted((i if i is not None else -1, len(x := pair[1].encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in digest_documents(docs).collect()) == want
    back = decode_documents(encode_documents(docs.where("doc_id > 3"))).collect()
    assert {r.doc_id: bytes(r.bytes).decode() for r in back} == {i: t for i, t, _ in rows if i and i > 3}
    assert digest_documents(docs.limit(0)).count() == 0
