"""Byte-level BPE encoding and decoding by monoid tree reduction.

A token list of a byte string is an element of a monoid whose product joins two
lists into the list of the joined string. A piece (one match of the pre-token
pattern) is cut into halves down to short leaves, which are merged directly; two
neighbours are joined by encoding anew a window about their boundary, which
grows until the tokens outside it are proven stable: a list of tokens is the
encoding of its bytes exactly if each adjacent pair is the encoding of its own
bytes, so it is enough that the window's outermost tokens form such pairs with
the tokens beyond. Pieces never merge with each other, so above the pieces the
product is concatenation, and decoding is concatenation all the way up.

Null texts count as empty; empty texts give no token (sha256 of nothing, twice).
Repeated rows, and rows of a null doc_id, give repeated results; an empty table
gives no rows. Ties of rank can't be: of equal pairs the leftmost merges first, as
the vocabulary's rule is. Texts of any length are encoded whole; one piece without
a break takes n log n. Other columns, whatever their names, are left aside.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import by_batch, record, table, tune

LEAF = 24
CACHE = 80_000
#: Fixed value: the pre-token pattern of the vocabulary, and what it amounts to on ASCII without separators 28 to 31.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
CONTROL = re.compile("[\x1c-\x1f]")


class ByteBPE:
    """Ranks of a vocabulary (bytes -> id) and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern, self.none = ranks, regex.compile(pattern), max(ranks.values(), default=0) + 1
        self.plain = re.compile(ASCII_PATTERN) if pattern == PATTERN else None
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.stable = lru_cache(CACHE)(self._stable)
        self.pieces: dict[str, tuple[bytes, int, bytes]] = {}
        self.older: dict[str, tuple[bytes, int, bytes]] = {}

    @classmethod
    def from_text(cls, lines: bytes, pattern: str) -> ByteBPE:
        """From a rank file: base64 of the token's bytes, a space and the id in each line."""
        pairs = (line.split() for line in lines.splitlines() if line.strip())
        return cls({base64.b64decode(a): int(b) for a, b in pairs}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        get, none = self.ranks.get, self.none
        at = list(range(len(piece) + 1))  # where the parts begin
        found = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]  # rank of each part with the next
        while found and (best := min(found)) != none:
            i = found.index(best)
            del at[i + 1], found[i]
            if i < len(found):
                found[i] = get(piece[at[i] : at[i + 2]], none)
            if i:
                found[i - 1] = get(piece[at[i - 1] : at[i + 1]], none)
        return [self.ranks[piece[i:j]] for i, j in zip(at, at[1:], strict=False)]

    def _stable(self, left: int, right: int) -> bool:
        return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The product of two neighbours."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = self.merge(self.decode(left[len(left) - a :] + right[:b])) if a + b < 2 * LEAF else self.tree(self.decode(left[len(left) - a :] + right[:b]), a + b)
            grow_a = a < len(left) and not self.stable(left[len(left) - a - 1], window[0])
            grow_b = b < len(right) and not self.stable(window[-1], right[b])
            if not grow_a and not grow_b:
                return left[: len(left) - a] + window + right[b:]
            a, b = min(len(left), a * 2 if grow_a else a), min(len(right), b * 2 if grow_b else b)

    def tree(self, piece: bytes, _within: int = 0) -> list[int]:
        """Encode one piece: leaves are merged, then joined pairwise level by level."""
        if _within:  # a long window is cut elsewhere than the lists it came from, and merged as a whole
            return self.heap(piece)
        level = [self.merge(piece[i : i + LEAF]) for i in range(0, len(piece), LEAF)] or [[]]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def heap(self, piece: bytes) -> list[int]:
        """merge() in n log n, for long windows: a queue of pairs over a linked list."""
        import heapq

        n = len(piece)
        end, prev, alive = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [True] * n
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                prev[stop] = i
                if (r := self.ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := self.ranks.get(piece[p:stop])) is not None:
                heapq.heappush(queue, (r, p, stop))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.encode_piece(piece.encode())]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self.tree(piece)

    def known(self, piece: str) -> tuple[bytes, int, bytes]:
        """A piece's ids as decimal text, their number, and the bytes decoded from them.

        Those of short pieces are remembered in two generations of CACHE each.
        """
        if (out := self.older.get(piece)) is None:
            ids = self.encode_piece(piece.encode())
            out = (" ".join(map(str, ids)).encode(), len(ids), self.decode(ids))
        if len(piece) <= 4 * LEAF:
            if len(self.pieces) >= CACHE:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = out
        return out

    def split(self, text: str) -> list[str]:
        """The matches of the pattern; of plain ASCII texts by an equal pattern without Unicode classes."""
        if self.plain and text.isascii() and not CONTROL.search(text):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, sha256 of the ids joined by spaces, sha256 of the bytes decoded."""
        get, known = self.pieces.get, self.known
        found = [get(p) or known(p) for p in self.split(text)]
        ids = hashlib.sha256(b" ".join([x[0] for x in found])).hexdigest()
        return sum([x[1] for x in found]), ids, hashlib.sha256(b"".join([x[2] for x in found])).hexdigest()


_made: dict[str, ByteBPE] = {}


def codec(key: str, lines: bytes, pattern: str) -> ByteBPE:
    """One codec for each vocabulary and worker process."""
    if key not in _made:
        _made[key] = ByteBPE.from_text(lines, pattern)
    return _made[key]


def _shared(spark: SparkSession, path: str | None, pattern: str | None):
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        lines = f.read()  # fixed size: the vocabulary
    pattern = pattern or public_tokenizers.PATTERN
    return spark.sparkContext.broadcast(lines), hashlib.md5(lines + pattern.encode()).hexdigest(), pattern


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: the id column and `ids`, the whole text's token ids."""
    lines, key, pattern = _shared(docs.sparkSession, path, pattern)
    tune(docs.sparkSession)
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(key, lines.value, pattern)
        ids = pa.array([c.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
        return record(**{id_column: batch.column(0), "ids": ids})

    return by_batch(docs.select(F.col(id_column), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t")), run, f"`{id_column}` {id_type}, ids array<int>")


def decode_documents(encoded: DataFrame, id_column: str = "doc_id", path: str | None = None) -> DataFrame:
    """Per row: the id column and `bytes`, what the column `ids` decodes to."""
    lines, key, pattern = _shared(encoded.sparkSession, path, None)
    tune(encoded.sparkSession)
    id_type = encoded.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(key, lines.value, pattern)
        out = pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())
        return record(**{id_column: batch.column(0), "bytes": out})

    return by_batch(encoded.select(id_column, "ids"), run, f"`{id_column}` {id_type}, bytes binary")


def digest_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row."""
    lines, key, pattern = _shared(docs.sparkSession, path, pattern)
    tune(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(key, lines.value, pattern)
        n, ids, decoded = zip(*[c.digest(t) for t in batch.column(1).to_pylist()], strict=True)
        return record(doc_id=batch.column(0), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids), decoded_sha256=pa.array(decoded))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return by_batch(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest_documents(docs)
