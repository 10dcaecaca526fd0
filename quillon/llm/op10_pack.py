"""Packing along a space-filling curve.

Every document is tokenised; its tokens, hashed to ``BUCKETS`` signed counts
and scaled to length one, are projected to ``DIMS`` numbers, whose cells of a
grid give a Hilbert key.  Documents are range-sorted by key, equal keys by a
hash of the id (so a large group of copies spans ranges), and their tokens,
laid end to end along the curve, are cut into full sequences.  Only the last
sequence of a range is padded; a range holds about ``RANGE_TOKENS`` tokens.

Tokenised documents are written once (two bytes a token) and read for the range
bounds, without the tokens, and for packing.

Tokenising: a space between two characters that aren't white space always
starts a new pre-token of this vocabulary, so the text is cut there and each
worker keeps the ids of what it has seen (``KEPT`` entries at most).  Texts
that hold a special token's string go whole to the ``tokenizers`` library.

Defined results: a null text is empty; every document ends with id 0, so an
empty one has one token.  Repeated rows are packed one by one.  A null id sorts
first among equal keys.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import env_path, mixed, ready, spread, stored, table, text_or_empty

LENGTH = 1024
BUCKETS = 256
DIMS, BITS = 4, 10
RANGE_TOKENS = 4_000_000
RANGES = 20_000
KEPT = 1_000_000
END = 0
_RARE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_MADE: dict = {}


def _simple(text: str) -> bool:
    """Every space stands between two characters that aren't white space."""
    if text[0] == " " or text[-1] == " " or "  " in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return False
    if any(c in text and (f" {c}" in text or f"{c} " in text) for c in "\t\n\x0b\x0c\r"):
        return False
    return text.isascii() or not _RARE.search(text)


class _Kept(dict):
    """Ids of pieces that follow a space, as bytes; learnt on demand."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        got = _bytes(self.encode(" " + piece))
        if len(piece) <= 64:
            self[piece] = got
        return got


def _bytes(ids: list[int]) -> bytes:
    a = array("H", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Ids:
    """Ids of the public byte-level vocabulary, as little-endian 16-bit bytes."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.kept = _Kept(self.fast)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return _bytes(self.whole.encode(text, add_special_tokens=False).ids)
        parts = text.split(" ") if _simple(text) else _SAFE.split(text)
        if len(self.kept) > KEPT:
            self.kept.clear()
        return _bytes(self.fast(parts[0])) + b"".join(map(self.kept.__getitem__, parts[1:]))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of integer points, a row each (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curve:
    """Token ids to a Hilbert key."""

    def __init__(self, vocab: int = 1 << 16):
        h = mixed(np.arange(vocab))
        self.bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        self.plane = np.where(spread(BUCKETS * DIMS) >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, DIMS)

    def keys(self, docs: list[np.ndarray]) -> np.ndarray:
        v = np.array([np.bincount(self.bucket[d], weights=self.sign[d], minlength=BUCKETS) for d in docs]).reshape(len(docs), BUCKETS)
        v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
        top = (1 << BITS) - 1
        return hilbert(np.clip(np.rint((v @ self.plane + 3) / 6 * top), 0, top), BITS)


def tokenised(docs: DataFrame, paths: tuple[str, str, str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n (tokens with the end id) and ids (16-bit) of every document."""
    ready(docs.sparkSession)

    def run(batches):
        if paths not in _MADE:
            _MADE[paths] = (Ids(*paths), Curve())
        ids, curve = _MADE[paths]
        end = np.array([END], dtype="<u2").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [ids.encode(t.as_py()) + end for t in part.column(1)]
                keys = curve.keys([np.frombuffer(g, dtype="<u2") for g in got])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.int64()), pa.array([len(g) // 2 for g in got], pa.int64()), pa.array(got, pa.binary())], ["doc_id", "key", "n", "ids"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, key long, n long, ids binary")
    # Below the key, bits of the id's hash: copies have one key and yet a place each.
    return d.withColumn("key", F.shiftleft("key", 20) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _packer(length: int):
    def run(batches):
        now, filled, seq = None, 0, 0
        for b in batches:
            out = []
            for r, i, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if r != now:
                    now, filled, seq = r, 0, r << 40
                a = np.frombuffer(ids.as_py(), dtype="<u2").astype("<u4")
                start = 0
                while start < len(a):
                    n = min(length - filled, len(a) - start)
                    out.append((i, start, n, zlib.crc32(a[start : start + n].tobytes()), len(a), seq, filled))
                    start, filled = start + n, filled + n
                    if filled == length:
                        filled, seq = 0, seq + 1
            cols = list(zip(*out, strict=True)) or [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _NAMES)

    return run


def pack(docs: DataFrame, paths: tuple[str, str, str], *, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents in sequences of at most ``length`` tokens."""
    made = stored(tokenised(docs, paths), "pack")
    total = made.agg(F.sum("n")).first()[0] or 0
    ranges = min(RANGES, total // RANGE_TOKENS + 1)
    cuts: list[int] = []
    if ranges > 1:
        cuts = sorted(set(made.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []))
    edges = np.array(cuts, dtype=np.int64)

    @F.pandas_udf(T.LongType())
    def range_of(x):
        import pandas as pd

        return pd.Series(np.searchsorted(edges, x.to_numpy(dtype=np.int64), side="right").astype(np.int64))

    ordered = made.withColumn("range", range_of("key")).repartition("range").sortWithinPartitions("range", "key", "doc_id", "ids")
    return ordered.select("range", "doc_id", "ids").mapInArrow(_packer(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def public_paths() -> tuple[str, str, str]:
    import public_tokenizers as p

    return env_path("QUILLON_BPE_JSON", p.path("byte_bpe_50k.json")), env_path("QUILLON_BPE_RANKS", p.path("byte_bpe_50k.tiktoken")), p.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_paths())
