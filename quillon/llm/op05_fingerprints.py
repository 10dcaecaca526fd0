"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes decides where a text is cut.  Cutting is
normalised: from ``LEAST`` to ``NORMAL`` bytes after the last cut a strict mask
must be zero, from there a loose one, and at ``MOST`` bytes there is a cut in
any case.  A fingerprint is the sorted set of the chunks' digests with their
lengths, ``PAIR`` hexadecimal digits each (12 of digest, 2 of length), so an
insertion changes only the chunks around it.  ``likeness`` of two fingerprints
is containment: the share of the first one's bytes that lie in chunks the other
has too.

The next document in ascending id comes from a sort in range buckets: the texts
are shuffled once, and the first document of each bucket also goes to the
bucket before it, the very first to the last one.

Defined results: null texts are empty, with the empty fingerprint; it is like
itself (1) and nothing else (0).  Null ids come first; equal ids are ordered by
text.  A lone document is followed by itself.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready, spread, table, text_or_empty

LEAST, NORMAL, MOST = 16, 64, 255
STRICT, LOOSE = 7, 5  # bits that must be zero
WINDOW = 32
BUCKET_ROWS = 5000
BUCKETS = 20_000
GROUP_BYTES = 1 << 20
GEAR = np.concatenate([[0], (spread(255) >> np.uint64(32))]).astype(np.uint32)


def _hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: sum of GEAR[byte k back] << k, in log steps."""
    h, k = GEAR[data], 1
    while k < WINDOW:
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h, k = h + shifted, 2 * k
    return h


def chunk_sets(texts: list[bytes]) -> list[list[int]]:
    """The sorted set of (digest << 8 | length) of each text's chunks."""
    import xxhash

    pad = b"\0" * WINDOW
    data = np.frombuffer(pad + pad.join(texts), dtype=np.uint8)
    h = _hashes(data)
    loose = np.flatnonzero((h >> np.uint32(32 - LOOSE)) == 0)
    strict = loose[(h[loose] >> np.uint32(32 - STRICT)) == 0].tolist()
    loose = loose.tolist()
    strict.append(1 << 62)
    loose.append(1 << 62)
    digest, out, base = xxhash.xxh64_intdigest, [], WINDOW
    for t in texts:
        n, at, found = len(t), 0, set()
        while at < n:
            # The cut is after the byte whose hash fits.
            cut = strict[bisect_left(strict, base + at + LEAST - 1)] - base + 1
            if cut > at + NORMAL:
                cut = min(loose[bisect_left(loose, base + at + NORMAL - 1)] - base + 1, at + MOST)
            cut = min(cut, n)
            found.add((digest(t[at:cut]) >> 16) << 8 | (cut - at))
            at = cut
        out.append(sorted(found))
        base += n + WINDOW
    return out


def written(chunks: list[int]) -> str:
    return "".join(["%014x" % c for c in chunks])


def read(fingerprint: str) -> list[int]:
    return [int(fingerprint[i : i + 14], 16) for i in range(0, len(fingerprint), 14)]


def likeness(a: list[int], b: list[int]) -> float:
    """The share of a's bytes in chunks of b."""
    total = sum(c & 255 for c in a)
    if not total:
        return 1.0 if not b else 0.0
    return sum(c & 255 for c in set(a).intersection(b)) / total


def edited(text: str, following: str) -> str:
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, tail, doc_id, text), sorted in buckets; tails are the first document of what follows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n = ids.count()
    buckets = min(BUCKETS, n // BUCKET_ROWS + 1)
    cuts: list[int] = []
    if buckets > 1:
        cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []))
    edges = np.array(cuts, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def bucket_of(x):
        import pandas as pd

        return pd.Series(np.searchsorted(edges, x.fillna(-(1 << 63)).to_numpy(dtype=np.int64), side="right").astype(np.int32))

    key = F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id")
    firsts = sorted((r.bucket, r.first.doc_id) for r in ids.withColumn("bucket", bucket_of("doc_id")).groupBy("bucket").agg(F.min(key).alias("first")).collect())
    # At most BUCKETS rows.
    to = docs.sparkSession.createDataFrame([(b, i, firsts[k - 1][0]) for k, (b, i) in enumerate(firsts)], "bucket int, first_id long, before int")
    own = F.struct("bucket", F.lit(0).alias("tail"))
    more = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.array(own, more)).otherwise(F.array(own))
    return (
        rows.withColumn("bucket", bucket_of("doc_id")).join(F.broadcast(to), "bucket")
        .withColumn("place", F.explode(places)).select("place.bucket", "place.tail", "doc_id", "text")
        .repartition("bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")
    )


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _prints(batches):
    """Rows of a bucket come in order; each is answered when the next is known."""
    held: tuple | None = None  # (bucket, id, text, chunks)
    group: list[tuple] = []
    size = 0

    def answered():
        # A row's next stands after it in the group; tails and the last row of the group get no answer here.
        pairs = [(i, i + 1) for i in range(len(group) - 1) if group[i][0] == group[i + 1][0] and not group[i][1]]
        new = [edited(group[i][3], group[j][3]).encode() for i, j in pairs]
        fresh = [i for i, g in enumerate(group) if g[4] is None]
        made = chunk_sets([group[i][3].encode() for i in fresh] + new)
        sets = [g[4] for g in group]
        for i, c in zip(fresh, made, strict=False):
            sets[i] = c
        out = []
        for (i, j), text, c in zip(pairs, new, made[len(fresh) :], strict=True):
            out.append((group[i][2], len(group[i][3]), hashlib.sha256(text).hexdigest(), written(sets[i]), written(c), likeness(sets[i], c), likeness(sets[i], sets[j])))
        last = group[-1]
        cols = list(zip(*out, strict=True)) or [[]] * len(_NAMES)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _NAMES), (*last[:4], sets[-1])

    for b in batches:
        buckets, tails, ids = (b.column(i).to_pylist() for i in range(3))
        for bucket, tail, i, t in zip(buckets, tails, ids, b.column(3), strict=True):
            if tail and group and group[-1][0] == bucket and group[-1][1]:
                continue  # a repeated id: the first of them is the next document
            t = t.as_py()
            group.append((bucket, tail, i, t, None))
            size += len(t)
            if size >= GROUP_BYTES:
                done, held = answered()
                yield done
                group, size = [held], 0
    if group:
        yield answered()[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    ready(docs.sparkSession)
    return followed(docs).mapInArrow(_prints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
