"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features of a text are the set of its words, pairs of neighbours and pairs with
one word between, and the beginnings of longer words (so an unseen ending
doesn't hide a known stem), each hashed to one of 2^``BITS`` places.  FTRL keeps for each
coordinate its own rate and, by its L1 term, most weights at exactly zero, so
the model is a short list of (place, weight) that fits any broadcast.

The fit takes at most ``ROWS`` labelled documents (those of the least id
hashes; see ``labelled_sample``), in one task, in the order of those hashes;
scoring takes every document, whole.  Neither lang, source, id nor labels are
inputs of a score.

Defined results: null and empty texts get the bias alone.  Without any label
every score is 0.5.  Each row of the table gives one row.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, mixed, ready, table, text_or_empty

BITS = 20
ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
POSITIVE = 2.0  # the weight of a document with label 1
BEGINNINGS = (4, 5, 7)
KEPT = 300_000
_WORDS = re.compile(r"\w+")


class _Hashes(dict):
    """Of each word, its hash and those of its beginnings (0 where it has none), as bytes."""

    def __missing__(self, w: str) -> bytes:
        from xxhash import xxh64_intdigest as digest

        h = struct.pack(f"<{1 + len(BEGINNINGS)}Q", digest(w), *(digest("^" + w[:k]) if len(w) > k else 0 for k in BEGINNINGS))
        if len(self) >= KEPT:
            self.clear()
        if len(w) <= 64:
            self[w] = h
        return h


_SEEN = _Hashes()


def places(text: str) -> np.ndarray:
    """The hashed features of a text, repeats included."""
    words = _WORDS.findall(text.lower())
    each = np.frombuffer(b"".join(map(_SEEN.__getitem__, words)), dtype="<u8").reshape(len(words), 1 + len(BEGINNINGS))
    h, parts = each[:, 0], each[:, 1:].ravel()
    with np.errstate(over="ignore"):
        found = [h, h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:], h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[2:] ^ np.uint64(0x165667B19E3779F9)), parts[parts != 0]]
    return (mixed(np.concatenate(found)) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Logistic regression on sets of places, learnt one document at a time."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0.0
        w[-1] = -z[-1] * ALPHA / (BETA + np.sqrt(n[-1]))  # the bias has no penalty
        return w

    def learn(self, at: np.ndarray, y: int) -> None:
        """``at`` ends with the place of the bias."""
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (POSITIVE if y else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.append(np.flatnonzero(np.abs(self.z[:-1]) > L1), 1 << BITS)
        return at, self.weights(at)


def fit(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights, the last of them the bias, from (doc_id, text, y)."""
    spark = ready(sample.sparkSession)

    def run(batches):
        docs = [(np.append(np.unique(places(t.as_py())), 1 << BITS), y) for b in batches for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True)]
        if not docs:
            return
        model = Ftrl()
        for _ in range(EPOCHS):
            for at, y in docs:
                model.learn(at, y)
        at, w = model.sparse()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "w"])

    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "y")
    got = one.mapInArrow(run, "at long, w double").collect()  # the nonzero weights
    del spark
    if not got:
        return np.array([1 << BITS]), np.array([0.0])
    return np.array([r.at for r in got]), np.array([r.w for r in got])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        at, w = sent.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = w
        for b in batches:
            out = []
            for t in b.column(2):
                p = places(t.as_py())
                hit = p[dense[p] != 0]
                out.append(dense[-1] + dense[np.unique(hit)].sum())
            s = 1.0 / (1.0 + np.exp(-np.clip(np.array(out), -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", ROWS)))
