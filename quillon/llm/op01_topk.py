"""Exact top-k search by distributed histogram selection.

Every (query, vector) score is computed, but only histograms of scores leave a
task.  A few rounds narrow, for each query, the score range that holds its kth
value; a last pass emits the scores at or above it, and of the ties at the kth
value no more than are needed, by smallest id.  Scores are recomputed in each
round: a matrix product is far cheaper than shuffling or storing scores.

Queries are read in chunks of at most ``CHUNK`` rows (the bound of what is
broadcast and of what a round returns to the driver); each chunk meets all
vectors in blocks of at most ``CELLS`` scores, and its answers are written
before the next one starts, so neither plans nor broadcasts add up.

Defined results: vectors that are null or hold null or non-finite components,
and rows with a null id, take no part.  An empty vector has score 0 with other
empty ones.  Vectors of different lengths have no score.  Scores are
the true integers; vectors whose lengths allow one of 2^62 or more are an
error, since it may not fit the column.  Repeated ids: each row is a query and a
candidate of its own, but never a candidate of its own id.  Empty tables give
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ready, stored, table

CHUNK = 4096
BINS = 256
CELLS = 2_000_000
LIMIT = float(1 << 62)


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("vec")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & v.isNotNull()).where(ok)


def _scaled(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(x * scale)


def _matrices(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of each batch and vector length."""
    for b in batches:
        ids, vecs = b.column(0).to_numpy(), b.column(1)
        ends = vecs.offsets.to_numpy()
        flat, lens = vecs.values.to_numpy(zero_copy_only=False), np.diff(ends)
        for d in np.unique(lens):
            at = np.flatnonzero(lens == d)
            take = ends[at][:, None] + np.arange(d)[None, :]
            yield ids[at], _scaled(flat[take], scale)


class _Chunk:
    """Queries of one vector length each, with the range that holds their kth score."""

    def __init__(self, ids: np.ndarray, groups: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.ids, self.groups = ids, groups  # length -> (positions in ids, matrix)

    def scores(self, ids: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, ids, scores, which scores count), in blocks."""
        if m.shape[1] not in self.groups:
            return
        at, q = self.groups[m.shape[1]]
        exact = (np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * max(1, m.shape[1])) < 2**52
        step = max(1, CELLS // max(1, len(q)))
        for i in range(0, len(m), step):
            part, own = m[i : i + step], ids[i : i + step]
            s = np.rint(q @ part.T).astype(np.int64) if exact else q.astype(np.int64) @ part.T.astype(np.int64)
            yield at, own, s, self.ids[at][:, None] != own[None, :]


def _histograms(chunk, lo, width, hi, scale):
    def run(batches):
        c, low, w, high = chunk.value, lo, width, hi
        hist = np.zeros((len(c.ids), BINS), dtype=np.int64)
        for ids, m in _matrices(batches, scale):
            for at, _, s, counts in c.scores(ids, m):
                inside = counts & (s >= low[at][:, None]) & (s <= high[at][:, None])
                r, k = np.nonzero(inside)
                bins = (s[r, k] - low[at][r]) // w[at][r]
                np.add.at(hist, (at[r], bins), 1) if len(r) < 1000 else hist.__iadd__(np.bincount(at[r] * BINS + bins, minlength=hist.size).reshape(hist.shape))
        q, b = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(hist[q, b], pa.int64())], ["q", "bin", "n"])

    return run


def _winners(chunk, floor, k, scale):
    def kept(q, s, v):
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        first = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        return q[rank < k], s[rank < k], v[rank < k]

    def run(batches):
        c = chunk.value
        q, s, v = (np.zeros(0, np.int64) for _ in range(3))
        for ids, m in _matrices(batches, scale):
            for at, own, score, counts in c.scores(ids, m):
                r, j = np.nonzero(counts & (score >= floor[at][:, None]))
                q, s, v = kept(np.r_[q, at[r]], np.r_[s, score[r, j]], np.r_[v, own[j]])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, c.ids[q], v, s)], ["q", "query_id", "vec_id", "score"])

    return run


def _largest_norm(scale):
    def run(batches):
        best: dict[int, float] = {}
        for _, m in _matrices(batches, scale):
            best[m.shape[1]] = max(best.get(m.shape[1], 0.0), float(np.sqrt((m * m).sum(axis=1)).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.float64())], ["d", "norm"])

    return run


def _chunks(queries: DataFrame, scale: float, size: int) -> Iterator[_Chunk]:
    held: list = []

    def made(rows):
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        lens = np.array([len(r[1]) for r in rows])
        return _Chunk(ids, {int(d): (at := np.flatnonzero(lens == d), _scaled(np.array([rows[i][1] for i in at], dtype=np.float64).reshape(len(at), d), scale)) for d in np.unique(lens)})

    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield made(held)
            held = []
    if held:
        yield made(held)


def topk(queries: DataFrame, vectors: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, chunk: int = CHUNK) -> DataFrame:
    """The ``k`` highest integer inner products of every query row, ties to smaller ids."""
    spark = ready(vectors.sparkSession)
    rows = _usable(vectors, id_col, vec_col)
    norms = {r.d: r.norm for r in rows.mapInArrow(_largest_norm(scale), "d int, norm double").groupBy("d").agg(F.max("norm").alias("norm")).collect()}
    kind, found = "query_id long, rank int, vec_id long, score long", []
    for part in _chunks(_usable(queries, id_col, vec_col), scale, chunk):
        n = len(part.ids)
        hi = np.zeros(n, np.int64)
        for d, (at, q) in part.groups.items():
            own = np.sqrt((q * q).sum(axis=1))
            most = np.multiply(own, norms.get(d, 0.0) * (1 + 1e-9), out=np.zeros(len(own)), where=own > 0)
            if (most >= LIMIT).any():
                raise ValueError("vectors are so long that a score may not fit 64 bits")
            hi[at] = np.ceil(most).astype(np.int64) + 1
        lo, above, floor, open_ = -hi, np.zeros(n, np.int64), -hi, np.ones(n, bool)
        sent = spark.sparkContext.broadcast(part)
        while open_.any():
            top = np.where(open_, hi, lo - 1)  # nothing is counted for a query that is settled
            width = np.maximum(1, -(-(hi - lo + 1) // BINS))
            counts = rows.mapInArrow(_histograms(sent, lo, width, top, scale), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            start = spark.createDataFrame([(int(i), int(above[i])) for i in np.flatnonzero(open_)], "q int, above long")
            w = Window.partitionBy("q").orderBy(F.desc("bin"))
            hit = (
                counts.join(F.broadcast(start), "q")  # at most ``chunk`` rows
                .withColumn("upto", F.col("above") + F.sum("n").over(w))
                .where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
                .select("q", "bin", "n", "upto").collect()
            )
            seen = np.zeros(n, bool)
            for q, b, inside, upto in hit:
                seen[q] = True
                lo[q], hi[q] = lo[q] + b * width[q], min(hi[q], lo[q] + (b + 1) * width[q] - 1)
                above[q], floor[q] = upto - inside, lo[q]
                open_[q] = hi[q] > lo[q] and upto > 4 * k  # a range that holds few scores needs no more rounds
            open_ &= seen  # fewer than k candidates: all of them are wanted
        best = rows.mapInArrow(_winners(sent, floor, k, scale), "q long, query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        found.append(stored(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk")._stored_at)
        sent.destroy()
    return spark.read.schema(kind).parquet(*found) if found else spark.createDataFrame([], kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return topk(e.where(F.col("vec_id") % 50 == 0), e, 5)


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0
), t AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
