"""Diagnostics of candidate generation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from .matrix import best, held_blocks, ready


def shortlist_recall(queries: DataFrame, points: DataFrame, m: int, k: int, alpha: int, basis: np.ndarray | None = None) -> DataFrame:
    """Per query: how many of the exact top ``k`` are in the top ``alpha * k`` by the first ``m`` dimensions.

    With a ``basis`` (a column a direction, such as principal ones), by its first ``m`` directions.
    """
    if basis is not None:
        from .index import projected

        return _recall(queries, points, projected(queries, basis[:, :m]), projected(points, basis[:, :m]), k, alpha)
    cut = F.slice("emb", 1, m)
    return _recall(queries, points, queries.withColumn("emb", cut), points.withColumn("emb", cut), k, alpha)


def _recall(queries: DataFrame, points: DataFrame, short_queries: DataFrame, short_points: DataFrame, k: int, alpha: int) -> DataFrame:
    exact = best(queries, ["qid"], "emb", points, "pid", "emb", k).select("qid", "pid")
    short = best(short_queries, ["qid"], "emb", short_points, "pid", "emb", alpha * k).select("qid", "pid").withColumn("hit", F.lit(1))
    return exact.join(short, ["qid", "pid"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two encodings (a: qid, key, emb; b: key, emb) of the same tokens: each query's least cosine, and whether none is missing."""
    cos = vec.dot(F.col("emb"), F.col("other")) / F.sqrt(vec.dot(F.col("emb"), F.col("emb")) * vec.dot(F.col("other"), F.col("other")) + 1e-12)
    d = a.join(b.withColumnRenamed("emb", "other"), key, "left")
    return d.groupBy("qid").agg(F.min(cos).alias("least"), (F.count("other") == F.count("*")).alias("same_count"))


def slice_rms(points: DataFrame, subspaces: int, width: int) -> list[float]:
    """Root mean square length of each slice of the points."""
    from .index import energies

    d = points.select(F.posexplode(energies(F.col("emb"), subspaces, width)).alias("s", "e")).groupBy("s").agg(F.sqrt(F.avg("e")).alias("rms"))
    return [r.rms for r in d.orderBy("s").collect()]  # a row for each slice


def slice_hits(queries: DataFrame, points: DataFrame, subspaces: int, width: int, radius2: float | list[float]) -> DataFrame:
    """qid, pid, hits: in how many slices a point lies within the radius (one, or one for each slice) of the query.

    Every point meets every query, as the diagnosis asks: blocks of queries are
    held, points stream.
    """
    spark = ready(points.sparkSession).sparkContext
    most = np.broadcast_to(np.asarray(radius2, dtype=np.float64), subspaces)
    rows, out = points.select(F.col("pid").cast("long").alias("pid"), F.slice("emb", 1, subspaces * width).alias("emb")), None
    for block in held_blocks(queries.select(F.col("qid").cast("long").alias("qid"), F.slice("emb", 1, subspaces * width).alias("emb")), "qid", "emb"):
        sent = spark.broadcast(block)

        def run(batches, sent=sent):
            qids, q = sent.value
            q = q.reshape(len(qids), subspaces, width)
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    part = b.slice(at, 64)
                    p = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, subspaces, width)
                    for i in range(0, len(qids), 1024):
                        hits = np.zeros((part.num_rows, len(qids[i : i + 1024])), np.int32)
                        for s in range(subspaces):
                            d = p[:, None, s, :] - q[None, i : i + 1024, s, :]
                            hits += np.round((d * d).sum(axis=2), 9) <= most[s]
                        n = hits.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.tile(qids[i : i + 1024], part.num_rows), pa.int64()), part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), n))), pa.array(hits.ravel())], ["qid", "pid", "hits"])

        one = rows.mapInArrow(run, "qid long, pid long, hits int")
        out = one if out is None else out.unionByName(one)
    return out


def hit_filter(queries: DataFrame, points: DataFrame, subspaces: int, width: int, radius2: float, truth: DataFrame, least: int) -> DataFrame:
    """Share of (query, point) pairs with ``least`` hits or more, and of the exact answers (truth: qid, pid) among them.

    Pairs are counted where they are made: a task sends a row of counts for each
    batch; the hits of the exact answers are looked at again by themselves.
    """
    spark, out, n = ready(points.sparkSession).sparkContext, None, subspaces * width
    cut = lambda d, k: d.select(F.col(k).cast("long").alias(k), F.slice("emb", 1, n).alias("emb"))
    for block in held_blocks(cut(queries, "qid"), "qid", "emb"):
        sent = spark.broadcast(block[1])

        def run(batches, sent=sent):
            q = sent.value.reshape(-1, subspaces, width)
            off = ((q * q).sum(axis=2) - radius2 - 5e-10) / 2  # nearer by half a billionth still rounds to the radius
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part, on = b.slice(at, 256), 0
                    p = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, subspaces, width)
                    half = (p * p).sum(axis=2) / 2
                    for i in range(0, len(q), 2048):
                        hits = np.zeros((len(q[i : i + 2048]), part.num_rows), np.int16)
                        for s in range(subspaces):
                            left = np.c_[q[i : i + 2048, s], off[i : i + 2048, s], np.ones(len(hits))]
                            hits += left @ np.c_[p[:, s], -np.ones(part.num_rows), -half[:, s]].T >= 0
                        on += int((hits >= least).sum())
                    yield pa.RecordBatch.from_arrays([pa.array([on], pa.int64()), pa.array([part.num_rows * len(q)], pa.int64())], ["yes", "pairs"])

        one = cut(points, "pid").select("emb").mapInArrow(run, "yes long, pairs long")
        out = one if out is None else out.unionByName(one)
    near = F.lit(0)
    for s in range(subspaces):
        near = near + (F.round(vec.l2(F.slice("_q", s * width + 1, width), F.slice("_p", s * width + 1, width)), 9) <= radius2).cast("int")
    t = truth.select("qid", "pid").join(cut(queries, "qid").withColumnRenamed("emb", "_q"), "qid").join(cut(points, "pid").withColumnRenamed("emb", "_p"), "pid")
    recall = t.agg(F.avg((near >= least).cast("int")).alias("recall"))
    return out.agg((F.sum("yes") / F.sum("pairs")).alias("share")).join(F.broadcast(recall))  # a row each


def stage1_recall(exact: DataFrame, got: DataFrame, rays: DataFrame, keys: list[str]) -> DataFrame:
    """Mean share of each ray's exact codewords that were found; a ray without any counts 1."""
    d = exact.join(got.select(*keys, "eid").withColumn("hit", F.lit(1)), [*keys, "eid"], "left")
    per = d.groupBy(*keys).agg((F.count("hit") / F.count("*")).alias("r"))
    return rays.select(*keys).distinct().join(per, keys, "left").agg(F.avg(F.coalesce("r", F.lit(1.0))).alias("recall"))


def selective_lut(pairs: DataFrame, codewords: DataFrame, radius2: float) -> DataFrame:
    """Codewords within the radius of each (query, subspace) residual: the pairs' keys, s, eid, d2."""
    keys = [c for c in pairs.columns if c not in ("s", "x")]
    d = pairs.join(codewords, "s").withColumn("d2", vec.l2(F.col("x"), F.col("w")))
    return d.where(F.round("d2", 9) <= radius2).select(*keys, "s", "eid", "d2")


def radius_of(pairs: DataFrame, codewords: DataFrame, fraction: float) -> DataFrame:
    """s, r2: the squared distance within which ``fraction`` of a subspace's (residual, codeword) pairs lie."""
    d = pairs.join(codewords, "s").withColumn("d2", vec.l2(F.col("x"), F.col("w")))
    return d.groupBy("s").agg(F.expr(f"percentile(d2, {fraction})").alias("r2"))
