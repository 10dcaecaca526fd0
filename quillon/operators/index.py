"""Building and checking inverted lists, codebooks and rotations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec
from .matrix import best, held, ready


def assign(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """Tokens with the centroid of the largest inner product (cid), ties to the lesser id."""
    keys = [c for c in tokens.columns if c != "emb"]
    return best(tokens, keys, "emb", centroids, "cid", "emb", 1).select(*keys, "cid")


def plain_ivf(codes: DataFrame) -> DataFrame:
    """One posting for each centroid and passage."""
    return codes.select("cid", "pid").distinct()


def token_ivf(codes: DataFrame) -> DataFrame:
    """One posting for each token."""
    return codes.select("cid", "tok_id", "pid")


def passage_of(tokens: DataFrame, starts: DataFrame, block: int = 1_000_000) -> DataFrame:
    """tok_id -> pid of the last passage that starts at or before it (starts: tok_id, pid).

    As-of by a running maximum in two steps: within a block of ids, then over
    the blocks, whose last starts are carried on.
    """
    both = starts.select("tok_id", "pid", F.lit(0).alias("kind")).unionByName(tokens.select("tok_id", F.lit(None).cast("long").alias("pid"), F.lit(1).alias("kind")))
    both = both.withColumn("block", F.expr(f"tok_id div {block}"))
    inside = F.last("pid", ignorenulls=True).over(Window.partitionBy("block").orderBy("tok_id", "kind"))
    last = both.groupBy("block").agg(F.max_by("pid", F.when(F.col("kind") == 0, F.col("tok_id"))).alias("last"))
    carried = F.last("last", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    d = both.withColumn("own", inside).where(F.col("kind") == 1).join(last.withColumn("carried", carried), "block")
    return d.select("tok_id", F.coalesce("own", "carried").alias("pid"))


def chunked(lists: DataFrame, most: int, order: list[str]) -> DataFrame:
    """Lists cut into runs of at most ``most`` postings: the run's number is eid."""
    rn = F.row_number().over(Window.partitionBy("cid").orderBy(*order))
    return lists.withColumn("eid", F.floor((rn - 1) / most).cast("int"))


def grouped(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Compressed rows: the sorted passages of each key, and how many."""
    return lists.groupBy(*keys).agg(F.sort_array(F.collect_list("pid")).alias("pids"), F.count("*").alias("length"))


def block_sums(lengths: DataFrame, block: int = 128) -> DataFrame:
    """list_id, length -> where each list starts, and the postings before its block.

    Prefix sums in two steps: within a block, then over the blocks.
    """
    d = lengths.withColumn("block", F.expr(f"list_id div {block}"))
    sums = d.groupBy("block").agg(F.sum("length").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("length").over(Window.partitionBy("block").orderBy("list_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("inside", inside).join(sums.withColumn("before", before), "block")
    return d.select("list_id", "length", "block", F.col("before").alias("block_start"), (F.col("before") + F.col("inside")).alias("start"))


def real_tokens(stored: int, wanted: int, pad: int = 512) -> int:
    """Stored tokens may end with one pad block, which doesn't count; anything else is an error."""
    if stored not in (wanted, wanted + pad):
        raise ValueError(f"{stored} tokens are stored, {wanted} or {wanted + pad} were expected")
    return wanted


def energies(emb: Column, subspaces: int, width: int) -> Column:
    """Squared length of each slice."""
    return F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda s: vec.dot(F.slice(emb, s * width + 1, F.lit(width)), F.slice(emb, s * width + 1, F.lit(width))))


def top_subspaces(tokens: DataFrame, subspaces: int, width: int, m: int) -> DataFrame:
    """The ``m`` slices of most energy of each token, ties to the lesser: keys, s."""
    keys = [c for c in tokens.columns if c != "emb"]
    d = tokens.select(*keys, F.posexplode(energies(F.col("emb"), subspaces, width)).alias("s", "energy"))
    rk = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("energy", 9)), "s"))
    return d.withColumn("rk", rk).where(F.col("rk") <= m).drop("rk")


def nearest_codeword(slices: DataFrame, codewords: DataFrame) -> DataFrame:
    """slices (keys, s, x) with the eid of the nearest codeword of their subspace, and d2."""
    from .codebook import nearest as found

    return found(slices, codewords)


def nearest(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``points`` (keys, emb) with the nearest centre (cid), ties to the lesser id, and the squared distance, 0 at least.

    The nearest centre c has the largest x.c - c.c/2: an inner product with a
    vector that is one longer.
    """
    half = vec.dot(F.col("emb"), F.col("emb")) / -2.0
    longer = points.withColumn("_x", F.concat("emb", F.array(F.lit(1.0))))
    d = best(longer.withColumn("_n", vec.dot(F.col("emb"), F.col("emb"))), [*points.columns, "_n"], "_x", centers.select("cid", F.concat("emb", F.array(half)).alias("_c")), "cid", "_c", 1)
    return d.select(*points.columns, "cid", F.greatest(F.col("_n") - 2 * F.col("score"), F.lit(0.0)).alias("d2"))


def lloyd_step(points: DataFrame, centers: DataFrame) -> DataFrame:
    """One step of k-means: cid, mean of its points (cid, center ARRAY)."""
    dims = nearest(points.select("emb"), centers).select("cid", F.posexplode("emb").alias("dim", "x")).groupBy("cid", "dim").agg(F.avg("x").alias("x"))
    return dims.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("emb"))


def kmeans(points: DataFrame, k: int, iterations: int = 25, sample: int = 200_000, seed: int = 0) -> np.ndarray:
    """Centres of a bounded sample: k-means++ start, Lloyd steps, empty clusters to the worst-fitted points."""
    rows = points.select("emb").orderBy(F.xxhash64("emb")).limit(sample).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    if len(x) < k:
        raise ValueError(f"{len(x)} points for {k} centres")
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        d = ((x[:, None, :] - c[None, -1:, :]) ** 2).sum(axis=2).min(axis=1)
        far = d if len(c) == 1 else np.minimum(far, d)  # noqa: F821
        total = far.sum()
        c = np.vstack([c, x[rng.choice(len(x), p=far / total) if total > 0 else rng.integers(len(x))]])
    for _ in range(iterations):
        d = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]
        at, off = d.argmin(axis=1), np.maximum(d.min(axis=1), 0)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        new[empty] = x[np.argsort(-off)[: len(empty)]]
        if np.allclose(new, c):
            break
        c = new
    return c


def rotation(centroids: DataFrame, dims: int) -> np.ndarray:
    """The top right singular vectors of the centred centroids, a column each (where they span less, any directions beyond)."""
    _, m = held(centroids, "cid", "emb")
    c = m - m.mean(axis=0)
    return np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :dims]


def projected(tokens: DataFrame, r: np.ndarray) -> DataFrame:
    """``tokens`` (keys, emb) with emb @ ``r``, a column of ``r`` a dimension."""
    ready(tokens.sparkSession)

    @F.pandas_udf("array<double>")
    def turned(emb):
        import pandas as pd

        return pd.Series(list(np.array(emb.tolist(), dtype=np.float64).reshape(len(emb), len(r)) @ r))

    return tokens.withColumn("emb", turned("emb"))


def rotated(tokens: DataFrame, r: np.ndarray) -> DataFrame:
    """``tokens`` turned by ``r`` and scaled to length one again."""
    return projected(tokens, r).withColumn("emb", vec.normalized(F.col("emb")))


def fingerprint(r: np.ndarray) -> str:
    import hashlib

    return hashlib.sha256(np.ascontiguousarray(r, dtype="<f4").tobytes()).hexdigest()


def compatible(book: dict, index: dict) -> None:
    """An index fits a codebook of the same rotation, number of entries and slices kept."""
    for k in ("rotation", "entries", "top_m"):
        if book.get(k) != index.get(k):
            raise ValueError(f"{k}: {book.get(k)} in the codebook, {index.get(k)} in the index")


def train_codebooks(slices: DataFrame, entries: int, iterations: int = 10, sample: int = 20_000) -> DataFrame:
    """A codebook for each subspace (s, x) -> (s, eid, w), each from a bounded sample."""
    ready(slices.sparkSession)
    rk = F.row_number().over(Window.partitionBy("s").orderBy(F.xxhash64("x")))
    some = slices.withColumn("_rk", rk).where(F.col("_rk") <= sample).drop("_rk")

    def fit(pdf):
        import pandas as pd

        x = np.array(pdf["x"].tolist(), dtype=np.float64)
        x = x[np.lexsort(x.T)]  # the same books from any layout
        rng = np.random.default_rng(int(pdf["s"].iloc[0]))
        c = x[rng.permutation(len(x))[:entries]]
        for _ in range(iterations):
            at = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(len(c))])
        return pd.DataFrame({"s": int(pdf["s"].iloc[0]), "eid": np.arange(len(c)), "w": list(c)})

    return some.groupBy("s").applyInPandas(fit, "s int, eid int, w array<double>")


def codebook_error(slices: DataFrame, codewords: DataFrame) -> DataFrame:
    """Mean squared and relative error of each subspace's codebook."""
    d = nearest_codeword(slices.withColumn("n2", vec.dot(F.col("x"), F.col("x"))), codewords)
    return d.groupBy("s").agg(F.avg("d2").alias("mse"), (F.sum("d2") / F.sum("n2")).alias("rel_err"))


def checked(lists: DataFrame, passages: DataFrame, keys: list[str]) -> DataFrame:
    """One row of facts about an index, each true when it holds."""
    sizes = lists.groupBy(*keys).agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))  # a row for each list
    sizes = sizes.withColumn("start", F.coalesce(start, F.lit(0)))
    steps = F.col("start") + F.col("n") == F.coalesce(F.lead("start").over(Window.orderBy(*keys)), F.lit(lists.count()))
    a = sizes.withColumn("step", steps).agg(F.sum("n").alias("postings"), F.min("n").alias("least"), F.count("*").alias("lists"), F.min("step").alias("starts_follow"))
    b = lists.agg(F.max("pid").alias("last"), F.min("pid").alias("first"), F.countDistinct("pid").alias("seen"), F.avg((F.col("pid") >= 1 << 22).cast("int")).alias("wide_ids"))
    c = passages.agg(F.countDistinct("pid").alias("passages"), F.max("pid").alias("last_pid"))
    one = a.join(F.broadcast(b)).join(F.broadcast(c))  # a row each
    return one.select("postings", "lists", (F.col("least") > 0).alias("no_empty_list"), "starts_follow", "wide_ids", (F.col("first") >= 0).alias("ids_from_zero"), (F.col("last") == F.col("last_pid")).alias("last_id_fits"), (F.col("seen") == F.col("passages")).alias("all_passages_seen"))
