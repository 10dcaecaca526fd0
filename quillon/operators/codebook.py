"""Codewords of slices: nearest ones, best hits and distances, in Arrow batches.

The books of all slices are held by every task (in blocks, if they are more than
``matrix.MOST_HELD`` numbers); rows stream and none is crossed with a book in a
join, so nothing is shuffled but what leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec
from . import matrix

#: Numbers of a product at a time, rows that wait for a search, codewords of a leaf.
WORK, WAIT, LEAF = 200_000, 65_536, 64


def books(codewords: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """s -> (eids, matrix), eids ascending; one dict, or several that have parts of the words each."""
    n, width = codewords.agg(F.count("*"), F.max(F.size("w"))).first()
    parts = max(1, -(-n * (width or 0) * 5 // (4 * matrix.MOST_HELD))) if n * (width or 0) > matrix.MOST_HELD else 1
    for i in range(parts):
        some = codewords if parts == 1 else codewords.where(F.pmod(F.xxhash64("s", "eid"), F.lit(parts)) == i)
        t = some.select("s", "eid", "w").toArrow().combine_chunks()
        s, eid, w = t.column(0).to_numpy(), t.column(1).to_numpy(), matrix.flat(t.column(2), len(t))
        order = np.lexsort((eid, s))
        yield {int(k): (eid[order[s[order] == k]], w[order[s[order] == k]]) for k in np.unique(s)}


class Tree:
    """Codewords halved along their widest dimension into leaves, for exact nearest neighbours.

    Distances are rounded to nine places, ties go to the lesser eid.
    """

    def __init__(self, eids: np.ndarray, w: np.ndarray):
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(w)) / LEAF))))
        n = (1 << self.depth) - 1
        self.dim, self.cut = np.zeros(n, np.int64), np.zeros(n)
        parts = [np.arange(len(w))]
        for d in range(self.depth):
            halves = []
            for j, at in enumerate(parts):
                k = int(np.ptp(w[at], axis=0).argmax())
                at = at[np.argsort(w[at, k], kind="stable")]
                half = len(at) // 2
                self.dim[(1 << d) - 1 + j], self.cut[(1 << d) - 1 + j] = k, w[at[half], k]
                halves += [at[:half], at[half:]]
            parts = halves
        self.parts = [(eids[np.sort(at)], w[np.sort(at)]) for at in parts]
        self.low = np.array([x.min(axis=0) for _, x in self.parts])
        self.high = np.array([x.max(axis=0) for _, x in self.parts])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(eid, squared distance) of the codeword nearest to each row."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dim[node]] >= self.cut[node])
        leaf = node - ((1 << self.depth) - 1)
        eid, d2 = np.zeros(len(x), np.int64), np.zeros(len(x))
        order = np.argsort(leaf, kind="stable")
        ends = np.flatnonzero(np.diff(leaf[order])) + 1
        for rows in np.split(order, ends) if len(order) else []:
            own, part = int(leaf[rows[0]]), x[rows]
            ids, w = self.parts[own]
            far = np.sqrt(_least(part, w)).max() + 1e-6
            gap = np.maximum(0, np.maximum(self.low - part.max(axis=0), part.min(axis=0) - self.high))
            near = np.flatnonzero((gap * gap).sum(axis=1) <= far * far)
            if len(near) > 1:
                ids, w = (np.concatenate([self.parts[i][j] for i in near]) for j in (0, 1))
            step = max(1, WORK // len(ids))
            for at in range(0, len(rows), step):
                eid[rows[at : at + step]], d2[rows[at : at + step]] = _nearest(part[at : at + step], ids, w)
        return eid, d2


def _least(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    half = (w * w).sum(axis=1) / 2
    step = max(1, WORK // len(w))
    best = np.concatenate([(x[i : i + step] @ w.T - half).max(axis=1) for i in range(0, len(x), step)])
    return np.maximum((x * x).sum(axis=1) - 2 * best, 0)


def _nearest(x: np.ndarray, ids: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = x @ w.T - (w * w).sum(axis=1) / 2
    r, c = np.nonzero(g >= g.max(axis=1)[:, None] - 1e-8)  # whatever rounding could make equal
    d = x[r] - w[c]
    d2 = np.round((d * d).sum(axis=1), 9)
    order = np.lexsort((ids[c], d2, r))
    first = order[np.r_[True, np.diff(r[order]) > 0]] if len(order) else order
    return ids[c[first]], d2[first]


def _dense(x: np.ndarray, w: np.ndarray, k: int | None, places: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, products) of each row's ``k`` largest products with the rows of ``w``, or of all."""
    step = max(1, WORK // len(w))
    for at in range(0, len(x), step):
        h = x[at : at + step] @ w.T
        r, c = np.divmod(np.arange(h.size), h.shape[1]) if k is None else matrix.top(h, k, places)
        yield r + at, c, h[r, c]


def _pruned(x: np.ndarray, tree: Tree, k: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as (rows, eids, products), without leaves whose box bounds their products below a row's k-th best.

    A first bound is the k-th product within the leaf that could hold the largest.
    """
    most = np.maximum(x, 0) @ tree.high.T + np.minimum(x, 0) @ tree.low.T
    own, slack = most.argmax(axis=1), 2.0 * 10.0**-places
    bound = np.empty(len(x))
    for i in np.unique(own):
        at = np.flatnonzero(own == i)
        h = x[at] @ tree.parts[i][1].T
        bound[at] = np.partition(h, h.shape[1] - k, axis=1)[:, h.shape[1] - k]
    near = most >= (bound - slack)[:, None]
    found = []
    for i in np.flatnonzero(near.any(axis=0)):
        at = np.flatnonzero(near[:, i])
        h = x[at] @ tree.parts[i][1].T
        r, c = np.nonzero(h >= (bound[at] - slack)[:, None])
        found.append((at[r], tree.parts[i][0][c], h[r, c]))
    r, eid, v = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.lexsort((eid, -np.round(v, places), r))
    r, eid, v = r[order], eid[order], v[order]
    on = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[on], eid[on], v[on]


def nearest(slices: DataFrame, codewords: DataFrame) -> DataFrame:
    """``slices`` (keys, s, x) with eid and d2 of the nearest codeword of their slice; slices without codewords are left out."""
    spark, out = matrix.ready(slices.sparkSession), None
    keys = [c for c in slices.columns if c != "x"]
    at_s, types = keys.index("s"), dict(slices.dtypes)
    rows = slices.select(*keys, "x")
    found = list(books(codewords))
    for book in found:
        sent = spark.sparkContext.broadcast(book)

        def run(batches, sent=sent):
            trees = {s: Tree(*b) for s, b in sent.value.items()}

            def done(t):
                s, x = t.column(at_s).to_numpy(), matrix.flat(t.column(len(keys)), len(t))
                order, eids, d2s = [], [], []
                for k in np.unique(s):
                    if int(k) in trees:
                        at = np.flatnonzero(s == k)
                        e, d = trees[int(k)].nearest(x[at])
                        order.append(at), eids.append(e), d2s.append(d)
                if order:
                    some = t.select(list(range(len(keys)))).take(pa.array(np.concatenate(order)))
                    some = some.append_column("eid", pa.array(np.concatenate(eids).astype(np.int32))).append_column("d2", pa.array(np.concatenate(d2s)))
                    yield from some.combine_chunks().to_batches(max_chunksize=10_000)

            wait, n = [], 0
            for b in batches:
                if b.num_rows:
                    wait.append(b)
                    n += b.num_rows
                if n >= WAIT:
                    yield from done(pa.Table.from_batches(wait))
                    wait, n = [], 0
            if wait:
                yield from done(pa.Table.from_batches(wait))

        one = rows.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", eid int, d2 double")
        out = one if out is None else out.unionByName(one)
    if len(found) == 1:
        return out
    there = F.create_map(*[F.lit(v) for k in {k for b in found for k in b} for v in (k, sum(k in b for b in found))])
    one = out.groupBy(*keys).agg(F.min(F.struct("d2", "eid")).alias("n"), F.count("*").alias("rows"))
    copies = F.expr("sequence(1, greatest(1, cast(rows / blocks as int)))")  # equal rows stay as many
    return one.withColumn("blocks", there[F.col("s")]).withColumn("copy", F.explode(copies)).select(*keys, "n.eid", "n.d2")


def hits(rows: DataFrame, codewords: DataFrame, subspaces: int, width: int, k: int | None = None, least: float | None = None, places: int = 9) -> DataFrame:
    """keys, s, eid, hit: inner products of each row's slices (keys, emb) with the codewords.

    With ``k``, the best of a slice (by hits rounded to ``places``, ties to the
    lesser eid), else all; with ``least``, those above 0 and of at least this.
    Rows have keys of their own.
    """
    spark, out = matrix.ready(rows.sparkSession), None
    keys = [c for c in rows.columns if c != "emb"]
    types, found = dict(rows.dtypes), list(books(codewords))
    for book in found:
        sent = spark.sparkContext.broadcast(book)

        def run(batches, sent=sent):
            trees = {s: Tree(eids, w) for s, (eids, w) in sent.value.items() if k is not None and s < subspaces and len(w) >= 16 * LEAF and np.isfinite(w).all()}
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix.flat(b.column(len(keys)), b.num_rows)
                for s, (eids, w) in sent.value.items():
                    if s >= subspaces:
                        continue
                    own, tree = x[:, s * width : (s + 1) * width], trees.get(s)
                    if tree and min(len(e) for e, _ in tree.parts) >= k and np.isfinite(own).all():
                        step = max(1, matrix.WORK // len(tree.parts))
                        parts = ((r + at, e, v) for at in range(0, len(own), step) for r, e, v in [_pruned(own[at : at + step], tree, k, places)])
                    else:
                        parts = ((r, eids[c], v) for r, c, v in _dense(own, w, k, places))
                    for r, e, v in parts:
                        if least is not None:
                            on = (v > 0) & (v >= least)
                            r, e, v = r[on], e[on], v[on]
                        take = pa.array(r)
                        yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(keys))), pa.array(np.full(len(r), s, np.int32)), pa.array(e.astype(np.int32)), pa.array(v)], [*keys, "s", "eid", "hit"])

        one = rows.select(*keys, "emb").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keys) + ", s int, eid int, hit double")
        out = one if out is None else out.unionByName(one)
    if len(found) == 1 or k is None:
        return out
    rk = F.row_number().over(Window.partitionBy(*keys, "s").orderBy(F.desc(F.round("hit", places)), "eid"))
    return out.withColumn("_r", rk).where(F.col("_r") <= k).drop("_r")


def quantile(rows: DataFrame, codewords: DataFrame, subspaces: int, width: int, fraction: float) -> DataFrame:
    """s, r2: the interpolated quantile of the squared distances, rounded to nine places, of each row's slices (emb) to the codewords.

    Exact, by counting: distances are whole billionths, told apart by 16 bits in
    a pass; a task sends its counts of the digits of each slice and rank.
    """
    spark, found = matrix.ready(rows.sparkSession), list(books(codewords))
    sent = [spark.sparkContext.broadcast(b) for b in found]
    longest = rows.agg(F.max(vec.dot(F.col("emb"), F.col("emb")))).first()[0] or 0.0
    widest = max((float((w * w).sum(axis=1).max()) for b in found for _, w in b.values()), default=0.0)
    bits = 16
    shift = bits * ((int((longest**0.5 + widest**0.5) ** 2 * 1e9 + 2).bit_length() - 1) // bits)

    def counts(known: dict, shift: int) -> dict:
        """(s, prefix) -> how many distances go on with each digit."""
        def run(batches, sent):
            total = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix.flat(b.column(0), b.num_rows)
                for s, prefixes in known.items():
                    if s not in sent.value:
                        continue
                    w = sent.value[s][1]
                    step = max(1, WORK // len(w))
                    for at in range(0, len(x), step):
                        p = x[at : at + step, s * width : (s + 1) * width]
                        d = np.zeros((len(p), len(w)))
                        for j in range(width):
                            d += (p[:, j, None] - w[None, :, j]) ** 2
                        u = np.rint(d * 1e9).astype(np.int64).ravel()
                        head = u >> (shift + bits)
                        for q in prefixes:
                            digit = (u[head == q] >> shift) & ((1 << bits) - 1)
                            n = np.bincount(digit, minlength=1 << bits)
                            total[s, q] = n if (s, q) not in total else total[s, q] + n
            for (s, q), n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(np.full(len(at), q, np.int64)), pa.array(at), pa.array(n[at])], ["s", "q", "digit", "n"])

        out = None
        for block in sent:
            one = rows.select("emb").mapInArrow(lambda batches, block=block: run(batches, block), "s int, q long, digit long, n long")
            out = one if out is None else out.unionByName(one)
        found: dict = {}
        for r in out.groupBy("s", "q", "digit").agg(F.sum("n").alias("n")).collect():  # bounded by slices, ranks and digits
            found.setdefault((r.s, r.q), np.zeros(1 << bits, np.int64))[r.digit] = r.n
        return found

    part: dict = {}
    at: dict = {}  # (s, which rank) -> (prefix, rank within it)
    while shift >= 0:
        known = {s: sorted({q for (t, _), (q, _) in at.items() if t == s}) for s, _ in at} if at else dict.fromkeys(range(subspaces), [0])
        found = counts(known, shift)
        if not at:
            for (s, _), n in found.items():
                rank = (int(n.sum()) - 1) * fraction
                part[s] = rank % 1
                at |= {(s, 0): (0, int(np.floor(rank))), (s, 1): (0, int(np.ceil(rank)))}
        for (s, which), (q, rank) in at.items():
            below = np.cumsum(found[s, q])
            digit = int(np.searchsorted(below, rank, side="right"))
            at[s, which] = ((q << bits) + digit, rank - (int(below[digit - 1]) if digit else 0))
        shift -= bits
        if not at:
            break
    low = lambda s, i: at[s, i][0] / 1e9
    made = [(s, low(s, 0) + (low(s, 1) - low(s, 0)) * part[s]) for s, i in at if i == 0]
    return rows.sparkSession.createDataFrame(made, "s int, r2 double")
