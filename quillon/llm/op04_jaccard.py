"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal shingle sets are one node (copies are never compared).
Each node has ``HASHES`` MinHash values.  Nodes that agree on all values of one
of ``BANDS`` bands are candidates: of pairs at similarity 0.8, 5 in a million
agree on none.  In a band's bucket, pairs are compared a few values at a time,
and a pair is dropped once the posterior probability of reaching the threshold
(uniform prior) is below ``TOLERANCE``.  What survives is handed on as trees,
so a bucket gives fewer rows than it has nodes; connected survivors form a
cluster, and within a cluster all pairs are decided exactly, from their shingle
sets.  Links are counted there, not emitted.

Distance (1 - similarity) is a metric, so most pairs of a cluster need no
comparison: the distances x and y of two nodes from the cluster's first node
tell that they are linked where x + y is at most 1 - threshold.  Distances are
rounded up to thousandths and counted, so a cluster of near copies costs one
comparison a node, however large it is.  Pairs for which the sum is larger are
compared: nodes further than half the bound with each other and with the nearer
ones for which it matters, never the nearer ones among themselves.

Buckets are cut into tiles of ``TILE`` nodes, and pairs of tiles are tasks'
groups; a bucket of more than ``WIDE`` nodes, where that would be too many
pairs, goes on as a whole, which loses nothing.  Clusters are cut into tiles of
at most ``TILE`` nodes and about ``TILE_BYTES`` of shingles.

Shingles are ``N`` consecutive words, words being separated by space and U+0009
to U+000D; fewer words than ``N`` make one shingle of all of them.

Defined results: a text without words (null, empty or white space) is similar
to nothing, not even to another such text: it has 0 links and is its own class.
A class is named by its least doc_id; a null id counts as a document and names
no class unless all its ids are null.  Repeated rows are copies.  Texts of any
length count whole, and so do words; a text without spaces is one word.  A
similarity of exactly the threshold is a link.  Every row gives one row; an
empty table gives none; columns other than id and text aren't read.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, dropped, mixed, ready, rest_of, spread, stored, table, text_or_empty
from .components import components

N = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
TILE = 1024
WIDE = 8 * TILE
TILE_BYTES = 16 << 20
LEVELS = 1000
KEPT = 300_000

_A = (spread(HASHES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (spread(2 * HASHES)[HASHES:] >> np.uint64(32)).astype(np.uint32)
_C = spread(64) | np.uint64(1)


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(w)
        if len(self) >= KEPT:
            self.clear()
        if len(w) <= 64:
            self[w] = h
        return h


_SEEN = _Words()


def shingles(text: str, n: int = N) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes."""
    words = text.encode().split()
    h = np.fromiter(map(_SEEN.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(h))
    if not k:
        return h
    with np.errstate(over="ignore"):
        s = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            s = mixed(s * _C[1] + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a nonempty set, 16 bits of each."""
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (x[i : i + 2048, None] * _A + _B).min(axis=0))
    return low.astype(np.uint16)


def bands(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    v = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _C[2], v.shape[:2]).copy()
        for r in range(ROWS):
            key = mixed(key * _C[3] + v[:, :, r])
    return key.view(np.int64)


def least_matches(threshold: Fraction, tolerance: float) -> dict[int, int]:
    """After so many values, the fewest agreements with which a pair goes on."""
    t, out = float(threshold), {}
    for n in range(STEP, HASHES + 1, STEP):
        # P(similarity >= t | m of n agree) = P(Binomial(n + 1, t) <= m) under a uniform prior.
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _groups(batches, keys: int):
    """Runs of equal values in the first ``keys`` columns, over batch borders, as lists of columns."""
    held: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(keys)])
        cuts = np.r_[0, np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, b.num_rows]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(at, end - at)
            if held and [c[0].as_py() for c in held[0].columns[:keys]] == [c[0].as_py() for c in part.columns[:keys]]:
                held.append(part)
            else:
                if held:
                    yield pa.Table.from_batches(held)
                held = [part]
    if held:
        yield pa.Table.from_batches(held)


def _paired(df: DataFrame, key: str, own: Column, others: Column, rest: list[str]) -> DataFrame:
    """Rows dealt to pairs of tiles, their own and each of the others: key, a, b, side, rest; sorted in partitions."""
    d = df.withColumn("_own", own.cast("int")).withColumn("_other", F.explode(others.cast("array<int>")))
    d = d.select(key, F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"), F.col("_own").alias("side"), *rest)
    return d.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b", "nid")


def _tile(tiles: Column) -> Column:
    return F.pmod(F.xxhash64("nid"), tiles)


def _survivors(least: dict[int, int]):
    """Trees of the pairs of each bucket that outlive the comparison."""

    def run(batches):
        for g in _groups(batches, 3):
            n = g.num_rows
            if n < 2:
                continue
            a, b = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            side, nid = g.column(3).to_numpy(), g.column(4).to_numpy()
            sig = np.frombuffer(b"".join(g.column(5).to_pylist()), dtype=np.uint16).reshape(n, HASHES)
            key = g.column(0)[0].as_py()
            forest, rows = Forest(n), []
            for i in range(n - 1):
                j = np.arange(i + 1, n)
                if a != b:
                    j = j[side[i + 1 :] != side[i]]
                match = np.zeros(len(j), np.int32)
                for at in range(0, HASHES, STEP):
                    if not len(j):
                        break
                    match += (sig[j, at : at + STEP] == sig[i, at : at + STEP]).sum(axis=1)
                    on = match >= least[at + STEP]
                    j, match = j[on], match[on]
                if not len(j):
                    continue
                # A pair that meets in several bands counts in the first of them only.
                same = (sig[j] == sig[i]).reshape(len(j), BANDS, ROWS).all(axis=2)
                mine = bands(sig[i : i + 1])[0] == key
                j = j[same.argmax(axis=1) == np.argmax(mine)]
                rows += [(nid[i], nid[k]) for k in j.tolist() if forest.join(i, k)]
            if rows:
                u, v = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    lens = np.array([len(s) for s in sets])
    vocab, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float64)
    row = np.repeat(np.arange(n), lens)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    width = max(256, 8_000_000 // n)
    for lo in range(0, len(vocab), width):
        i, j = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((n, min(width, len(vocab) - lo)), np.float32)
        m[row[i:j], at[i:j] - lo] = 1.0
        out += m @ m.T
    del often
    return np.rint(out).astype(np.int64)


def _levels(batches):
    """Distance of each node from its cluster's first node, in steps of 1 / LEVELS, rounded up."""
    pivot, now, last = None, None, None
    for b in batches:
        cluster, tile, first, nid = (b.column(i).to_numpy() for i in range(4))
        cuts = sorted({0, b.num_rows, *np.flatnonzero(first).tolist()})
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if first[i]:  # it comes before the other rows of its group
                if (cluster[i], tile[i]) != now:
                    pivot, now, last = np.frombuffer(b.column(5)[i].as_py(), dtype=np.uint64), (cluster[i], tile[i]), None
                i += 1
            keep = np.ones(j - i, bool)
            for k in range(i, j):  # a node whose document is repeated came more than once
                if (cluster[k], tile[k]) != now:
                    raise RuntimeError("a cluster has no first node: the table changed between passes")
                keep[k - i], last = nid[k] != last, nid[k]
            at = np.flatnonzero(keep) + i
            if not len(at):
                continue
            part = b.take(pa.array(at))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column(5).to_pylist()]
            size = np.array([len(x) for x in sets], dtype=np.int64)
            flat = np.concatenate(sets)
            hit = pivot[np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)] == flat
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
            union = size + len(pivot) - common
            level = -(-LEVELS * (union - common) // union)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), part.column(4), pa.array(size), pa.array(level)], ["cluster", "tile", "nid", "weight", "size", "level"])


def _verified(threshold: Fraction):
    """Links of each node in a group that distances didn't tell, weighted by copies, and trees of the linked."""
    num, den = threshold.numerator, threshold.denominator
    reach = LEVELS * (den - num) // den

    def run(batches):
        for g in _groups(batches, 3):
            a, b = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            seen: dict[int, int] = {}
            for r, x in enumerate(g.column(4).to_pylist()):
                seen.setdefault(x, r)  # a node whose document is repeated came more than once
            at = list(seen.values())
            n = len(at)
            if n < 2:
                continue
            g = g.take(at)
            side, nid, weight, level = (g.column(i).to_numpy() for i in (3, 4, 5, 6))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in g.column(7).to_pylist()]
            size = np.array([len(s) for s in sets], dtype=np.int64)
            link = _intersections(sets) * (num + den) >= num * (size[:, None] + size[None, :])
            link &= level[:, None] + level[None, :] > reach
            np.fill_diagonal(link, False)
            if a != b:
                link &= side[:, None] != side[None, :]
            forest = Forest(n)
            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(link))), strict=True):
                forest.join(i, j)
            parent = nid[[forest.find(i) for i in range(n)]]
            yield pa.RecordBatch.from_arrays([pa.array(nid, pa.int64()), pa.array(parent, pa.int64()), pa.array(link @ weight, pa.int64())], ["nid", "parent", "links"])

    return run


def _signed(batches):
    for b in batches:
        key, size, sig = [], [], []
        for t in b.column(2):
            s = shingles(t.as_py())
            key.append(_set_key(s))
            size.append(len(s))
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key, pa.string()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "th", "set_key", "size", "sig"])


def _set_key(s: np.ndarray) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(s.tobytes())


def _banded(batches):
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(n, HASHES)
        yield pa.RecordBatch.from_arrays([pa.array(bands(sig).ravel(), pa.int64()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS), pa.int64())], ["key", "nid"])


def _fetched(batches):
    for b in batches:
        keep, sets = [], []
        for r, (t, key) in enumerate(zip(b.column(4), b.column(3).to_pylist(), strict=True)):
            s = shingles(t.as_py())
            if _set_key(s) == key:  # another text may have the id
                keep.append(r)
                sets.append(s.tobytes())
        part = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sets, pa.binary())], ["cluster", "nid", "weight", "shingles"])


def join(docs: DataFrame, *, threshold: Fraction = THRESHOLD, tile: int = TILE, wide: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of its connected group), links and th (a hash of the text)."""
    ready(docs.sparkSession)
    wide = WIDE if wide is None else wide
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    signed = stored(rows.mapInArrow(_signed, "doc_id long, th long, set_key string, size long, sig binary"), "signed")
    # Nodes: sets, with one document to read the set from.
    nodes = signed.where(F.col("size") > 0).groupBy("set_key").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.min("doc_id").alias("least_id"), F.count("*").alias("weight"), F.min("size").alias("size"), F.min("sig").alias("sig"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("nid"), "set_key", "one.doc_id", "one.th", "least_id", "weight", "size", "sig"), "nodes")
    clusters = _clusters(nodes, least_matches(threshold, TOLERANCE), tile, wide)
    wanted = clusters.join(nodes.drop("sig").hint("merge"), clusters["node"] == nodes["nid"])
    wanted = wanted.select(F.col("root").alias("cluster"), "nid", "weight", "set_key", F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"))
    texts = rows.join(wanted.hint("merge"), (F.col("th") == F.col("w_th")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("cluster", "nid", "weight", "set_key", "text")
    sets = stored(texts.mapInArrow(_fetched, "cluster long, nid long, weight long, shingles binary"), "sets")
    checked = stored(_linked(sets, clusters, nodes, threshold, tile), "verified")
    roots = components(checked.select(F.col("nid").alias("u"), F.col("parent").alias("v")))
    links = checked.groupBy("nid").agg(F.sum("links").alias("other"))
    placed = nodes.select("nid", "set_key", "weight", "least_id").join(roots.hint("merge"), F.col("nid") == F.col("node"), "left").join(links.hint("merge"), "nid", "left")
    placed = stored(placed.select("set_key", "least_id", F.coalesce("root", "nid").alias("root"), (F.coalesce("other", F.lit(0)) + F.col("weight") - 1).alias("links")), "placed")
    # Both sides of a join on a root come from tables, so a hot root can be split.
    names = stored(placed.groupBy("root").agg(F.min("least_id").alias("class_id")), "names")
    placed = placed.join(names.hint("merge"), "root").select("set_key", "root", "links", "class_id")
    out = signed.drop("sig").join(placed.hint("merge"), "set_key", "left")
    dropped(clusters, sets, checked)
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), "th", "root")


def _clusters(nodes: DataFrame, least: dict[int, int], tile: int, wide: int) -> DataFrame:
    """(node, root) of all nodes that a chain of candidates connects with another."""
    keyed = nodes.select("nid", "sig").mapInArrow(_banded, "key long, nid long")
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("nid").alias("one")).where(F.col("n") > 1), "shared")
    meeting = stored(keyed.join(shared.hint("merge"), "key"), "meeting")
    buckets = meeting.where(F.col("n") <= wide).join(nodes.select("nid", "sig").hint("merge"), "nid").select("key", F.ceil(F.col("n") / tile).alias("t"), "nid", "sig")
    trees = _paired(buckets, "key", _tile(F.col("t")), F.sequence(F.lit(0), F.col("t").cast("int") - 1), ["nid", "sig"]).mapInArrow(_survivors(least), "u long, v long")
    whole = meeting.where((F.col("n") > wide) & (F.col("nid") != F.col("one"))).select(F.col("nid").alias("u"), F.col("one").alias("v"))
    edges = stored(trees.unionByName(whole), "survivors")
    dropped(shared, meeting)
    found = stored(components(edges), "clusters")
    dropped(edges)
    return found


def _linked(sets: DataFrame, clusters: DataFrame, nodes: DataFrame, threshold: Fraction, tile: int) -> DataFrame:
    """nid, parent (a node that it is linked with, directly or not) and links, in parts that add up."""
    reach = LEVELS * (threshold.denominator - threshold.numerator) // threshold.denominator
    tiles = lambda n, size: F.ceil(F.greatest(n / tile, size * 8 / TILE_BYTES)).cast("int")
    sizes = clusters.join(nodes.select("nid", "size").hint("merge"), F.col("node") == F.col("nid")).groupBy("root").agg(tiles(F.count("*"), F.sum("size")).alias("t"))
    dealt = sets.join(stored(sizes, "sizes").hint("merge"), F.col("cluster") == F.col("root"))
    # The first node of a cluster, the one that names it, goes to each of its tiles.
    own = dealt.select("cluster", _tile(F.col("t")).cast("int").alias("tile"), F.lit(0).alias("first"), "nid", "weight", "shingles")
    firsts = dealt.where(F.col("nid") == F.col("cluster")).select("cluster", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("tile"), F.lit(1).alias("first"), "nid", "weight", "shingles")
    met = own.unionByName(firsts).repartition("cluster", "tile").sortWithinPartitions("cluster", "tile", F.desc("first"), "nid")
    levels = stored(met.mapInArrow(_levels, "cluster long, tile int, nid long, weight long, size long, level long"), "levels")
    counts = levels.groupBy("cluster", "level").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.sum("size").alias("size"), F.max("tile").alias("tile"))
    # At most LEVELS + 1 entries for a cluster; its tiles meet them in tasks of their own.
    counts = counts.groupBy(F.col("cluster").alias("c_cluster")).agg(F.collect_list(F.struct("level", "w", "n", "size")).alias("at"), F.max("level").alias("far"), F.max("tile").alias("tiles"))
    counts = stored(counts.withColumn("c_tile", F.explode(F.sequence(F.lit(0), F.col("tiles")))).drop("tiles"), "counts")
    told = levels.join(counts.hint("merge"), (F.col("cluster") == F.col("c_cluster")) & (F.col("tile") == F.col("c_tile")))
    total = lambda keep, what: F.aggregate(F.filter("at", keep), F.lit(0).cast("long"), lambda s, x: s + x[what])
    near = F.col("level") * 2 <= reach
    sure = total(lambda x: x["level"] <= reach - F.col("level"), "w") - F.when(near, F.col("weight")).otherwise(0)
    # Without the first node itself, whose links are all told.
    asked = told.where((F.col("level") + F.col("far") > reach) & (F.col("nid") != F.col("cluster")))
    is_far, is_near = lambda x: x["level"] * 2 > reach, lambda x: (x["level"] * 2 <= reach) & (x["level"] + F.col("far") > reach)
    asked = asked.select("cluster", "nid", "level", near.alias("near"), tiles(total(is_far, "n"), total(is_far, "size")).alias("f"), tiles(total(is_near, "n"), total(is_near, "size")).alias("m"), (total(is_far, "n") + total(is_near, "n")).alias("all")).where(F.col("all") > 1)
    wanted = sets.join(asked.select(F.col("nid").alias("a_nid"), "level", "near", "f", "m").hint("merge"), F.col("nid") == F.col("a_nid"))
    own = F.when(F.col("near"), F.col("f") + _tile(F.greatest("m", F.lit(1)))).otherwise(_tile(F.col("f")))
    others = F.sequence(F.lit(0), F.when(F.col("near"), F.col("f") - 1).otherwise(F.col("f") + F.col("m") - 1))
    compared = _paired(wanted, "cluster", own, others, ["nid", "weight", "level", "shingles"]).mapInArrow(_verified(threshold), "nid long, parent long, links long")
    return told.select("nid", F.when(F.col("level") <= reach, F.col("cluster")).otherwise(F.col("nid")).alias("parent"), sure.alias("links")).unionByName(compared)


def representatives(docs: DataFrame, **kinds) -> DataFrame:
    """One row of each class, of the document that names it (of repeated rows the first by their other columns); rows without words stay."""
    linked = join(docs, **kinds)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    best = linked.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_b_id"), F.col("k.th").alias("_b_th"))
    rows = docs.select(*docs.columns, F.xxhash64("text").alias("_th"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("_worded"))
    kept = rows.where("_worded").join(best.hint("merge"), (F.col("_th") == F.col("_b_th")) & F.col("doc_id").eqNullSafe(F.col("_b_id")), "left_semi")
    first = F.row_number().over(Window.partitionBy("_th", "doc_id").orderBy(rest_of(docs)))
    kept = kept.withColumn("_first", first).where(F.col("_first") == 1)
    return kept.select(*docs.columns).unionByName(rows.where(~F.col("_worded")).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM d WHERE len(w) > 0
), n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
k AS MATERIALIZED (
  SELECT a.r AS x, b.r AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), p AS MATERIALIZED (
  SELECT x, y FROM k JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 9 * i >= 4 * (a.n + b.n)
), e AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
c AS (SELECT DISTINCT x, x AS y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
m AS (SELECT c.x AS r, min(doc_id) AS class_id FROM c JOIN d ON d.r = c.y GROUP BY c.x),
l AS (SELECT x AS r, count(*) AS links FROM e GROUP BY x)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(links, 0) AS links FROM d LEFT JOIN m USING (r) LEFT JOIN l USING (r)
"""
