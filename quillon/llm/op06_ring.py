"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys stand on a ring of 2^60 places; each shard owns many arcs of it, one per
virtual node.  A key goes to the owner of its arc; when that shard is full, it
continues clockwise to the next arc whose shard has room.  Keys are admitted in
the order of the ring.  The capacities sum to at least the number of rows, and
with ``slack=0`` they are its fair shares (law ``rows``: counts at most one
apart).

Only the number of keys in each arc reaches the driver (``shards * vnodes``
numbers, whatever the input).  From them the admission is computed exactly: arc
by arc, so many of its keys, in ring order, to this shard, so many to that.
Each row then finds its place from its rank in its arc, a sum of cell counts
and a rank in a cell of about ``CELL`` rows, so no window holds an arc.

Defined results: a null id is placed by its text; rows with a null id and no
text share one place and are told apart by their rank only.  Repeated rows
count one by one.  Null texts have no bytes, size 1 and checksum 0.  With no
rows there is no result; other columns aren't read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

RING_BITS = 60
COARSE_BITS = 12
CELL = 2000


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(start of the arc, its shard) in ring order; the arc of the last start goes on past zero."""
    at = {}
    for s in range(shards):
        for v in range(vnodes):
            at.setdefault(int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") >> (64 - RING_BITS), s)
    return sorted(at.items())


def admitted(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Arc by arc: (arc, first rank in the arc, first rank in the shard, shard) of each run of keys."""
    room, filled, runs, n = list(room), [0] * len(room), [], len(owners)
    for arc in range(n):
        left, rank, at = counts.get(arc, 0), 0, arc
        while left:
            s = owners[at % n]
            if (now := min(left, room[s] - filled[s])) > 0:
                runs.append((arc, rank, filled[s], s))
                filled[s], left, rank = filled[s] + now, left - now, rank + now
            at += 1
            if at > arc + n:
                raise ValueError("the capacities are less than the rows")
    return runs


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [int((1 + slack) * rows / shards) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _arcs(starts: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first place, end, coarse cell of 1 / 2^COARSE_BITS of the ring that it meets)."""
    pieces = [(i, a, b) for i, (a, b) in enumerate(zip(starts, [*starts[1:], 1 << RING_BITS], strict=True))]
    if starts[0]:
        pieces.append((len(starts) - 1, 0, starts[0]))
    step = RING_BITS - COARSE_BITS
    return [(i, a, b, c) for i, a, b in pieces for c in range(a >> step, ((b - 1) >> step) + 1)]


def shard(docs: DataFrame, shards: int, *, vnodes: int = 64, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless within its shard) of every row."""
    spark = docs.sparkSession
    arcs = ring(shards, vnodes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary"))))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(key.cast("binary")), 1, RING_BITS // 4), 16, 10).cast("long").alias("place"),
    )
    # Bounded by shards * vnodes + 2^COARSE_BITS rows.
    bounds = spark.createDataFrame(_arcs([a for a, _ in arcs]), "arc int, lo long, hi long, coarse long")
    placed = rows.withColumn("coarse", F.shiftright("place", RING_BITS - COARSE_BITS)).join(F.broadcast(bounds), "coarse").where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))).drop("coarse", "lo", "hi")
    placed = stored(placed, "ring")
    width = max(1, (1 << RING_BITS) * CELL // max(CELL, placed.count()))
    placed = placed.withColumn("cell", (F.col("place") - F.col("place") % width))
    cells = stored(placed.groupBy("arc", "cell").agg(F.count("*").alias("n")), "ring-cells")
    counts = {r.arc: r.n for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    runs = admitted(counts, [s for _, s in arcs], capacities(sum(counts.values()), shards, slack))
    ends = [(a, r, (runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == a else counts[a]), t, s) for i, (a, r, t, s) in enumerate(runs)]
    parts = spark.createDataFrame(ends, "arc int, first long, end long, base long, shard int")
    # The arc that goes on past zero has its last places first: its cells are in the order of the ring.
    turn = F.when(F.col("cell") < arcs[0][0] - arcs[0][0] % width, F.lit(1)).when((F.col("cell") == arcs[0][0] - arcs[0][0] % width) & (F.col("arc") == len(arcs) - 1), F.lit(1)).otherwise(F.lit(0))
    order = Window.partitionBy("arc").orderBy(turn, "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).select("arc", "cell", "before")
    within = F.row_number().over(Window.partitionBy("arc", "cell").orderBy("place", "doc_id", "text_crc32", "size"))
    ranked = placed.withColumn("within", within).join(offsets, ["arc", "cell"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    # Runs: at most one for each arc and one more for each time a shard fills, so bounded like the arcs.
    return (
        ranked.join(F.broadcast(parts), "arc").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"), "arc", "rank")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
