"""Bitmask predicates: a passage passes when it shares a bit with the mask; mask 0 passes all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec

LOW_BITS = 65535


def passes(pred: Column, mask: Column | int) -> Column:
    m = F.lit(mask) if isinstance(mask, int) else mask
    return (m == 0) | (pred.bitwiseAND(m) != 0)


def signed32(mask: Column) -> Column:
    """The 32 bits of an unsigned mask as a signed number, as systems without unsigned types store it."""
    low = mask.cast("long").bitwiseAND(F.lit((1 << 32) - 1))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def selectivity(preds: DataFrame, mask: int) -> DataFrame:
    return preds.agg(F.avg(F.when(passes(F.col("pred"), mask), 1.0).otherwise(0.0)).alias("selectivity"))


def synthetic(pid: Column, shares: tuple[int, ...]) -> Column:
    """Bit b is set for shares[b] of 10,000 passages, each bit by a hash of its own."""
    return sum(F.when(vec.hash48(F.concat(F.lit(f"{b}:"), pid.cast("string"))) % 10000 < t, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, t in enumerate(shares))


def domains(passages: DataFrame, ranges: DataFrame, base_bit: int = 8) -> DataFrame:
    """pid, bit of the domain range (first, count, i) that holds it; few ranges, so they are broadcast."""
    d = passages.join(F.broadcast(ranges), (F.col("pid") >= F.col("first")) & (F.col("pid") < F.col("first") + F.col("count")))
    return d.select("pid", F.expr(f"shiftleft(1L, {base_bit} + cast(i as int))").alias("bit"))


def with_topic(pred: Column, topic: Column, base_bit: int = 16) -> Column:
    """The topic bit replaces what stood above the low bits."""
    return pred.bitwiseAND(F.lit(LOW_BITS)).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (topic + base_bit).cast("int")))


def near_mid_far(sims: DataFrame, k: int) -> DataFrame:
    """Each query's nearest, middle and farthest topic: qid, filter, topic (from qid, topic, sim)."""
    rk = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("sim", 6)), "topic")) - 1
    name = F.when(F.col("r") == 0, "corr_near").when(F.col("r") == k // 2, "corr_mid").when(F.col("r") == k - 1, "corr_far")
    return sims.withColumn("r", rk).withColumn("filter", name).where(F.col("filter").isNotNull()).select("qid", "filter", "topic")


def bit_counts(ivf: DataFrame, preds: DataFrame, bits: int = 32) -> DataFrame:
    """Per centroid, how many postings have each bit, and how many there are."""
    d = ivf.join(preds.select("pid", "pred"), "pid")
    return d.groupBy("cid").agg(*[F.sum(F.shiftright("pred", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(bits)], F.count("*").alias("tot"))


def pass_counts(counts: DataFrame, mask: int, bits: int = 32) -> DataFrame:
    """Sum of the mask's bit counts: exact for one bit, an upper bound for more."""
    own = [F.col(f"b{b}") for b in range(bits) if mask >> b & 1]
    return counts.select("cid", (sum(own) if own else F.col("tot")).cast("long").alias("pass"), "tot")
