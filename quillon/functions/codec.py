"""Two-bit residual codec: four buckets a dimension, four dimensions a byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec


def quantized(residual: Column, cuts: tuple[float, ...]) -> Column:
    """Bucket (0..3) of each dimension: how many cut points are at or below it."""
    return F.transform(residual, lambda x: sum((x >= F.lit(c)).cast("int") for c in cuts))


def packed(buckets: Column, dim: int) -> Column:
    """Bytes as ARRAY<INT>, the first dimension in the highest bits."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim // 4 - 1)), lambda b: sum(F.element_at(buckets, (b * 4 + i + 1).cast("int")) * (1 << (6 - 2 * i)) for i in range(4)))


def byte_weights(spark: SparkSession, weights: tuple[float, ...]) -> DataFrame:
    """The composed table: byte -> the weights of its four dimensions (256 rows)."""
    b = F.col("b")
    w = F.array(*[F.lit(float(x)) for x in weights])
    return spark.range(256).select(F.col("id").cast("int").alias("b")).select("b", F.array(*[F.element_at(w, F.shiftright(b, 6 - 2 * i).bitwiseAND(3) + 1) for i in range(4)]).alias("w"))


def decoded(data: Column, weights: tuple[float, ...]) -> Column:
    """Residual vector of the packed bytes."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.flatten(F.transform(data, lambda b: F.array(*[F.element_at(w, F.shiftright(b, 6 - 2 * i).bitwiseAND(3) + 1) for i in range(4)])))


def decompressed(center: Column, data: Column, weights: tuple[float, ...]) -> Column:
    """Centroid plus residual, scaled to length one."""
    return vec.scaled(vec.added(center, decoded(data, weights)), lambda n2: F.sqrt(n2 + F.lit(1e-12)))


def lut(query: Column, weights: tuple[float, ...], dim: int) -> Column:
    """Residual look-up table of a query vector: [byte position][byte value] -> partial inner product."""
    w = [float(x) for x in weights]

    def entry(j: Column, b: Column) -> Column:
        wa = F.array(*[F.lit(x) for x in w])
        return sum(F.element_at(query, (j * 4 + i + 1).cast("int")) * F.element_at(wa, (F.shiftright(b, 6 - 2 * i).bitwiseAND(3) + 1).cast("int")) for i in range(4))

    return F.transform(F.sequence(F.lit(0), F.lit(dim // 4 - 1)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: entry(j, b)))


def lut_dot(table: Column, data: Column) -> Column:
    """The residual's inner product by look-ups: one for each byte."""
    parts = F.zip_with(table, data, lambda t, b: F.element_at(t, (b + 1).cast("int")))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def pid24(pid: Column) -> Column:
    """Three little-endian bytes of a passage id; ids that don't fit raise."""
    ok = (pid >= 0) & (pid <= 0xFFFFFF)
    checked = F.when(ok, pid).otherwise(F.raise_error(F.lit("passage id out of 24 bits")).cast("long"))
    return F.array(*[F.shiftright(checked, 8 * i).bitwiseAND(255) for i in range(3)])


def pid_bytes(pid: Column) -> Column:
    """Little-endian bytes of a passage id: three, or all eight of an id that three don't hold (negative ones too)."""
    n = F.when((pid >= 0) & (pid <= 0xFFFFFF), F.lit(3)).otherwise(F.lit(8))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("shiftright", pid, i * 8).bitwiseAND(255))


def pid_bytes_read(b: Column) -> Column:
    """The id of ``pid_bytes``."""
    return F.aggregate(F.reverse(b), F.lit(0).cast("long"), lambda s, v: F.shiftleft(s, 8).bitwiseOR(v.cast("long")))


def pid24_read(b: Column) -> Column:
    return sum(F.shiftleft(F.element_at(b, i + 1).cast("long"), 8 * i) for i in range(3))
