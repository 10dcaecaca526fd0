"""Fixed-dimensional encodings: token sets as one vector, so that inner products track MaxSim.

Each repetition hashes tokens to 2^k buckets by the signs of k planes and
projects them; documents average a bucket's tokens, queries sum them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec


def sign(key: str) -> int:
    """+1 or -1, by the last bit of the first 48 of SHA-256."""
    import hashlib

    return 1 - 2 * (int(hashlib.sha256(key.encode()).hexdigest()[:12], 16) & 1)


class Params:
    def __init__(self, dim: int, reps: int = 2, k: int = 2, d_proj: int = 4):
        self.dim, self.reps, self.k, self.d = dim, reps, k, d_proj
        self.planes = [[[sign(f"g:{r}:{i}:{j}") for j in range(dim)] for i in range(k)] for r in range(reps)]
        self.proj = [[[sign(f"p:{r}:{i}:{j}") / d_proj**0.5 for j in range(dim)] for i in range(d_proj)] for r in range(reps)]

    def bucket(self, x: Column, r: int) -> Column:
        return sum((F.when(vec.dot(x, F.array(*[F.lit(float(v)) for v in g])) > 0, 1 << i).otherwise(0) for i, g in enumerate(self.planes[r])), F.lit(0))

    def projected(self, x: Column, r: int) -> Column:
        return F.array(*[vec.dot(x, F.array(*[F.lit(float(v)) for v in p])) for p in self.proj[r]])

    def parts(self, tokens: DataFrame, key: str, pos: str) -> DataFrame:
        """key, pos, r, b, y: bucket and projection of each token in each repetition."""
        each = F.array(*[F.struct(F.lit(r).alias("r"), self.bucket(F.col("emb"), r).alias("b"), self.projected(F.col("emb"), r).alias("y")) for r in range(self.reps)])
        return tokens.select(key, pos, F.explode(each).alias("e")).select(key, pos, "e.*")


def _laid_out(blocks: DataFrame, key: str) -> DataFrame:
    """(key, r, b, y) -> key, fde: the blocks end to end."""
    return blocks.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", "b", "y"))), lambda e: e["y"])).alias("fde"))


def documents(tokens: DataFrame, p: Params) -> DataFrame:
    """pid, fde; an empty bucket takes the token whose bucket differs in the fewest bits, ties to the first."""
    parts = p.parts(tokens, "pid", "pos")
    sets = parts.groupBy("pid", "r").agg(F.collect_list(F.struct("b", "pos", "y")).alias("ts"))
    d = sets.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit((1 << p.k) - 1))))
    own = F.filter("ts", lambda t: t["b"] == F.col("b"))
    total = F.aggregate(own, F.array(*[F.lit(0.0)] * p.d), lambda s, t: vec.added(s, t["y"]))
    mean = F.transform(total, lambda x: x / F.size(own))
    near = F.array_min(F.transform("ts", lambda t: F.struct(F.bit_count(t["b"].bitwiseXOR(F.col("b"))).alias("h"), t["pos"].alias("pos"), t["y"].alias("y"))))["y"]
    return _laid_out(d.select("pid", "r", "b", F.when(F.size(own) > 0, mean).otherwise(near).alias("y")), "pid")


def queries(tokens: DataFrame, p: Params) -> DataFrame:
    """qid, fde; an empty bucket is zero."""
    parts = p.parts(tokens, "qid", "qt")
    sets = parts.groupBy("qid", "r").agg(F.collect_list(F.struct("b", "y")).alias("ts"))
    d = sets.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit((1 << p.k) - 1))))
    own = F.filter("ts", lambda t: t["b"] == F.col("b"))
    total = F.aggregate(own, F.array(*[F.lit(0.0)] * p.d), lambda s, t: vec.added(s, t["y"]))
    return _laid_out(d.select("qid", "r", "b", total.alias("y")), "qid")
