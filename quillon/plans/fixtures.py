"""Views over the test tables that stand for a token index, and the same in DuckDB SQL.

``embeddings`` rows are tokens: five make a passage, every tenth passage also
asks a query, every sixteenth token is a centroid.  Only integer keys are
derived, so both engines agree exactly.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import codec, vec
from ..operators import filters, index

DIM = 64
CUTS, WEIGHTS = (-0.1, 0.0, 0.1), (-0.15, -0.05, 0.05, 0.15)
SHARES = (500, 1400, 3000, 6000, 10000)
SUB, WIDTH = 16, 3
ROT = SUB * WIDTH
MASK = 2  # the bit of the 14 % filter


#: What the views made last hold; older ones are let go (and made again where a plan still asks for them).
_KEPT: list[DataFrame] = []


def kept(df: DataFrame, most: int = 4) -> DataFrame:
    """``df``, made once for all steps that read it: small rows that cost much work."""
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    while len(_KEPT) > most:
        old = _KEPT.pop(0)
        if old.sparkSession.sparkContext._jsc is not None:  # its session isn't stopped
            old.unpersist()
    return df


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str, words: int | None = None):
        """``words``: how many codewords a slice has, where not all that there are."""
        self.spark, self.dir, self.words = spark, sf_dir, words

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def tok(self) -> DataFrame:
        d, cores = self.read("embeddings"), self.spark.sparkContext.defaultParallelism
        if d.rdd.getNumPartitions() < cores:  # a short row costs much work, and small files would be few tasks
            d = d.repartition(cores, "vec_id")
        return d.select(F.floor(F.col("vec_id") / 5.0).cast("long").alias("pid"), (F.col("vec_id") % 5).cast("int").alias("pos"), F.col("vec_id").alias("tok_id"), "label", F.col("embedding").cast("array<double>").alias("emb"))

    @cached_property
    def passages(self) -> DataFrame:
        toks = F.transform(F.array_sort(F.collect_list(F.struct("pos", "emb"))), lambda x: x["emb"])
        return self.tok.groupBy("pid").agg(toks.alias("toks"))

    @cached_property
    def qtok(self) -> DataFrame:
        return self.tok.where(F.col("pid") % 10 == 0).select(F.col("pid").alias("qid"), F.col("pos").alias("qt"), "emb")

    @cached_property
    def queries(self) -> DataFrame:
        return self.passages.where(F.col("pid") % 10 == 0).select(F.col("pid").alias("qid"), "toks")

    @cached_property
    def cen(self) -> DataFrame:
        return self.tok.where(F.col("tok_id") % 16 == 3).select(F.floor(F.col("tok_id") / 16.0).cast("long").alias("cid"), "emb")

    @cached_property
    def codes(self) -> DataFrame:
        return kept(index.assign(self.tok.select("pid", "pos", "tok_id", "emb"), self.cen))

    @cached_property
    def ivf(self) -> DataFrame:
        return index.plain_ivf(self.codes)

    @cached_property
    def residual(self) -> DataFrame:
        """pid, pos, tok_id, cid, center, data: the stored form of each token."""
        d = self.codes.join(self.tok.select("tok_id", "emb"), "tok_id").join(self.cen.withColumnRenamed("emb", "center"), "cid")
        return d.select("pid", "pos", "tok_id", "cid", "center", codec.packed(codec.quantized(vec.minus(F.col("emb"), F.col("center")), CUTS), DIM).alias("data"))

    @cached_property
    def pred(self) -> DataFrame:
        first = self.tok.where(F.col("pos") == 0).select("pid", (F.col("label") % 5 + 8).cast("int").alias("dom"))
        topic = self.codes.where(F.col("pos") == 0).select("pid", (F.col("cid") % 16).cast("int").alias("topic"))
        d = first.join(topic, "pid")
        low = filters.synthetic(F.col("pid"), SHARES) + F.expr("shiftleft(1L, dom)")
        return d.select("pid", filters.with_topic(low, F.col("topic")).alias("pred"))

    @cached_property
    def qrels(self) -> DataFrame:
        first = self.tok.where(F.col("pos") == 0).select("pid", "label")
        q = first.where(F.col("pid") % 10 == 0).select(F.col("pid").alias("qid"), "label")
        return q.join(first, "label").where(F.col("qid") != F.col("pid")).select("qid", "pid")

    @cached_property
    def rtok(self) -> DataFrame:
        """Tokens rotated (here: the first dimensions) and scaled to length one again."""
        return self.tok.withColumn("emb", vec.normalized(F.slice("emb", 1, ROT)))

    @cached_property
    def rcen(self) -> DataFrame:
        return self.cen.withColumn("emb", vec.normalized(F.slice("emb", 1, ROT)))

    @cached_property
    def rqtok(self) -> DataFrame:
        return self.qtok.withColumn("emb", vec.normalized(F.slice("emb", 1, ROT)))

    @cached_property
    def codewords(self) -> DataFrame:
        d = self.tok.where(F.col("tok_id") % 25 == 7).select(F.floor(F.col("tok_id") / 25.0).cast("int").alias("eid"), "emb")
        d = d if self.words is None else d.where(F.col("eid") < self.words)
        d = d.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SUB - 1))))
        return d.select("s", "eid", vec.subspace(F.col("emb"), F.col("s"), WIDTH).alias("w"))

    @cached_property
    def slices(self) -> DataFrame:
        """pid, cid, s, x: what each token's slices of most energy leave of its centroid."""
        rcodes = index.assign(self.rtok.select("pid", "pos", "tok_id", "emb"), self.rcen)
        d = rcodes.join(self.rtok.select("tok_id", "emb"), "tok_id")
        active = index.top_subspaces(self.rtok.select("tok_id", "emb"), SUB, WIDTH, 4).select("tok_id", "s")
        c = self.rcen.withColumnRenamed("emb", "center")
        x = vec.minus(vec.subspace(F.col("emb"), F.col("s"), WIDTH), vec.subspace(F.col("center"), F.col("s"), WIDTH))
        return d.join(active, "tok_id").join(c, "cid").select("pid", "cid", "s", x.alias("x"))

    @cached_property
    def postings(self) -> DataFrame:
        """s, cid, eid, pid: the codebook index over each token's slices of most energy."""
        return index.nearest_codeword(self.slices, self.codewords).select("s", "cid", "eid", "pid").distinct()

    @cached_property
    def truth(self) -> DataFrame:
        from ..operators.matrix import exact_scan

        return exact_scan(self.passages, self.queries, 10)


class Trained(Fixtures):
    """The same views over a rotation and codebooks that are trained on the table."""

    @cached_property
    def rotation(self) -> np.ndarray:
        return index.rotation(self.cen, ROT)

    @cached_property
    def rtok(self) -> DataFrame:
        return index.rotated(self.tok, self.rotation)

    @cached_property
    def rcen(self) -> DataFrame:
        return index.rotated(self.cen, self.rotation)

    @cached_property
    def rqtok(self) -> DataFrame:
        return index.rotated(self.qtok, self.rotation)

    @property
    def _tenth(self) -> Column:
        """Slices that the books don't see; equal ones are on one side."""
        return F.pmod(F.xxhash64("x"), F.lit(10)) == 0

    @cached_property
    def codewords(self) -> DataFrame:
        """Trained once; the driver holds SUB books of ``words`` (16 unless given) short vectors."""
        book = index.train_codebooks(self.slices.where(~self._tenth).select("s", "x"), self.words or 16)
        return self.spark.createDataFrame(book.collect(), book.schema)

    @cached_property
    def errors(self) -> DataFrame:
        """s, mse, rel_err of the books on the tenth of slices that they didn't see."""
        return index.codebook_error(self.slices.where(self._tenth).select("s", "x"), self.codewords)


DOT = "list_inner_product({}, {})"

PRE = f"""
WITH tok AS MATERIALIZED (
  SELECT CAST(floor(vec_id/5.0) AS BIGINT) AS pid, CAST(vec_id % 5 AS INTEGER) AS pos, vec_id AS tok_id, label, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings
), qtok AS (SELECT pid AS qid, pos AS qt, emb FROM tok WHERE pid % 10 = 0),
q AS (SELECT DISTINCT qid FROM qtok), p AS (SELECT DISTINCT pid FROM tok),
cen AS (SELECT CAST(floor(tok_id/16.0) AS BIGINT) AS cid, emb FROM tok WHERE tok_id % 16 = 3),
rk AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY qid, qt ORDER BY round(score, 6) DESC, cid) AS rn
  FROM (SELECT qid, qt, cid, list_inner_product(qtok.emb, cen.emb) AS score FROM qtok, cen)
), codes AS MATERIALIZED (
  SELECT pid, pos, tok_id, cid FROM (
    SELECT pid, pos, tok_id, cid, row_number() OVER (PARTITION BY tok_id ORDER BY round(list_inner_product(tok.emb, cen.emb), 6) DESC, cid) AS r FROM tok, cen
  ) WHERE r = 1
), ivf AS MATERIALIZED (SELECT DISTINCT cid, pid FROM codes),
ms AS MATERIALIZED (
  SELECT qid, pid, sum(m) AS score FROM (SELECT qid, qt, pid, max(list_inner_product(qtok.emb, tok.emb)) AS m FROM qtok, tok GROUP BY ALL) GROUP BY ALL
), truth AS MATERIALIZED (
  SELECT qid, rk, pid, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, pid) AS rk FROM ms) WHERE rk <= 10
), pred AS MATERIALIZED (
  SELECT pid, ({' + '.join(f"CASE WHEN ('0x' || substr(sha256('{b}:' || pid), 1, 12))::BIGINT % 10000 < {t} THEN {1 << b} ELSE 0 END" for b, t in enumerate(SHARES))}
    + (1::BIGINT << (label % 5 + 8))) | (1::BIGINT << CAST(cid % 16 + 16 AS INTEGER)) AS pred
  FROM tok JOIN codes USING (pid, pos, tok_id) WHERE pos = 0
), qrels AS (
  SELECT a.pid AS qid, b.pid FROM tok a JOIN tok b ON a.label = b.label AND a.pid <> b.pid WHERE a.pos = 0 AND b.pos = 0 AND a.pid % 10 = 0
), res AS MATERIALIZED (
  SELECT pid, pos, tok_id, cid, cen.emb AS center,
    list_transform(list_zip(tok.emb, cen.emb), lambda z: {' + '.join(f"CASE WHEN z[1] - z[2] >= {c} THEN 1 ELSE 0 END" for c in CUTS)}) AS bk
  FROM tok JOIN codes USING (pid, pos, tok_id) JOIN cen USING (cid)
), dec AS MATERIALIZED (
  SELECT pid, pos, tok_id, cid, list_transform(bk, lambda b: [{', '.join(str(w) for w in WEIGHTS)}][b + 1]::DOUBLE) AS r, center FROM res
), vecs AS (SELECT *, list_transform(list_zip(center, r), lambda z: z[1] + z[2]) AS v FROM dec),
rt AS MATERIALIZED (SELECT tok_id, pid, pos, list_transform(x, lambda e: e / greatest(sqrt(list_inner_product(x, x)), 1e-12)) AS emb FROM (SELECT *, emb[1:{ROT}] AS x FROM tok)),
rc AS (SELECT cid, list_transform(x, lambda e: e / greatest(sqrt(list_inner_product(x, x)), 1e-12)) AS emb FROM (SELECT cid, emb[1:{ROT}] AS x FROM cen)),
rq AS (SELECT pid AS qid, pos AS qt, emb FROM rt WHERE pid % 10 = 0),
subs AS (SELECT unnest(range({SUB})) AS s),
words AS (SELECT CAST(s AS INTEGER) AS s, CAST(floor(tok_id/25.0) AS INTEGER) AS eid, emb[s*{WIDTH}+1 : s*{WIDTH}+{WIDTH}] AS w FROM tok, subs WHERE tok_id % 25 = 7),
rrk AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY qid, qt ORDER BY round(score, 6) DESC, cid) AS rn
  FROM (SELECT qid, qt, cid, list_inner_product(rq.emb, rc.emb) AS score FROM rq, rc)
), act AS MATERIALIZED (
  SELECT tok_id, s FROM (
    SELECT tok_id, s, row_number() OVER (PARTITION BY tok_id ORDER BY round(list_inner_product(emb[s*{WIDTH}+1 : s*{WIDTH}+{WIDTH}], emb[s*{WIDTH}+1 : s*{WIDTH}+{WIDTH}]), 9) DESC, s) AS r FROM rt, subs
  ) WHERE r <= 4
), rcodes AS MATERIALIZED (
  SELECT pid, tok_id, cid FROM (
    SELECT pid, tok_id, cid, row_number() OVER (PARTITION BY tok_id ORDER BY round(list_inner_product(rt.emb, rc.emb), 6) DESC, cid) AS r FROM rt, rc
  ) WHERE r = 1
), postings AS MATERIALIZED (
  SELECT DISTINCT s, cid, eid, pid FROM (
    SELECT c.pid, c.cid, a.s, w.eid, row_number() OVER (PARTITION BY c.tok_id, a.s ORDER BY round(list_sum(list_transform(list_zip(t.emb[a.s*{WIDTH}+1 : a.s*{WIDTH}+{WIDTH}], rc.emb[a.s*{WIDTH}+1 : a.s*{WIDTH}+{WIDTH}], w.w), lambda z: (z[1] - z[2] - z[3]) * (z[1] - z[2] - z[3]))), 9), w.eid) AS r
    FROM rcodes c JOIN rt t USING (tok_id) JOIN act a USING (tok_id) JOIN rc ON rc.cid = c.cid JOIN words w ON w.s = a.s
  ) WHERE r = 1
)
"""


def sql(body: str) -> str:
    """``body`` over the views; it may go on with more of them (", name AS (...) SELECT ...")."""
    return PRE + body
