"""An index that is written once and read by every engine.

``build`` writes what the engines otherwise derive from tokens within a query:
codes, lists, residuals, codebooks and postings.  Lists are sorted by centroid
(postings by slice, centroid and codeword), so the footers' least and greatest
values let a scan skip row groups of lists that no query opens.  ``Stored`` has
the same views as ``Fixtures``, read from there.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from .fixtures import ROT, SUB, WIDTH, Fixtures

#: The tables of an index, and the keys that each is sorted by.
TABLES = {
    "tok": ["tok_id"], "passages": ["pid"], "queries": ["qid"], "qtok": ["qid", "qt"], "cen": ["cid"],
    "codes": ["cid"], "ivf": ["cid"], "residual": ["cid"], "pred": ["pid"],
    "rtok": ["tok_id"], "rcen": ["cid"], "rqtok": ["qid", "qt"], "codewords": ["s", "eid"], "postings": ["s", "cid", "eid"],
}


def build(x: Fixtures, path: str) -> DataFrame:
    """Writes the index of ``x`` under a new folder and returns the checks of its lists, all of which must hold."""
    for name, keys in TABLES.items():
        getattr(x, name).repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{path}/{name}")
    meta = {"rotation": ROT, "entries": x.spark.read.parquet(f"{path}/codewords").select("eid").distinct().count(), "subspaces": SUB, "width": WIDTH}
    x.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{path}/meta")
    return check(Stored(x.spark, path))


def check(x: Stored) -> DataFrame:
    """Facts of the plain lists, and whether postings name known codewords and tokens are all there."""
    lists = index.checked(x.ivf, x.passages, ["cid"])
    unknown = x.postings.join(x.codewords.select("s", "eid"), ["s", "eid"], "left_anti").agg((F.count("*") == 0).alias("eids_known"))
    seen = x.codes.agg((F.countDistinct("tok_id") == F.count("*")).alias("tokens_once"), F.count("*").alias("coded"))
    tokens = x.tok.agg(F.count("*").alias("tokens"))
    d = lists.join(F.broadcast(unknown)).join(F.broadcast(seen)).join(F.broadcast(tokens))  # a row each
    return d.withColumn("tokens_covered", F.col("coded") == F.col("tokens")).drop("coded", "tokens")


class Stored(Fixtures):
    """The views of an index that ``build`` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self.meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        index.compatible(self.meta | {"rotation": ROT, "top_m": None}, self.meta | {"top_m": None})

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}")


def _view(name: str) -> cached_property:
    made = cached_property(lambda self: self.read(name))
    made.__set_name__(Stored, name)
    return made


for _name in TABLES:
    setattr(Stored, _name, _view(_name))
