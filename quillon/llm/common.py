"""What the operators share: inputs, intermediate tables, worker set-up, hashes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: What the texts that a classifier is fitted on may hold together.
SAMPLE_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers on the driver's machine import this package, and bounds what they are sent at once.

    On a cluster the package is installed or sent by ``--py-files``.  Batches of
    Arrow are cut by rows and by bytes, unless the session says otherwise, so a
    worker's memory doesn't follow the lengths of texts.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), root) if x)
    for key, most in (("maxRecordsPerBatch", "2000"), ("maxBytesPerBatch", str(4 << 20))):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one of our own on a local master, else an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", there)
    return there


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends there.

    A lost executor then costs a re-read, and a costly step runs once however
    often its result is used.  Shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if was is None else spark.conf.set(_CLEAN, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            sc = t.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def rest_of(docs: DataFrame) -> Column:
    """A hash of the columns of simple types, to tell apart rows with one id and text."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "<" not in kind and kind not in ("variant", "void")])


def held_out(name: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, size: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``rows`` labelled texts of ``size`` bytes in all outside the held-out fifth: (doc_id, text, y).

    Labels whose target or id is null are left out, of several labels of one id
    the largest counts, and labels without a document don't count.  An id with
    several texts gives each text once.  The texts are those of the least hashes
    of their ids, whole, up to the first that would pass a bound, so the choice
    doesn't depend on the layout.  Ids, hashes and lengths alone are sorted; the
    broadcast side holds at most ``rows`` of them.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull())
        .where(~held_out("id"))
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    body = text_or_empty()
    texts = docs.select(F.col("doc_id"), F.xxhash64(body).alias("th"), F.octet_length(body).cast("long").alias("bytes"))
    order = [F.xxhash64("id"), "id", "th"]
    first = texts.join(known, F.col("doc_id") == F.col("id")).select("id", "th", "bytes", "y").distinct().orderBy(*order).limit(rows)
    upto = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("upto", upto).where(F.col("upto") <= size).select("id", "th", "y")
    found = docs.select("doc_id", body.alias("text"), F.xxhash64(body).alias("_th")).join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("_th") == F.col("th")))
    return found.groupBy("doc_id", "_th", "y").agg(F.first("text").alias("text")).select("doc_id", "text", "y")


def spread(n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of every element (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)
