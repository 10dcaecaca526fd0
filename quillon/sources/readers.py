"""Test-collection files as DataFrames.

Each format has a parser over a DataFrame of lines (``value``) and a reader of a
path; parsers never infer a schema.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.matrix import held, ready


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _fields(sep: str = "\t") -> Column:
    return F.split(F.col("value"), sep)


def questions(df: DataFrame) -> DataFrame:
    """qid <tab> text; lines with fewer than two fields are skipped."""
    d = df.withColumn("f", _fields()).where(F.size("f") >= 2)
    return d.select(F.trim(F.element_at("f", 1)).alias("qid"), F.element_at("f", 2).alias("text"))


def qrels(df: DataFrame) -> DataFrame:
    """qid, 0, pid, rel or qid, pid, rel; each relevant pair once."""
    d = df.withColumn("f", _fields(r"\s+")).where(F.size("f") >= 3)
    wide = F.size("f") >= 4
    pid, rel = F.when(wide, F.element_at("f", 3)).otherwise(F.element_at("f", 2)), F.when(wide, F.get("f", F.lit(3))).otherwise(F.element_at("f", 3))
    return d.select(F.element_at("f", 1).alias("qid"), pid.cast("long").alias("pid"), rel.cast("int").alias("rel")).where(F.col("rel") > 0).select("qid", "pid").distinct()


def collection(df: DataFrame, check: bool = False) -> DataFrame:
    """pid <tab> text; with ``check`` the ids must be 0..n-1 without gap or repeat."""
    d = df.select(F.split("value", "\t", 2).alias("f")).select(F.element_at("f", 1).cast("long").alias("pid"), F.get("f", F.lit(1)).alias("text"))
    if check:
        n, distinct, lo, hi = d.agg(F.count("*"), F.countDistinct("pid"), F.min("pid"), F.max("pid")).first()
        if n and not (n == distinct and lo == 0 and hi == n - 1):
            raise ValueError("passage ids aren't the lines' numbers")
    return d


QAS = T.StructType([T.StructField("qid", T.LongType()), T.StructField("query", T.StringType()), T.StructField("answer_pids", T.ArrayType(T.LongType()))])


def qas(df: DataFrame) -> DataFrame:
    """JSON lines of questions with their answers: qid, pid."""
    return df.select(F.from_json("value", QAS).alias("j")).select("j.qid", F.explode("j.answer_pids").alias("pid"))


def profiler_csv(df: DataFrame, metrics: list[str]) -> DataFrame:
    """A profiler's CSV log: per metric, its sum over kernels; log lines and the units row are skipped.

    The header is the line that starts with ``"ID"``; columns are found by its names.
    """
    head = df.where(F.col("value").startswith('"ID"')).limit(1).collect()
    if not head:
        raise ValueError("no header line")
    import csv

    names = next(csv.reader([head[0].value]))
    schema = ", ".join(f"`{n}` string" for n in names)
    d = df.where(F.col("value").startswith('"') & ~F.col("value").startswith('"ID"')).select(F.from_csv("value", schema).alias("c")).select("c.*")
    d = d.where(F.expr("try_cast(`ID` as long)").isNotNull())  # the units row has no number
    num = [F.sum(F.expr(f"try_cast(regexp_replace(`{m}`, ',', '') as double)")).alias(m) for m in metrics]
    return d.agg(*num, F.count("*").alias("kernels"))


def _binary_vectors(spark: SparkSession, path: str, decode) -> DataFrame:
    """path, id, vec of each file's matrix, sent on in slices of rows; files are split by file."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = decode(name, data)
                for at in range(0, len(m), 4096):
                    part = np.ascontiguousarray(m[at : at + 4096], dtype=np.float32)
                    ends = pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], ["path", "id", "vec"])

    return ready(spark).read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, id long, vec array<float>")


def fvecs(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of an ``.fvecs`` file: records of an int32 length and as many float32s, all of one length."""

    def decode(name, data):
        import numpy as np

        if not data:
            return np.zeros((0, 0), np.float32)
        d = int(np.frombuffer(data, "<i4", 1)[0])
        if len(data) % (4 + 4 * d):
            raise ValueError(f"{name}: {len(data)} bytes aren't vectors of {d}")
        return np.frombuffer(data, "<f4").reshape(-1, d + 1)[:, 1:]

    return _binary_vectors(spark, path, decode)


def npy(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """Rows of the matrix in each ``.npy`` file, or of the array ``member`` of each ``.npz`` file."""

    def decode(name, data):
        import io

        import numpy as np

        m = np.load(io.BytesIO(data), allow_pickle=False)
        m = m if member is None else m[member]
        if m.ndim != 2:
            raise ValueError(f"{name}: {m.ndim} dimensions, a matrix has two")
        return m

    return _binary_vectors(spark, path, decode)


def write_npz(path: str, **tables: tuple[DataFrame, str, str]) -> None:
    """Small tables, (table, id column, vector column) each, as ids and matrices of one ``.npz`` file; larger ones are refused."""
    import numpy as np

    arrays = {}
    for name, (df, id_col, vec_col) in tables.items():
        arrays[f"{name}_ids"], arrays[name] = held(df, id_col, vec_col)
    np.savez(path, **arrays)


def write_json(obj: Any, path: str) -> None:
    """Small results as JSON; numpy numbers and arrays become plain ones."""

    def plain(x: Any) -> Any:
        if hasattr(x, "tolist"):
            return x.tolist()
        if isinstance(x, set):
            return sorted(x)
        raise TypeError(type(x).__name__)

    with open(path, "w") as f:
        json.dump(obj, f, default=plain, indent=1)


def write_new(df: DataFrame, path: str) -> None:
    """A new version beside what is there; a table is never written over while it is read."""
    df.write.mode("errorifexists").parquet(path)


def resume(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def import_runs(runs: DataFrame, own: DataFrame, engines: list[str]) -> DataFrame:
    """Own results with those of other engines from another run over the same split."""
    differ = runs.select("split").union(own.select("split")).distinct().count()
    if differ > 1:
        raise ValueError("the runs were made on different splits")
    return own.unionByName(runs.where(F.col("engine").isin(engines)))
