"""Making an evaluation set: where sub-collections lie in a joint one, and who answers what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def text_key(text) -> object:
    return F.sha2(text.cast("binary"), 256)


def block_offset(joint: DataFrame, part: DataFrame) -> DataFrame:
    """The offset at which ``part`` (pid, text) lies in ``joint`` as one block; none or several is an error."""
    u, d = (x.select(F.col("pid").alias(n), text_key(F.col("text")).alias("h")) for x, n in ((joint, "u"), (part, "d")))
    n = part.count()
    hit = u.join(d, "h").groupBy((F.col("u") - F.col("d")).alias("offset")).agg(F.countDistinct("d").alias("n")).where(F.col("n") == n)
    one = hit.agg(F.count("*").alias("k"), F.min("offset").alias("offset"))
    return one.select(F.when(F.col("k") == 1, F.col("offset")).otherwise(F.raise_error(F.lit("the part doesn't lie in the collection exactly once")).cast("long")).alias("offset"), F.lit(n).cast("long").alias("count"))


def tiled(ranges: DataFrame, total: int) -> DataFrame:
    """Ranges (first, count) with ok: each starts where the one before ended, and the last ends at ``total``."""
    w = Window.orderBy("first")
    end = F.col("first") + F.col("count")
    d = ranges.withColumn("start_ok", F.col("first") == F.coalesce(F.lag(end).over(w), F.lit(0)))
    return d.withColumn("ok", F.col("start_ok") & (F.coalesce(F.lead("first").over(w), F.lit(total)) == end)).drop("start_ok")


def mapped_answers(answers: DataFrame, layout: DataFrame) -> DataFrame:
    """(domain, kind, qid, pid in the domain) -> qid ``domain.kind.qid`` and pid in the joint collection."""
    d = answers.join(layout, "domain")
    inside = (F.col("pid") >= 0) & (F.col("pid") < F.col("count"))
    pid = F.when(inside, F.col("pid") + F.col("first")).otherwise(F.raise_error(F.lit("an answer lies outside its domain")).cast("long"))
    return d.select(F.concat_ws(".", "domain", "kind", F.col("qid").cast("string")).alias("qid"), pid.alias("pid"))


def hashed_words(docs: DataFrame, most: int | None = None) -> DataFrame:
    """pid, pos, word and the hex digits h of its SHA-256: each word, or each of the first ``most``."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    words = words if most is None else F.slice(words, 1, most)
    return docs.select("pid", F.posexplode(words).alias("pos", "word")).withColumn("h", F.sha2(F.col("word").cast("binary"), 256))


def hashed_sign(digit: Column, dim: int) -> Column:
    """A hex digit's coordinate in a unit vector of ``dim`` signs: negative for an odd one."""
    one = 1 / float(dim) ** 0.5
    return F.when(digit.isin(*"13579bdf"), F.lit(-one)).otherwise(F.lit(one))


def hashed_encoder(docs: DataFrame, dim: int, most: int | None = None) -> DataFrame:
    """A stand-in for a neural encoder: pid, pos, word and a unit vector of signs by the word's hash.

    Each word is a token, or each of the first ``most`` (32 in a query); ``dim``
    is at most 64, the hex digits of SHA-256.
    """
    if dim > 64:
        raise ValueError("at most 64 dimensions")
    sign = F.transform(F.split(F.substring("h", 1, dim), "(?<=.)(?=.)"), lambda c: hashed_sign(c, dim))
    return hashed_words(docs, most).select("pid", "pos", "word", sign.alias("emb"))
