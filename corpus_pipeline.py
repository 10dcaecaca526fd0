"""From raw documents to packed training sequences.

Each stage takes the documents that the stage before it left and returns
documents; the last returns the pieces of packed sequences.

1. quality: documents whose calibrated score is below 0.3 go.  Null and empty
   texts have a score like others.
2. jaccard: of each group of near copies (five-word shingles, similarity 0.8 or
   more), the document with the least id stays; of repeated rows one does.
   Documents without words are near nothing and stay.
3. suffix: bytes of 50-byte passages that an earlier document has are cut out,
   and with them the rest of a character that a cut goes through; a document of
   which nothing is left goes.  Documents with a null id stay as they are.
4. mix: sources are drawn to their target weights in blocks of words.  A row is
   what one pass over its source takes of a document, so up to three rows have
   one id.  Documents without words hold nothing to draw and go.
5. pack: tokens are packed along a space-filling curve; a null text is empty.

Every stage gives no rows for no rows, and keeps columns that it doesn't know,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import op03_mix, op04_jaccard, op08_quality, op09_suffix, op10_pack
from quillon.llm.common import dropped, labelled_sample, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op08_quality.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", op08_quality.ROWS))
    return op08_quality.kept(docs, model)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op04_jaccard.representatives(docs)


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = op09_suffix.dedup(docs, as_text=True).where((F.col("dedup.n_removed") == 0) | (F.length("dedup.kept") > 0))
    text = F.when(F.col("dedup.n_removed") > 0, F.col("dedup.kept")).otherwise(F.col("text"))
    return cut.select(*[text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op03_mix.Mix(docs).texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_pack.pack(docs, op10_pack.public_paths())


STAGES = [("quality", quality), ("jaccard", jaccard), ("suffix", suffix), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None  # the classifier and the packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
