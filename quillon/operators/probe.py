"""Which lists to open, and what an unopened one is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .matrix import below, best

CAP, QUANTILE, SLACK = 8, 0.75, 0.5


def ranked(qtok: DataFrame, centroids: DataFrame, depth: int) -> DataFrame:
    """qid, qt, rn, cid, score of the best ``depth`` centroids of each query token."""
    return best(qtok, ["qid", "qt"], "emb", centroids, "cid", "emb", depth)


def imputed(ranks: DataFrame, nc: int) -> DataFrame:
    """The first ``nc`` lists with scores above the floor, the (nc + 1)-th score.

    A passage that misses a token would count the floor there; taking it from
    every score instead leaves the ranking as it is and only found postings matter.
    """
    w = Window.partitionBy("qid", "qt")
    floor = F.max(F.when(F.col("rn") == nc + 1, F.col("score"))).over(w)
    return ranks.where(F.col("rn") <= nc + 1).withColumn("floor", floor).where(F.col("rn") <= nc).withColumn("base", F.col("score") - F.col("floor"))


def plain(ranks: DataFrame, nc: int) -> DataFrame:
    return ranks.where(F.col("rn") <= nc).withColumn("base", F.col("score"))


def list_counts(ivf: DataFrame, passing: DataFrame) -> DataFrame:
    """cid, tot, pass: postings of each list, and those that pass the filter (pid)."""
    ok = passing.select("pid").distinct().withColumn("ok", F.lit(1))
    return ivf.join(ok, "pid", "left").groupBy("cid").agg(F.count("*").alias("tot"), F.count("ok").alias("pass"))


def adaptive(ranks: DataFrame, counts: DataFrame, nc: int, ncap: int, selectivity: float, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """qid, nc_eff: how many lists to open so that enough passing postings are met.

    ``ranks`` reach at least ``ncap``.  A token is short when its first ``nc``
    lists hold fewer passing postings than ``slack`` times what the filter's
    selectivity leads one to expect; when more than 1 - quantile of the tokens
    are, the query opens as many lists as that quantile of them needs.
    """
    d = ranks.where(F.col("rn") <= ncap).join(counts.select("cid", "tot", "pass"), "cid", "left").fillna(0, ["tot", "pass"])
    cum = F.sum("pass").over(Window.partitionBy("qid", "qt").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    first = F.col("rn") <= nc
    d = d.withColumn("cum", cum)
    tok = d.groupBy("qid", "qt").agg(
        (F.lit(selectivity) * F.sum(F.when(first, F.col("tot")).otherwise(0))).alias("target"),
        F.sum(F.when(first, F.col("pass")).otherwise(0)).alias("have"),
        F.collect_list("cum").alias("cums"),
    )
    need = F.least(F.greatest(F.size(F.filter("cums", lambda c: c < F.col("target"))) + 1, F.lit(nc)), F.lit(ncap))
    tok = tok.withColumn("short", (F.col("have") < F.lit(slack) * F.col("target")).cast("double")).withColumn("need", need)
    per = tok.groupBy("qid").agg(F.avg("short").alias("share"), F.expr(f"percentile(need, {quantile})").alias("q"))
    wide = F.least(F.greatest(F.ceil("q"), F.lit(nc)), F.lit(ncap))
    return per.select("qid", F.when(F.col("share") <= 1 - quantile + 1e-9, F.lit(nc)).otherwise(wide).cast("int").alias("nc_eff"))


def probed_to(ranks: DataFrame, depth: DataFrame) -> DataFrame:
    """Imputed probing with a depth of its own for each query (qid, nc_eff)."""
    d = ranks.join(depth, "qid")
    floor = F.max(F.when(F.col("rn") == F.col("nc_eff") + 1, F.col("score"))).over(Window.partitionBy("qid", "qt"))
    return d.withColumn("floor", floor).where(F.col("rn") <= F.col("nc_eff")).withColumn("base", F.col("score") - F.col("floor"))


def passing(centroids: DataFrame, counts: DataFrame) -> DataFrame:
    """The centroids whose lists hold a passing posting; ranks among them skip the others."""
    return centroids.join(counts.where(F.col("pass") > 0).select("cid"), "cid", "left_semi")


def nonempty(ranks: DataFrame, counts: DataFrame) -> DataFrame:
    """Ranks among the centroids whose lists hold a passing posting."""
    d = ranks.join(counts.where(F.col("pass") > 0).select("cid"), "cid", "left_semi")
    w = Window.partitionBy("qid", "qt").orderBy("rn")
    return d.withColumn("deep", F.col("rn")).withColumn("rn", F.row_number().over(w))


def unfiltered_depth(ranks: DataFrame, probe: DataFrame) -> DataFrame:
    """Per query, the mean over tokens of how many centroids score at least the last probed one."""
    last = probe.groupBy("qid", "qt").agg(F.min("score").alias("last"))
    d = ranks.join(last, ["qid", "qt"]).where(F.col("score") >= F.col("last")).groupBy("qid", "qt").agg(F.count("*").alias("depth"))
    return d.groupBy("qid").agg(F.avg("depth").alias("depth"))


def with_floor(probe: DataFrame, qtok: DataFrame, among: DataFrame) -> DataFrame:
    """Scores above the best score of a centroid of ``among`` that is less than the last probed one."""
    last = probe.groupBy("qid", "qt").agg(F.min("score").alias("last"))
    floor = below(qtok.join(last, ["qid", "qt"]), ["qid", "qt"], "emb", "last", among, "cid", "emb").withColumnRenamed("best", "floor")
    return probe.drop("floor", "base").join(floor, ["qid", "qt"]).withColumn("base", F.col("score") - F.col("floor"))
