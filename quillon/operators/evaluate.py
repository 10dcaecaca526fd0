"""Retrieval metrics, intervals and the choice of operating points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec


def split(questions: DataFrame, tune: int, seed: int) -> DataFrame:
    """qid, part: the ``tune`` questions of least seeded hash are for tuning."""
    h = vec.hash48(F.concat(F.lit(f"{seed}:"), F.col("qid").cast("string")))
    least = questions.select("qid").distinct().withColumn("h", h).orderBy("h", "qid").limit(tune).select("qid", F.lit("tune").alias("_t"))
    return questions.select("qid").distinct().join(least, "qid", "left").select("qid", F.coalesce("_t", F.lit("test")).alias("part"))


def judged(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """Rankings with rel: whether the passage is relevant to the query."""
    return ranking.join(qrels.select("qid", "pid").distinct().withColumn("rel", F.lit(1)), ["qid", "pid"], "left").fillna(0, ["rel"])


def metrics(ranking: DataFrame, qrels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, mrr, success and recall at ``k`` of every query."""
    j = judged(ranking, qrels).where(F.col("rk") <= k)
    per = j.groupBy("qid").agg(F.min(F.when(F.col("rel") == 1, F.col("rk"))).alias("first"), F.sum("rel").alias("hits"))
    n = qrels.select("qid", "pid").distinct().groupBy("qid").agg(F.count("*").alias("n_rel"))
    d = queries.select("qid").distinct().join(per, "qid", "left").join(n, "qid", "left")
    return d.select(
        "qid", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("success"),
        F.when(F.col("n_rel") > 0, F.coalesce("hits", F.lit(0)) / F.col("n_rel")).otherwise(0.0).alias("recall"),
    )


def truth_recall(ranking: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Share of the exact top ``k`` that the ranking's top ``k`` holds; null without any exact answer."""
    t = truth.where(F.col("rk") <= k).select("qid", "pid")
    hit = t.join(ranking.where(F.col("rk") <= k).select("qid", "pid").withColumn("hit", F.lit(1)), ["qid", "pid"], "left")
    per = hit.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
    return queries.select("qid").distinct().join(per, "qid", "left")


def ground_truth(spark: SparkSession, path: str, filters: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """filter, qid, rk, pid, score: each filter's exact answers, written under ``path`` as they are made.

    A filter that is there whole isn't made again; one whose writing was cut off
    is.  Runs over different filters add up in one folder.
    """
    sc = spark.sparkContext
    conf, named = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.Path
    for name, made in filters.items():
        done = named(f"{path}/filter={name}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            made().select("qid", "rk", "pid", "score").write.mode("overwrite").parquet(f"{path}/filter={name}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/filter={n}" for n in filters]).withColumn("filter", F.col("filter").cast("string"))


def official(ranking: DataFrame, qrels: DataFrame, queries: DataFrame, kind: str, filt: str) -> DataFrame:
    """mrr@10 or success@5, for the filters that the judgements were made under; null for others."""
    name, k = {"mrr@10": ("mrr", 10), "success@5": ("success", 5)}[kind]
    m = metrics(ranking, qrels, queries, k).select("qid", F.col(name).alias("value"))
    return m if filt in ("all", "own_domain") else m.withColumn("value", F.lit(None).cast("double"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """qid, common: how many of the two top ``k`` are the same."""
    x, y = (d.where(F.col("rk") <= k).select("qid", "pid") for d in (a, b))
    return a.select("qid").distinct().join(x.join(y, ["qid", "pid"]).groupBy("qid").agg(F.count("*").alias("c")), "qid", "left").select("qid", F.coalesce("c", F.lit(0)).alias("common"))


def bootstrap(values: DataFrame, n_boot: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Mean and percentile interval of ``value`` over resamples; nulls and NaNs are dropped.

    Resample b draws row ``hash(seed:b:i) mod n`` for i in 0..n-1.  Draws are
    spread over the cluster by resample; values are one a query.
    """
    w = Window.orderBy("qid")
    v = values.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("i", F.row_number().over(w) - 1)
    n = v.count()
    draws = values.sparkSession.range(n_boot).select(F.col("id").alias("b")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    at = (vec.hash48(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))) % max(n, 1)).cast("int")
    means = draws.withColumn("i", at).join(v.select("i", "value"), "i").groupBy("b").agg(F.avg("value").alias("m"))
    ends = means.agg(F.expr(f"percentile(m, {alpha / 2})").alias("lo"), F.expr(f"percentile(m, {1 - alpha / 2})").alias("hi"))
    return v.agg(F.avg("value").alias("mean"), F.count("*").alias("n")).join(F.broadcast(ends))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, value: a - b where both have one."""
    x = a.select("qid", F.col("value").alias("x"))
    d = x.join(b.select("qid", F.col("value").alias("y")), "qid").where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    return d.select("qid", (F.col("x") - F.col("y")).alias("value"))


def latency_summary(lat: DataFrame, by: list[str], col: str = "lat") -> DataFrame:
    q = lambda p: F.expr(f"percentile({col}, {p})")
    return lat.groupBy(*by).agg(q(0.5).alias("median"), F.avg(col).alias("mean"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max(col).alias("max"), F.count(col).alias("n"))


def pareto(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Points better than every faster one: strictly greater ``quality`` along rising ``lat``."""
    w = Window.partitionBy(*(by or [])).orderBy("lat", F.desc("quality"), "config").rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("_best", F.max("quality").over(w)).where(F.col("_best").isNull() | (F.col("quality") > F.col("_best"))).drop("_best")


def fastest(points: DataFrame, target: Column | float, by: list[str]) -> DataFrame:
    """The fastest configuration of each group that reaches the target (no row if none does)."""
    d = points.where(F.col("quality") >= target)
    return d.groupBy(*by).agg(F.min(F.struct("lat", "config", "quality")).alias("b")).select(*by, "b.*")


def primary(points: DataFrame, targets: list[float]) -> DataFrame:
    """The highest target that every engine reaches: one row, or an error when there is none."""
    t = F.explode(F.array(*[F.lit(x) for x in targets]))
    n = points.select("engine").distinct().count()
    d = points.groupBy("engine").agg(F.max("quality").alias("q")).withColumn("target", t).where(F.col("q") >= F.col("target"))
    best = d.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") == n).agg(F.max("target").alias("target"))
    return best.select(F.coalesce("target", F.raise_error(F.lit("no target is reached by all engines")).cast("double")).alias("target"))


def fallback(points: DataFrame, target: float) -> DataFrame:
    """Each engine's target: the primary one, or the best it reaches."""
    return points.groupBy("engine").agg(F.least(F.max("quality"), F.lit(target)).alias("target"))


def starvation(ranking: DataFrame, queries: DataFrame, least: int = 10) -> DataFrame:
    """Share of queries with fewer than ``least`` results."""
    n = ranking.groupBy("qid").agg(F.count("*").alias("n"))
    return queries.select("qid").distinct().join(n, "qid", "left").agg(F.avg(F.when(F.coalesce("n", F.lit(0)) < least, 1.0).otherwise(0.0)).alias("starved"))


def stale(runs: DataFrame, main: str, hours: int = 6) -> DataFrame:
    """Runs with a flag: older than the main run by more than ``hours``."""
    at = runs.where(F.col("run") == main).select(F.col("ts").alias("_m"))
    return runs.join(F.broadcast(at.limit(1))).withColumn("stale", F.col("ts") < F.col("_m") - F.expr(f"INTERVAL {hours} HOURS")).drop("_m")
