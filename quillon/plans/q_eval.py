"""Registered queries: sources, evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec
from ..operators import collection, evaluate
from ..sources import readers
from .engines import Params, search
from .fixtures import Fixtures
from .q_engines import IMPUTED, _ivf, _sql
from .q_index import q
from .registry import register

r6 = vec.r6
P = Params()


def raw(name: str, body: str | None = None):
    def keep(f):
        register(name, body)(lambda spark, sf_dir: f(Fixtures(spark, sf_dir)))
        return f

    return keep


# Sources -------------------------------------------------------------------
@raw("IO1_questions", "SELECT CAST(doc_id AS VARCHAR) AS qid, source AS text FROM documents WHERE doc_id % 3 <> 0")
def _(x):
    line = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit("\t"), "source"))
    return readers.questions(x.read("documents").select(line.alias("value")))


@raw("IO2_qrels", "SELECT CAST(doc_id AS VARCHAR) AS qid, doc_id * 7 % 100 AS pid FROM documents WHERE doc_id % 3 > 0")
def _(x):
    i = F.col("doc_id").cast("string")
    pid = (F.col("doc_id") * 7 % 100).cast("string")
    rel = (F.col("doc_id") % 3).cast("string")
    line = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("\t", i, F.lit("0"), pid, rel)).otherwise(F.concat_ws("\t", i, pid, rel))
    return readers.qrels(x.read("documents").select(line.alias("value")))


@raw("IO3_collection", "SELECT doc_id AS pid, source || chr(9) || lang AS text FROM documents")
def _(x):
    return readers.collection(x.read("documents").select(F.concat_ws("\t", F.col("doc_id").cast("string"), "source", "lang").alias("value")), check=True)


@raw("IO4_answers", "SELECT doc_id AS qid, doc_id + k AS pid FROM documents, (SELECT unnest([1, 2]) AS k)")
def _(x):
    d = x.read("documents").select(F.to_json(F.struct(F.col("doc_id").alias("qid"), F.col("source").alias("query"), F.array(F.col("doc_id") + 1, F.col("doc_id") + 2).alias("answer_pids"))).alias("value"))
    return readers.qas(d)


@q("IO9_pad_rows", "SELECT count(*) AS n FROM tok")
def _(x):
    n = x.tok.count()
    return x.spark.createDataFrame([(index_tokens(n),)], "n long")


def index_tokens(n: int) -> int:
    from ..operators.index import real_tokens

    return real_tokens(n + 512, n)


@raw("IO11_profiler_csv", "SELECT 3000.0::DOUBLE AS dram, 30.0::DOUBLE AS ms, CAST(2 AS BIGINT) AS kernels")
def _(x):
    text = ['==PROF== log', '"ID","Kernel","dram","ms"', '"","","byte","ms"', '"0","a","1,000","10"', '==PROF== more', '"1","b","2,000","20"']
    return readers.profiler_csv(x.spark.createDataFrame([(t,) for t in text], "value string"), ["dram", "ms"])


@q("IO12_export", "SELECT tok_id, round(v[1] / sqrt(list_inner_product(v, v) + 1e-12), 6) AS first FROM vecs")
def _(x):
    from ..functions import codec
    from .fixtures import WEIGHTS

    return x.residual.select("tok_id", r6(F.element_at(codec.decompressed(F.col("center"), F.col("data"), WEIGHTS), 1)).alias("first"))


@raw("IO14_resume", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0")
def _(x):
    d = x.read("documents").select("doc_id")
    return readers.resume(d, d.where(F.col("doc_id") % 4 == 0), "doc_id")


@raw("IO15_import_runs", "SELECT 's1' AS split, e AS engine, CAST(v AS DOUBLE) AS quality FROM (VALUES ('ivf', 0.5), ('staged', 0.7)) t(e, v)")
def _(x):
    own = x.spark.createDataFrame([("s1", "ivf", 0.5)], "split string, engine string, quality double")
    other = x.spark.createDataFrame([("s1", "staged", 0.7), ("s1", "other", 0.1)], "split string, engine string, quality double")
    return readers.import_runs(other, own, ["staged"])


@raw("B10_layout", "SELECT CAST(f AS BIGINT) AS first, CAST(c AS BIGINT) AS count, ok FROM (VALUES (0, 10, true), (10, 5, false), (16, 4, false)) t(f, c, ok)")
def _(x):
    return collection.tiled(x.spark.createDataFrame([(0, 10), (10, 5), (16, 4)], "first long, count long"), 20)


@raw("B10_answers", "WITH l AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents)) SELECT source || '.search.' || doc_id AS qid, doc_id % 5 + 5 * i AS pid FROM documents JOIN l USING (source)")
def _(x):
    docs = x.read("documents")
    d = docs.select(F.col("source").alias("domain"), F.lit("search").alias("kind"), F.col("doc_id").alias("qid"), (F.col("doc_id") % 5).alias("pid"))
    n = F.row_number().over(Window.orderBy("domain")) - 1  # a row for each source
    layout = docs.select(F.col("source").alias("domain")).distinct().select("domain", (n * 5).cast("long").alias("first"), F.lit(5).cast("long").alias("count"))
    return collection.mapped_answers(d, layout)


# Metrics -------------------------------------------------------------------
@raw("V1_split", "SELECT doc_id AS qid, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(sha256('7:' || doc_id), 1, 12))::BIGINT, doc_id) <= 50 THEN 'tune' ELSE 'test' END AS part FROM documents")
def _(x):
    return evaluate.split(x.read("documents").select(F.col("doc_id").alias("qid")), 50, 7)


_METRICS = ", j AS (SELECT truth.qid, rk, CASE WHEN r.pid IS NULL THEN 0 ELSE 1 END AS rel FROM truth LEFT JOIN (SELECT DISTINCT * FROM qrels) r USING (qid, pid)), n AS (SELECT qid, count(DISTINCT pid) AS n FROM qrels GROUP BY qid), m AS (SELECT q.qid, coalesce(1.0 / min(rk) FILTER (WHERE rel = 1), 0) AS mrr, CASE WHEN max(rel) = 1 THEN 1.0 ELSE 0.0 END AS success, coalesce(sum(rel) / any_value(n), 0) AS recall FROM q LEFT JOIN j USING (qid) LEFT JOIN n USING (qid) GROUP BY q.qid)"

for _name, _col in (("V2_mrr", "mrr"), ("V3_success", "success"), ("V4_recall", "recall")):

    @q(_name, f"{_METRICS} SELECT qid, round({_col}, 6) AS v FROM m")
    def _(x, c=_col):
        return evaluate.metrics(x.truth, x.qrels, x.queries, 10).select("qid", r6(F.col(c)).alias("v"))


def _engine_sql(tail: str) -> str:
    body = _ivf(IMPUTED, 0)
    at = body.rindex(" SELECT qid, CAST(rk AS INTEGER)")
    return f"{body[:at]}, run AS ({body[at:]}) {tail}"


_GT = "g AS (SELECT t.qid, avg(CASE WHEN r.pid IS NULL THEN 0.0 ELSE 1.0 END) AS recall FROM truth t LEFT JOIN run r USING (qid, pid) GROUP BY t.qid)"


@q("V5_truth_recall", _engine_sql(f", {_GT} SELECT qid, round(recall, 6) AS recall FROM q LEFT JOIN g USING (qid)"))
def _(x):
    return evaluate.truth_recall(search("E11_ivf_impute", x, P), x.truth, x.queries, 10).select("qid", r6(F.col("recall")).alias("recall"))


@q("V6_official", f"{_METRICS} SELECT qid, round(mrr, 6) AS value FROM m")
def _(x):
    return evaluate.official(x.truth, x.qrels, x.queries, "mrr@10", "all").select("qid", r6(F.col("value")).alias("value"))


_BOOT = ", v AS (SELECT {val} AS value, row_number() OVER (ORDER BY qid) - 1 AS i FROM {src} WHERE {val} IS NOT NULL), bn AS (SELECT count(*) AS n FROM v), d AS (SELECT b, ('0x' || substr(sha256('0:' || b || ':' || j), 1, 12))::BIGINT % n AS i FROM bn, range(200) x(b), range(n) y(j)), bm AS (SELECT b, avg(value) AS m FROM d JOIN v USING (i) GROUP BY b) SELECT round((SELECT avg(value) FROM v), 6) AS mean, (SELECT n FROM bn) AS n, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM bm"


def _rounded(d):
    return d.select(r6(F.col("mean")).alias("mean"), "n", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@q("V7_bootstrap", _METRICS + _BOOT.format(val="recall", src="m"))
def _(x):
    return _rounded(evaluate.bootstrap(evaluate.metrics(x.truth, x.qrels, x.queries, 10).select("qid", F.col("recall").alias("value")), 200))


@q("V8_paired_difference", _METRICS + ", pd AS (SELECT qid, mrr - recall AS value FROM m)" + _BOOT.format(val="value", src="pd"))
def _(x):
    m = evaluate.metrics(x.truth, x.qrels, x.queries, 10)
    d = evaluate.paired(m.select("qid", F.col("mrr").alias("value")), m.select("qid", F.col("recall").alias("value")))
    return _rounded(evaluate.bootstrap(d, 200))


def _lat(x):
    return x.read("events").select(F.col("event_type").alias("engine"), (F.col("user_id") % 7).alias("config"), F.col("value").alias("lat"))


for _name in ("V9_latency", "A16_latency"):

    @raw(_name, "SELECT event_type AS engine, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, count(value) AS n FROM events GROUP BY event_type")
    def _(x):
        d = evaluate.latency_summary(_lat(x), ["engine"])
        return d.select("engine", *[r6(F.col(c)).alias(c) for c in ("median", "mean", "p95", "p99")], "max", "n")


_POINTS = "WITH pts AS (SELECT event_type AS engine, user_id % 7 AS config, round(avg(value), 6) AS lat, round(avg(event_id % 100) / 100, 6) AS quality FROM events GROUP BY ALL)"


def _points(x):
    d = x.read("events").groupBy(F.col("event_type").alias("engine"), (F.col("user_id") % 7).alias("config"))
    return d.agg(r6(F.avg("value")).alias("lat"), r6(F.avg(F.col("event_id") % 100) / 100).alias("quality"))


for _name in ("V10_pareto", "T13_running_best"):

    @raw(_name, f"{_POINTS}, b AS (SELECT *, max(quality) OVER (PARTITION BY engine ORDER BY lat, quality DESC, config ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM pts) SELECT engine, config, lat, quality FROM b WHERE best IS NULL OR quality > best")
    def _(x):
        return evaluate.pareto(_points(x), ["engine"])


@raw("V11_fastest", f"{_POINTS} SELECT engine, lat, config, quality FROM (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY lat, config) AS r FROM pts WHERE quality >= 0.45) WHERE r = 1")
def _(x):
    return evaluate.fastest(_points(x), 0.45, ["engine"])


@raw("V12_primary_point", f"{_POINTS}, e AS (SELECT engine, max(quality) AS q FROM pts GROUP BY engine) SELECT max(t) AS target FROM (SELECT t FROM e, (SELECT unnest([0.3, 0.4, 0.45, 0.5, 0.9]::DOUBLE[]) AS t) WHERE q >= t GROUP BY t HAVING count(*) = (SELECT count(*) FROM e))")
def _(x):
    return evaluate.primary(_points(x), [0.3, 0.4, 0.45, 0.5, 0.9])


@raw("V13_fallback_point", f"{_POINTS} SELECT engine, least(max(quality), 0.5::DOUBLE) AS target FROM pts GROUP BY engine")
def _(x):
    return evaluate.fallback(_points(x), 0.5)


@q("V14_sweep", ", ".join(["", "sw AS (SELECT nc, rk.qid, rk.qt, rk.cid, rk.score - f.score AS base FROM (SELECT unnest([1, 2, 4]) AS nc), rk JOIN rk f ON f.qid = rk.qid AND f.qt = rk.qt WHERE rk.rn <= nc AND f.rn = nc + 1)", "ap AS (SELECT nc, qid, pid, sum(b) AS a FROM (SELECT nc, qid, qt, pid, max(base) AS b FROM sw JOIN ivf USING (cid) WHERE base > 0 GROUP BY ALL) GROUP BY ALL)", "cd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nc, qid ORDER BY round(a, 6) DESC, pid) AS r FROM ap) WHERE r <= 20)", "fin AS (SELECT nc, qid, pid FROM (SELECT nc, cd.qid, cd.pid, row_number() OVER (PARTITION BY nc, cd.qid ORDER BY round(score, 6) DESC, cd.pid) AS r FROM cd JOIN ms USING (qid, pid)) WHERE r <= 10)", "rc2 AS (SELECT n.nc, t.qid, avg(CASE WHEN f.pid IS NULL THEN 0.0 ELSE 1.0 END) AS rec FROM truth t CROSS JOIN (SELECT unnest([1, 2, 4]) AS nc) n LEFT JOIN fin f ON f.nc = n.nc AND f.qid = t.qid AND f.pid = t.pid GROUP BY ALL)"]) + " SELECT CAST(nc AS INTEGER) AS nc, round(avg(rec), 6) AS recall FROM rc2 GROUP BY nc")
def _(x):
    out = None
    for nc in (1, 2, 4):
        r = evaluate.truth_recall(search("E11_ivf_impute", x, Params(nc=nc)), x.truth, x.queries, 10)
        one = r.agg(F.lit(nc).alias("nc"), r6(F.avg("recall")).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


#: Filters by share of passages, and the engines that are held against each other under them.
FILTERED = {"syn5": 1, "syn14": 2, "syn30": 4}
COMPARED = ("E2_staged_early", "E11_ivf_impute", "E18_ivf_adaptive")


def _filtered_sql(tail: str) -> str:
    nested = lambda body: f"(WITH {body.lstrip(', ')})" if body.startswith(", ") else f"({body})"
    runs = " UNION ALL ".join(f"SELECT '{f}' AS filter, '{e}' AS engine, qid, pid FROM {nested(_sql(e, m))}" for f, m in FILTERED.items() for e in COMPARED)
    exact = " UNION ALL ".join(f"SELECT '{f}' AS filter, qid, pid FROM {nested(_sql('E0_exact', m))}" for f, m in FILTERED.items())
    each = f"(SELECT unnest({list(COMPARED)}) AS engine) e"
    return f", runs AS MATERIALIZED ({runs}), ft AS ({exact}), g AS MATERIALIZED (SELECT t.filter, e.engine, t.qid, avg(CASE WHEN r.pid IS NULL THEN 0.0 ELSE 1.0 END) AS recall FROM ft t CROSS JOIN {each} LEFT JOIN runs r ON r.filter = t.filter AND r.engine = e.engine AND r.qid = t.qid AND r.pid = t.pid GROUP BY ALL){tail.format(each=each, filters=f'(SELECT unnest({list(FILTERED)}) AS filter) f')}"


def _filtered(x):
    out = None
    for f, mask in FILTERED.items():
        truth = search("E0_exact", x, P, mask)
        for e in COMPARED:
            d = evaluate.truth_recall(search(e, x, P, mask), truth, x.queries, 10).select(F.lit(f).alias("filter"), F.lit(e).alias("engine"), "qid", "recall")
            out = d if out is None else out.unionByName(d)
    return out


@q("V15_filtered_recall", _filtered_sql(" SELECT f.filter, e.engine, q.qid, round(recall, 6) AS recall FROM q CROSS JOIN {filters} CROSS JOIN {each} LEFT JOIN g ON g.filter = f.filter AND g.engine = e.engine AND g.qid = q.qid"))
def _(x):
    return _filtered(x).withColumn("recall", r6(F.col("recall")))


@q("V15_paired_differences", _filtered_sql(" SELECT a.filter, a.engine AS a, b.engine AS b, count(*) AS n, round(avg(a.recall - b.recall), 6) AS diff FROM g a JOIN g b USING (filter, qid) WHERE a.engine > b.engine GROUP BY ALL"))
def _(x):
    d, out = _filtered(x), None
    for a in COMPARED:
        for b in COMPARED:
            if a > b:
                side = lambda e: d.where(F.col("engine") == e).select(F.concat_ws("/", "filter", F.col("qid").cast("string")).alias("qid"), F.col("recall").alias("value"))
                p = evaluate.paired(side(a), side(b)).groupBy(F.substring_index("qid", "/", 1).alias("filter")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("diff"))
                p = p.select("filter", F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "diff")
                out = p if out is None else out.unionByName(p)
    return out


@raw("V17_attribution", f"{_POINTS}, s AS (SELECT engine, min(lat) AS lat, max(quality) AS quality FROM pts GROUP BY engine) SELECT a.engine AS slow, b.engine AS fast, round(a.lat / b.lat, 6) AS ratio, round(b.quality - a.quality, 6) AS diff FROM s a JOIN s b ON a.engine < b.engine")
def _(x):
    s = _points(x).groupBy("engine").agg(F.min("lat").alias("lat"), F.max("quality").alias("quality"))
    a, b = s.select(F.col("engine").alias("slow"), F.col("lat").alias("la"), F.col("quality").alias("qa")), s.select(F.col("engine").alias("fast"), F.col("lat").alias("lb"), F.col("quality").alias("qb"))
    return a.join(F.broadcast(b), F.col("slow") < F.col("fast")).select("slow", "fast", r6(F.col("la") / F.col("lb")).alias("ratio"), r6(F.col("qb") - F.col("qa")).alias("diff"))


@q("V19_starvation", _engine_sql(" SELECT round(avg(CASE WHEN coalesce(n, 0) < 10 THEN 1.0 ELSE 0.0 END), 6) AS starved FROM q LEFT JOIN (SELECT qid, count(*) AS n FROM run GROUP BY qid) USING (qid)"))
def _(x):
    return evaluate.starvation(search("E11_ivf_impute", x, P), x.queries).select(r6(F.col("starved")).alias("starved"))


@raw("V20_correlation", "SELECT round(corr(value, user_id), 6) AS r FROM events")
def _(x):
    return x.read("events").agg(r6(F.corr("value", "user_id")).alias("r"))


@raw("V21_calibrated_bytes", "SELECT event_type AS engine, round(sum(value) / (sum(user_id) / 4294967296.0) / count(*), 2) AS bytes FROM events GROUP BY event_type")
def _(x):
    d = x.read("events").groupBy(F.col("event_type").alias("engine"))
    return d.agg(F.round(F.sum("value") / (F.sum("user_id") / 4294967296.0) / F.count("*"), 2).alias("bytes"))


@raw("V23_stale_runs", "WITH r AS (SELECT event_type AS run, max(ts) AS ts FROM events GROUP BY event_type), m AS (SELECT max(ts) AS m FROM r) SELECT run, ts < m - INTERVAL 6 HOURS AS stale FROM r, m")
def _(x):
    runs = x.read("events").groupBy(F.col("event_type").alias("run")).agg(F.max("ts").alias("ts"))
    main = runs.orderBy(F.desc("ts"), "run").first()
    return evaluate.stale(runs, main.run if main else "").select("run", "stale")


@raw("V25_speed_up", f"{_POINTS}, t AS (SELECT engine, min(lat) AS lat FROM pts WHERE quality >= 0.4 GROUP BY engine) SELECT b.engine, round(b.lat / a.lat, 6) AS speed_up FROM t a, t b WHERE a.engine = (SELECT min(engine) FROM t) AND b.engine <> a.engine")
def _(x):
    t = evaluate.fastest(_points(x), 0.4, ["engine"]).select("engine", "lat")
    own = t.orderBy("engine").limit(1).select(F.col("engine").alias("own"), F.col("lat").alias("own_lat"))
    return t.join(F.broadcast(own), F.col("engine") != F.col("own")).select("engine", r6(F.col("lat") / F.col("own_lat")).alias("speed_up"))


@raw("T19_latency_cdf", "SELECT event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS cdf FROM events")
def _(x):
    return x.read("events").select("event_id", r6(F.cume_dist().over(Window.partitionBy("event_type").orderBy("value"))).alias("cdf"))


@q("U2_overlap", _engine_sql(" SELECT q.qid, count(run.pid) AS common FROM q LEFT JOIN truth USING (qid) LEFT JOIN run ON run.qid = truth.qid AND run.pid = truth.pid GROUP BY q.qid"))
def _(x):
    return evaluate.overlap(x.truth, search("E11_ivf_impute", x, P), 10)

