"""Registered queries: parts of the engines on their own, and runs of several."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import collection, evaluate, filters, index, probe, report, score
from .engines import Params, _codeword_lists, _passing, search
from .fixtures import MASK, PRE, SHARES, SUB, WIDTH, Fixtures
from .q_engines import IMPUTED, _adaptive, _book, _counts, _fde, _final, _ivf, _pass, _sql, _staged
from .q_eval import _points, raw, _POINTS
from .q_index import _HITS, NC, _STAGE3, _stage3, q, r6
from ..sources import readers

P = Params()


@raw("IO5_domain_questions", "SELECT source || '.' || doc_id AS qid, lang AS text FROM documents")
def _(x):
    d = x.read("documents")
    return readers.questions(d.select(F.concat(F.concat_ws(".", "source", F.col("doc_id").cast("string")), F.lit("\t"), "lang").alias("value")))


@q("IO8_token_index", "SELECT pid, pos, tok_id, cid, len(bk) // 4 AS bytes FROM res")
def _(x):
    return x.residual.select("pid", "pos", "tok_id", "cid", F.size("data").cast("long").alias("bytes"))


@q("IO13_predicates_update", "SELECT pid, (pred & 65535) | (1::BIGINT << CAST(16 + pid % 3 AS INTEGER)) AS pred FROM pred")
def _(x):
    return x.pred.select("pid", filters.with_topic(F.col("pred"), F.col("pid") % 3).alias("pred"))


@q("F2_filter_in_lists", f"SELECT qid, qt, pid, round(base, 6) AS base FROM ({IMPUTED}) JOIN ivf USING (cid) WHERE base > 0 AND pid IN {_pass(MASK)}")
def _(x):
    lists = x.ivf.join(_passing(x, MASK), "pid", "left_semi")
    return score.touched(probe.imputed(probe.ranked(x.qtok, x.cen, NC + 1), NC), lists).select("qid", "qt", "pid", r6(F.col("base")).alias("base"))


@q("F3_filter_candidates", f"SELECT DISTINCT qid, pid FROM rk JOIN ivf USING (cid) WHERE rn <= 2 AND pid IN {_pass(MASK)}")
def _(x):
    cand = probe.ranked(x.qtok, x.cen, 2).select("qid", "cid").distinct().join(x.ivf, "cid").select("qid", "pid").distinct()
    return cand.join(_passing(x, MASK), "pid", "left_semi").select("qid", "pid")


@q("F4_filter_ranking", f"SELECT qid, pid FROM truth WHERE pid IN {_pass(MASK)}")
def _(x):
    return x.truth.join(_passing(x, MASK), "pid", "left_semi").select("qid", "pid")


@q("F5_mask_failing", f"SELECT qid, pid, CASE WHEN pid IN {_pass(MASK)} THEN round(score, 6) END AS score FROM truth")
def _(x):
    d = x.truth.join(x.pred, "pid")
    return d.select("qid", "pid", F.when(filters.passes(F.col("pred"), MASK), r6(F.col("score"))).alias("score"))


@q("F13_positive_lists", f"SELECT qid, qt, cid FROM ({IMPUTED}) WHERE base > 0")
def _(x):
    return probe.imputed(probe.ranked(x.qtok, x.cen, NC + 1), NC).where(F.col("base") > 0).select("qid", "qt", "cid")


@q("J5_candidate_tokens", "SELECT truth.qid, pid, count(*) AS n, min(tok_id) AS first FROM truth JOIN tok USING (pid) GROUP BY ALL")
def _(x):
    return x.truth.select("qid", "pid").join(x.tok.select("pid", "tok_id"), "pid").groupBy("qid", "pid").agg(F.count("*").alias("n"), F.min("tok_id").alias("first"))


@q("J6_token_centroids", "SELECT tok_id, cid, round(center[1], 6) AS first FROM res")
def _(x):
    return x.residual.select("tok_id", "cid", r6(F.element_at("center", 1)).alias("first"))


@q("J7_exact_scan", "SELECT qid, CAST(rk AS INTEGER) AS rk, pid, round(score, 6) AS score FROM truth")
def _(x):
    return x.truth.select("qid", "rk", "pid", r6(F.col("score")).alias("score"))


_HALF = "CASE WHEN qid % 20 = 0 THEN NULL ELSE qid END"


@q("J11_paired_queries", f", a AS (SELECT qid, CAST({_HALF} AS DOUBLE) AS v FROM q) SELECT qid, v - v / 2 AS value FROM a WHERE v IS NOT NULL")
def _(x):
    v = F.when(F.col("qid") % 20 == 0, F.lit(float("nan"))).otherwise(F.col("qid").cast("double"))
    a = x.queries.select("qid", v.alias("value"))
    return evaluate.paired(a, a.withColumn("value", F.col("value") / 2))


@q("T3_final_top", f"{_STAGE3}, cd AS (SELECT qid, pid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(a, 6) DESC, pid) AS r FROM ap) WHERE r <= 20), sc AS (SELECT qid, pid, score FROM cd JOIN ms USING (qid, pid)) " + _final("sc", 5))
def _(x):
    cand = score.top(score.summed_max(_stage3(x)), ["qid"], "approx", 20).select("qid", "pid")
    return score.top(score.rerank(cand, x.queries, x.passages), ["qid"], "score", 5).select("qid", "rk", "pid", r6(F.col("score")).alias("score"))


@q("T7_all_codewords", "SELECT qid, qt, s, count(*) AS n FROM rq, words GROUP BY ALL")
def _(x):
    return _codeword_lists(x, P, "all").groupBy("qid", "qt", "s").agg(F.count("*").alias("n"))


@q("T11_double_cut", _staged(0, "middle").split(", sc AS")[0] + " SELECT qid, pid FROM s2")
def _(x):
    from .engines import _staged as run

    return run(x, P, 0, False)


@q("T12_first_relevant", "SELECT truth.qid, CAST(min(rk) AS INTEGER) AS first FROM truth JOIN (SELECT DISTINCT * FROM qrels) r USING (qid, pid) GROUP BY truth.qid")
def _(x):
    return evaluate.judged(x.truth.select("qid", "rk", "pid"), x.qrels).where("rel = 1").groupBy("qid").agg(F.min("rk").alias("first"))


@q("T14_encoding_top", _fde(0).replace(f"WHERE k <= {P.cands})", "WHERE k <= 5)"))
def _(x):
    return search("E23_fixed_dimensional", x, Params(cands=5)).select("qid", "rk", "pid", r6(F.col("score")).alias("score"))


@raw("T15_hash_order", "SELECT doc_id AS qid FROM documents ORDER BY ('0x' || substr(sha256('1:' || doc_id), 1, 12))::BIGINT, doc_id LIMIT 30")
def _(x):
    return evaluate.split(x.read("documents").select(F.col("doc_id").alias("qid")), 30, 1).where("part = 'tune'").select("qid")


def _need() -> str:
    more, _ = _adaptive(MASK, "rk", "(SELECT count(*) FROM cen)")
    return f"{_counts(MASK)}{more} SELECT qid, CAST(least(greatest(ceil(quantile_cont(need, 0.75)), {NC}), {8 * NC}) AS BIGINT) AS need FROM nd GROUP BY qid"


@q("T18_needed_depth", _need())
def _(x):
    ncap = min(probe.CAP * NC, x.cen.count() - 1)
    counts = probe.list_counts(x.ivf, _passing(x, MASK))
    sel = filters.selectivity(x.pred, MASK).first()[0]
    # With any share of short tokens allowed to widen, the depth is the quantile itself.
    d = probe.adaptive(probe.ranked(x.qtok, x.cen, ncap + 1), counts, NC, ncap, sel, slack=1e9)
    return d.select("qid", F.col("nc_eff").cast("long").alias("need"))


@q("P3_nonempty_ranks", f"{_counts(MASK)}, ne AS (SELECT qid, qt, cid, row_number() OVER (PARTITION BY qid, qt ORDER BY rn) AS rn FROM rk WHERE cid IN (SELECT cid FROM cnt WHERE pass > 0)) SELECT qid, qt, CAST(rn AS INTEGER) AS rn, cid FROM ne WHERE rn <= {NC}")
def _(x):
    d = probe.ranked(x.qtok, probe.passing(x.cen, probe.list_counts(x.ivf, _passing(x, MASK))), NC)
    return d.select("qid", "qt", "rn", "cid")


@q("E25_rerank_only", f", c AS (SELECT DISTINCT qid, pid FROM rk JOIN ivf USING (cid) WHERE rn <= {P.ncells}), sc AS (SELECT qid, pid, score FROM c JOIN ms USING (qid, pid)) {_final('sc')}")
def _(x):
    pairs = probe.ranked(x.qtok, x.cen, P.ncells).select("qid", "cid").distinct().join(x.ivf, "cid").select("qid", "pid").distinct()
    return score.top(score.rerank(pairs, x.queries, x.passages), ["qid"], "score", P.top_k).select("qid", "rk", "pid", r6(F.col("score")).alias("score"))


@q("E26_batched", _ivf(IMPUTED, 0))
def _(x):
    return search("E11_ivf_impute", x, P).select("qid", "rk", "pid", r6(F.col("score")).alias("score"))


@q("E27_selective_baseline", f"SELECT qid, w.s, count(*) AS n FROM rq, words w WHERE round(list_sum(list_transform(list_zip(rq.emb[w.s*{WIDTH}+1 : w.s*{WIDTH}+{WIDTH}], w.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) <= 0.08 GROUP BY ALL")
def _(x):
    from ..operators.diag import selective_lut

    pairs = x.rqtok.select("qid", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda s: vec.subspace(F.col("emb"), s, WIDTH))).alias("s", "x"))
    return selective_lut(pairs, x.codewords, 0.08).groupBy("qid", "s").agg(F.count("*").alias("n"))


@q("B6_compatibility", "SELECT true AS ok")
def _(x):
    meta = {"rotation": index.fingerprint(index.rotation(x.cen, 8)), "entries": 16, "top_m": 4}
    index.compatible(meta, dict(meta))
    return x.spark.createDataFrame([(True,)], "ok boolean")


@q("B8_predicates", "SELECT pid, pred FROM pred")
def _(x):
    return x.pred


@q("B9_correlated_masks", ", s AS (SELECT qid, cid % 16 AS topic, max(score) AS sim FROM rk GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, topic) AS r FROM s) SELECT qid, 1::BIGINT << CAST(16 + topic AS INTEGER) AS mask FROM k WHERE r = 1")
def _(x):
    sims = probe.ranked(x.qtok, x.cen, x.cen.count()).groupBy("qid", (F.col("cid") % 16).alias("topic")).agg(F.max("score").alias("sim"))
    near = filters.near_mid_far(sims, 16).where(F.col("filter") == "corr_near")
    return near.select("qid", F.expr("shiftleft(1L, cast(16 + topic as int))").alias("mask"))


_TRUTHS = {"all": 0} | {f"syn{share // 100}": 1 << b for b, share in enumerate(SHARES)}


@q("B11_ground_truth", " " + " UNION ALL ".join(f"SELECT '{f}' AS filter, qid, rk, pid FROM ({_sql('E0_exact', m)})" for f, m in _TRUTHS.items()))
def _(x):
    out = None
    for name, mask in _TRUTHS.items():
        d = search("E0_exact", x, P, mask).select(F.lit(name).alias("filter"), "qid", "rk", "pid")
        out = d if out is None else out.unionByName(d)
    return out


@q("B12_encodings", "SELECT pid, 32 AS dims FROM p")
def _(x):
    from ..operators import fde

    return fde.documents(x.tok, fde.Params(64)).select("pid", F.size("fde").alias("dims"))


@q("B17_facts", "SELECT 'E11_ivf_impute' AS engine, 4 AS nc, 20 AS ndocs")
def _(x):
    f = report.facts(P, "E11_ivf_impute", search("E11_ivf_impute", x, P))
    return x.spark.createDataFrame([(f["engine"], f["options"]["nc"], f["options"]["ndocs"])], "engine string, nc int, ndocs int")


@q("B18_token_index")
def _(x):
    c = index.kmeans(x.tok.select("emb"), 16, 5)
    cen = x.spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(c)], "cid long, emb array<double>")
    return index.assign(x.tok.select("pid", "pos", "tok_id", "emb"), cen)


@raw("B19_passage_tokens", "SELECT * FROM (SELECT doc_id AS pid, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM documents) WHERE n > 0")
def _(x):
    d = collection.hashed_encoder(x.read("documents").select(F.col("doc_id").alias("pid"), "text"), 64)
    return d.groupBy("pid").agg(F.count("*").alias("n"))


#: Budgets of the staged engines in the filter sweep: cells, threshold, candidates.
BUDGETS = ((2, 0.45, 1024), (4, 0.4, 4096), (8, 0.35, 16384), (16, 0.3, 65536))
_SWEPT = {"E1_staged_post": "post", "E2_staged_early": "early", "E3_staged_middle": "middle", "E4_staged_early_rerank": "early"}


def _swept() -> str:
    """Each engine and budget as a query of its own inside one."""
    one = " UNION ALL ".join(
        f"SELECT '{name}' AS engine, CAST({nc} AS INTEGER) AS ncells, * FROM (WITH {_staged(MASK, where, Params(ncells=nc, threshold=t, ndocs=nd)).lstrip(', ')})"
        for name, where in _SWEPT.items() for nc, t, nd in BUDGETS
    )
    return " " + one


@q("V16_filter_budget", _swept())
def _(x):
    """Candidates of the widest budget, with the fewest cells that reach each, serve all; so do their interaction and exact scores."""
    least = F.min("rn").alias("cells")
    tops = probe.ranked(x.qtok, x.cen, max(nc for nc, _, _ in BUDGETS)).groupBy("qid", "cid").agg(least)
    cand = tops.join(x.ivf, "cid").groupBy("qid", "pid").agg(F.min("cells").alias("cells"))
    both = score.interaction(cand, x.codes, x.queries, x.cen, tuple(t for _, t, _ in BUDGETS))
    both = both.join(cand, ["qid", "pid"]).join(_passing(x, MASK).select("pid", F.lit(True).alias("ok")), "pid", "left").fillna(False, ["ok"])
    runs = [(nc, nd, i, early) for i, (nc, _, nd) in enumerate(BUDGETS) for early in (False, True)]
    in_run = [F.struct(F.lit(1 << n).alias("bit"), F.lit(nd).alias("nd"), F.col("pruned")[i].alias("pruned"), ((F.col("cells") <= nc) & (F.col("ok") if early else F.lit(True))).alias("on")) for n, (nc, nd, i, early) in enumerate(runs)]
    each = both.withColumn("r", F.explode(F.array(*in_run))).where("r.on").select("qid", "pid", "ok", "approx", "r.*")
    some = score.top(score.top(each, ["qid", "bit"], "pruned", F.col("nd")), ["qid", "bit"], "approx", F.greatest(F.lit(1), F.expr("nd div 4")))
    passed = 1 << len(runs)
    tag = F.bit_or(F.col("bit").bitwiseOR(F.when(F.col("ok"), passed).otherwise(0))).cast("long")
    d = score.rerank_many(some.groupBy("qid", "pid").agg(tag.alias("tag")), x.queries, x.passages)
    run = F.explode(F.array(*[F.struct(F.lit(1 << n).alias("bit"), F.lit(nc).alias("ncells"), F.lit(early).alias("early")) for n, (nc, _, _, early) in enumerate(runs)]))
    d = d.withColumn("r", run).where(F.col("tag").bitwiseAND(F.col("r.bit")) != 0).select("qid", "pid", "score", (F.col("tag").bitwiseAND(F.lit(passed)) != 0).alias("ok"), "r.*")
    d = score.top(d, ["qid", "bit"], "score", F.expr(f"{2**31 - 1}"), rank="of_all")
    d = score.top(d.where("ok"), ["qid", "bit"], "score", P.top_k)  # a cut ranking's passing rows are the first that pass
    names = F.when(F.col("early"), F.array(F.lit("E2_staged_early"), F.lit("E4_staged_early_rerank")))
    names = names.when(F.col("of_all") <= P.top_k, F.array(F.lit("E1_staged_post"), F.lit("E3_staged_middle"))).otherwise(F.array(F.lit("E3_staged_middle")))
    return d.select(F.explode(names).alias("engine"), "ncells", "qid", "rk", "pid", r6(F.col("score")).alias("score"))


@raw("V18_stage_times")
def _(x):
    import time

    rows = []
    for name, df in (("probe", probe.ranked(x.qtok, x.cen, NC + 1)), ("lists", x.ivf), ("truth", x.truth)):
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        rows.append((name, time.time() - began))
    return x.spark.createDataFrame(rows, "stage string, seconds double")


@raw("V22_report", f"{_POINTS}, r AS (SELECT row_number() OVER (ORDER BY engine, config) + 3 AS n, format('| {{}} | {{}} | {{:.4g}} | {{:.4g}} |', engine, config, lat, quality) AS line FROM pts) SELECT CAST(n AS INTEGER) AS n, line FROM (SELECT * FROM r UNION ALL SELECT unnest([0, 1, 2, 3]), unnest(['## Points', '', '| engine | config | lat | quality |', '|-|-|-|-|']))")
def _(x):
    text = report.markdown(_points(x).orderBy("engine", "config"), "Points")
    return x.spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "n int, line string")


#: Codewords a slice has in the sweep over codebook sizes.
SIZES = (4, 16)


def _size_sql(n: int) -> str:
    """Recall, and the codewords that a query slice selects, of a codebook of ``n`` words a slice."""
    own = PRE.replace("WHERE tok_id % 25 = 7)", f"WHERE tok_id % 25 = 7 AND floor(tok_id/25.0) < {n})")
    run = f"({own}{_book(0, 'threshold', 1)})"
    recall = f"SELECT avg(CASE WHEN r.pid IS NULL THEN 0.0 ELSE 1.0 END) FROM truth t LEFT JOIN {run} r USING (qid, pid)"
    hit = f"SELECT row_number() OVER (PARTITION BY qid, qt, s ORDER BY round(hit, 9) DESC, eid) AS r FROM ({_HITS}) WHERE eid < {n} AND hit > 0 AND hit >= {P.tau}"
    return f"SELECT {n} AS entries, ({recall}) AS recall, (SELECT count(*) FROM ({hit}) WHERE r <= {P.k_eids}) / (SELECT count(*) * {SUB} FROM rq) AS hits"


@q("V24_codebook_sizes", ", z AS MATERIALIZED (" + " UNION ALL ".join(map(_size_sql, SIZES)) + ") " + " UNION ALL ".join(f"SELECT '{t}' AS target, " + ", ".join(f'round(max({t}) FILTER (WHERE entries = {n}), 6) AS "{n}"' for n in SIZES) + " FROM z" for t in ("recall", "hits")))
def _(x):
    out = None
    for n in SIZES:
        y = Fixtures(x.spark, x.dir, n)
        recall = evaluate.truth_recall(search("E5_codebook", y, P), y.truth, y.queries, 10).agg(F.avg("recall").alias("quality")).withColumn("target", F.lit("recall"))
        slices = y.rqtok.agg(F.count("*") * SUB).first()[0]
        hits = _codeword_lists(y, P, "threshold").agg((F.count("*") / F.lit(slices)).alias("quality")).withColumn("target", F.lit("hits"))
        d = recall.unionByName(hits).withColumn("entries", F.lit(n))
        out = d if out is None else out.unionByName(d)
    d = report.by_size(out, list(SIZES))
    return d.select("target", *[r6(F.col(f"`{n}`")).alias(str(n)) for n in SIZES])


@raw("V26_steps", "SELECT * FROM (VALUES ('build', 'skipped'), ('truth', 'done'), ('bench', 'done')) t(step, state)")
def _(x):
    log = report.steps([("build", lambda: None), ("truth", lambda: None), ("bench", lambda: None)], lambda n: n == "build")
    return x.spark.createDataFrame(log, "step string, state string")
