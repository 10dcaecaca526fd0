"""Registered queries: every engine, without and with a filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from .engines import ENGINES, Params, search
from .fixtures import MASK, WIDTH, Fixtures, sql
from .registry import register

P = Params()


def _final(src: str, k: int = P.top_k) -> str:
    return f"SELECT qid, CAST(rk AS INTEGER) AS rk, pid, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, pid) AS rk FROM {src}) WHERE rk <= {k}"


def _pass(mask: int) -> str:
    return f"(SELECT pid FROM pred WHERE {mask} = 0 OR (pred & {mask}) <> 0)"


def _rerank(cand: str) -> str:
    return f"SELECT c.qid, c.pid, ms.score FROM {cand} c JOIN ms USING (qid, pid)"


def _post(post: str, more: str = "", rerank: bool = True) -> str:
    """post: qid, qt, pid, base."""
    cut = f"cand AS (SELECT qid, pid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(approx, 6) DESC, pid) AS r FROM ap) WHERE r <= {P.ndocs})"
    head = f"{more}, post AS ({post}), ap AS (SELECT qid, pid, sum(b) AS approx FROM (SELECT qid, qt, pid, max(base) AS b FROM post GROUP BY ALL) GROUP BY ALL)"
    return head + (f", {cut}, sc AS ({_rerank('cand')}) " + _final("sc") if rerank else " " + _final("(SELECT qid, pid, approx AS score FROM ap)"))


def _lists(mask: int, lists: str = "ivf") -> str:
    return f"(SELECT * FROM {lists} WHERE pid IN {_pass(mask)})"


def _ivf(probe: str, mask: int, more: str = "", lists: str = "ivf") -> str:
    return _post(f"SELECT qid, qt, pid, base FROM probe JOIN {_lists(mask, lists)} l USING (cid) WHERE base > 0", f"{more}, probe AS ({probe})")


NC = P.nc
IMPUTED = f"SELECT a.qid, a.qt, a.cid, a.score - b.score AS base FROM rk a JOIN rk b ON a.qid = b.qid AND a.qt = b.qt AND b.rn = {NC + 1} WHERE a.rn <= {NC}"
PLAIN = f"SELECT qid, qt, cid, score AS base FROM rk WHERE rn <= {NC}"


def _counts(mask: int) -> str:
    return f", cnt AS MATERIALIZED (SELECT cid, count(*) AS tot, count(*) FILTER (WHERE pid IN {_pass(mask)}) AS pass FROM ivf GROUP BY cid)"


def _adaptive(mask: int, src: str, n: str) -> tuple[str, str]:
    more = (
        f", prm AS (SELECT least({8 * NC}, {n} - 1) AS ncap, (SELECT avg(CASE WHEN pid IN {_pass(mask)} THEN 1.0 ELSE 0.0 END) FROM pred) AS sel)"
        f", cu AS MATERIALIZED (SELECT r.qid, r.qt, r.rn, coalesce(tot, 0) AS tot, coalesce(pass, 0) AS pass, sum(coalesce(pass, 0)) OVER (PARTITION BY r.qid, r.qt ORDER BY r.rn) AS cum FROM {src} r LEFT JOIN cnt USING (cid), prm WHERE r.rn <= ncap)"
        f", tk AS (SELECT qid, qt, sel * sum(CASE WHEN rn <= {NC} THEN tot ELSE 0 END) AS target, sum(CASE WHEN rn <= {NC} THEN pass ELSE 0 END) AS have FROM cu, prm GROUP BY qid, qt, sel)"
        f", nd AS (SELECT tk.qid, tk.qt, CASE WHEN have < 0.5 * target THEN 1.0 ELSE 0.0 END AS short, least(greatest(count(*) FILTER (WHERE cum < target) + 1, {NC}), any_value(ncap)) AS need FROM tk JOIN cu USING (qid, qt), prm GROUP BY tk.qid, tk.qt, have, target)"
        f", eff AS (SELECT qid, CASE WHEN avg(short) <= 0.25 + 1e-9 THEN {NC} ELSE least(greatest(ceil(quantile_cont(need, 0.75)), {NC}), any_value(ncap)) END AS nc_eff FROM nd, prm GROUP BY qid)"
    )
    probe = f"SELECT a.qid, a.qt, a.cid, a.score - b.score AS base FROM {src} a JOIN eff USING (qid) JOIN {src} b ON a.qid = b.qid AND a.qt = b.qt AND b.rn = nc_eff + 1 WHERE a.rn <= nc_eff"
    return more, probe


NE = ", ne AS MATERIALIZED (SELECT qid, qt, cid, score, row_number() OVER (PARTITION BY qid, qt ORDER BY rn) AS rn FROM rk WHERE cid IN (SELECT cid FROM cnt WHERE pass > 0))"


def _resid(mask: int) -> str:
    lists = f"(SELECT cid, pid, r FROM dec WHERE pid IN {_pass(mask)})"
    return f"SELECT o.qid, o.qt, l.pid, greatest(o.base + list_inner_product(qtok.emb, l.r), 0.0) AS base FROM ({IMPUTED}) o JOIN {lists} l USING (cid) JOIN qtok ON qtok.qid = o.qid AND qtok.qt = o.qt WHERE o.base > 0"


def _book(mask: int, mode: str, weight: int) -> str:
    hits = f"SELECT qid, qt, w.s, eid, list_inner_product(rq.emb[w.s*{WIDTH}+1 : w.s*{WIDTH}+{WIDTH}], w.w) AS hit FROM rq, words w"
    if mode == "all":
        sel = f"SELECT * FROM ({hits})"
    else:
        cond = "hit > 0" if mode == "topk" else f"hit > 0 AND hit >= {P.tau}"
        sel = f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY qid, qt, s ORDER BY round(hit, 9) DESC, eid) AS r FROM ({hits}) WHERE {cond}) WHERE r <= {P.k_eids}"
    more = f", hit AS MATERIALIZED ({sel})"
    return _post(f"SELECT qid, qt, l.pid, score + {weight} * hit AS base FROM rrk JOIN hit USING (qid, qt) JOIN {_lists(mask, 'postings')} l USING (s, cid, eid) WHERE rn <= {NC} AND score + {weight} * hit > 0", more)


def _staged(mask: int, where: str, p: Params = P) -> str:
    early = f" AND pid IN {_pass(mask)}" if where == "early" else ""
    body = (
        f", c1 AS MATERIALIZED (SELECT DISTINCT qid, pid FROM rk JOIN ivf USING (cid) WHERE rn <= {p.ncells}{early})"
        f", kc AS (SELECT qid, cid FROM rk GROUP BY qid, cid HAVING max(score) >= {p.threshold})"
        ", pr AS (SELECT qid, pid, sum(m) AS a FROM (SELECT c1.qid, c1.pid, rk.qt, max(score) AS m FROM c1 JOIN ivf USING (pid) JOIN rk ON rk.qid = c1.qid AND rk.cid = ivf.cid WHERE (rk.qid, rk.cid) IN (SELECT qid, cid FROM kc) GROUP BY ALL) GROUP BY ALL)"
        f", s1 AS (SELECT qid, pid FROM (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(a, 0), 6) DESC, pid) AS r FROM c1 LEFT JOIN pr USING (qid, pid)) WHERE r <= {p.ndocs})"
        ", fu AS (SELECT qid, pid, sum(m) AS a FROM (SELECT s1.qid, s1.pid, rk.qt, max(score) AS m FROM s1 JOIN ivf USING (pid) JOIN rk ON rk.qid = s1.qid AND rk.cid = ivf.cid GROUP BY ALL) GROUP BY ALL)"
        f", s2 AS (SELECT qid, pid FROM (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY round(a, 6) DESC, pid) AS r FROM fu) WHERE r <= {p.ndocs // 4})"
    )
    late = f" WHERE pid IN {_pass(mask)}" if where == "middle" else ""
    body += f", sc AS ({_rerank('(SELECT * FROM s2' + late + ')')}) "
    if where == "post" and mask:
        return body + _final(f"(SELECT qid, pid, score FROM ({_final('sc').replace('round(score, 6) AS score', 'score')}) WHERE pid IN {_pass(mask)})")
    return body + _final("sc")


def _fde(mask: int) -> str:
    from ..operators.fde import Params as Fde

    f = Fde(64)
    lit = lambda v: "[" + ", ".join(repr(float(x)) for x in v) + "]"
    bucket = lambda r: " + ".join(f"CASE WHEN list_inner_product(emb, {lit(g)}) > 0 THEN {1 << i} ELSE 0 END" for i, g in enumerate(f.planes[r]))
    proj = lambda r: "[" + ", ".join(f"list_inner_product(emb, {lit(g)})" for g in f.proj[r]) + "]"
    each = " UNION ALL ".join(f"SELECT tok_id, pid, pos, {r} AS r, {bucket(r)} AS b, {proj(r)} AS y FROM tok" for r in range(f.reps))
    dims = range(1, f.d + 1)
    mean = "[" + ", ".join(f"avg(y[{i}])" for i in dims) + "]"
    total = "[" + ", ".join(f"sum(y[{i}])" for i in dims) + "]"
    return (
        f", pt AS MATERIALIZED ({each}), bs AS (SELECT unnest(range({1 << f.k})) AS b)"
        f", dm AS (SELECT pid, r, b, {mean} AS y FROM pt GROUP BY ALL), qm AS (SELECT pid AS qid, r, b, {total} AS y FROM pt WHERE pid % 10 = 0 GROUP BY ALL)"
        ", fl AS (SELECT pid, r, b, y FROM (SELECT p.pid, p.r, bs.b, p.y, row_number() OVER (PARTITION BY p.pid, p.r, bs.b ORDER BY bit_count(xor(p.b, bs.b)), p.pos) AS k FROM pt p, bs) WHERE k = 1)"
        ", dd AS MATERIALIZED (SELECT fl.pid, fl.r, fl.b, coalesce(dm.y, fl.y) AS y FROM fl LEFT JOIN dm USING (pid, r, b))"
        ", fs AS (SELECT qid, pid, sum(list_inner_product(qm.y, dd.y)) AS s FROM qm JOIN dd USING (r, b) GROUP BY ALL)"
        f", cd AS (SELECT qid, pid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, pid) AS k FROM fs) WHERE k <= {P.cands})"
        f", sc AS ({_rerank(f'(SELECT * FROM cd WHERE pid IN {_pass(mask)})')}) " + _final("sc")
    )


def _sql(name: str, mask: int) -> str:
    code = name.split("_")[0]
    if code == "E0":
        return " " + _final(f"(SELECT qid, pid, score FROM ms WHERE pid IN {_pass(mask)})")
    if code in ("E1", "E2", "E3", "E4"):
        return _staged(mask, {"E1": "post", "E3": "middle"}.get(code, "early"))
    if code in ("E5", "E6", "E7", "E8", "E24"):
        return _book(mask, {"E7": "all", "E24": "topk"}.get(code, "threshold"), 0 if code == "E8" else 1)
    if code == "E9":
        return _ivf(f"SELECT qid, qt, cid, score AS base FROM rrk WHERE rn <= {NC}", mask, ", rivf AS (SELECT DISTINCT cid, pid FROM rcodes)", "rivf")
    if code == "E10":
        return _ivf(PLAIN, mask)
    if code in ("E13", "E14"):
        return _post(_resid(mask), rerank=code == "E13")
    if code == "E23":
        return _fde(mask)
    if mask and code == "E18":
        more, probe = _adaptive(mask, "rk", "(SELECT count(*) FROM cen)")
        return _ivf(probe, mask, _counts(mask) + more)
    if mask and code == "E19":
        return _ivf(IMPUTED.replace("rk a", "ne a").replace("rk b", "ne b"), mask, _counts(mask) + NE)
    if mask and code == "E20":
        more, probe = _adaptive(mask, "ne", "(SELECT count(*) FROM cnt WHERE pass > 0)")
        return _ivf(probe, mask, _counts(mask) + NE + more)
    if code in ("E21", "E22"):
        src, among = (f"SELECT * FROM rk WHERE rn <= {NC}", "(SELECT * FROM rk WHERE cid IN (SELECT cid FROM cnt WHERE pass > 0))") if code == "E21" else (f"SELECT * FROM ne WHERE rn <= {NC}", "rk")
        more = f"{_counts(mask)}{NE}, op AS ({src}), la AS (SELECT qid, qt, min(score) AS last FROM op GROUP BY ALL), flo AS (SELECT a.qid, a.qt, max(a.score) AS floor FROM {among} a JOIN la USING (qid, qt) WHERE a.score < last GROUP BY ALL)"
        return _ivf("SELECT qid, qt, cid, score - floor AS base FROM op JOIN flo USING (qid, qt)", mask, more)
    return _ivf(IMPUTED, mask)


def _made(name: str, mask: int):
    def run(spark, sf_dir):
        return search(name, Fixtures(spark, sf_dir), P, mask).select("qid", "rk", "pid", F.round("score", 6).alias("score"))

    return run


for _name in ENGINES:
    register("exact_maxsim" if _name == "E0_exact" else _name, sql(_sql(_name, 0)))(_made(_name, 0))
    register(f"{_name}_filtered", sql(_sql(_name, MASK)))(_made(_name, MASK))
