"""Retrieval engines: compositions of probing, candidate generation and reranking.

Every engine answers all queries of a batch in one plan and returns qid, rk,
pid, score.  Names that stand for another way to run the same plan are aliases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codec, vec
from ..operators import codebook as codebook_steps
from ..operators import fde, filters, probe, score
from ..operators.matrix import exact_scan, searched
from .fixtures import DIM, SUB, WEIGHTS, WIDTH, Fixtures


@dataclass(frozen=True)
class Params:
    nc: int = 4  # lists a query token opens
    ndocs: int = 20  # candidates that are reranked
    top_k: int = 10
    k_eids: int = 4  # codewords a slice keeps
    ncells: int = 2
    threshold: float = 0.3
    cands: int = 20
    tau: float = 0.02

    def __post_init__(self) -> None:
        if min(self.nc, self.ndocs, self.top_k, self.ncells, self.cands) < 1:
            raise ValueError("lists, candidates and results are at least one")
        if not 1 <= self.k_eids <= 256:
            raise ValueError("between 1 and 256 codewords a slice")


def _final(scored: DataFrame, k: int) -> DataFrame:
    return score.top(scored, ["qid"], "score", k).select("qid", "rk", "pid", "score")


def _passing(x: Fixtures, mask: int) -> DataFrame:
    return x.pred.where(filters.passes(F.col("pred"), mask)).select("pid")


def _candidates(postings: DataFrame, p: Params, col: str = "base") -> DataFrame:
    return score.top(score.summed_max(postings, col), ["qid"], "approx", p.ndocs).select("qid", "pid")


def _inverted(x: Fixtures, opened: DataFrame, p: Params, mask: int, lists: DataFrame | None = None) -> DataFrame:
    """Open lists, filter postings before they count, cut, rerank."""
    lists = x.ivf if lists is None else lists
    if mask:
        lists = lists.join(_passing(x, mask), "pid", "left_semi")
    return _final(score.rerank(_candidates(score.touched(opened, lists), p), x.queries, x.passages), p.top_k)


def exact(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    passages = x.passages if not mask else x.passages.join(_passing(x, mask), "pid", "left_semi")
    return exact_scan(passages, x.queries, p.top_k).select("qid", "rk", "pid", "score")


def ivf_impute(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    return _inverted(x, probe.imputed(probe.ranked(x.qtok, x.cen, p.nc + 1), p.nc), p, mask)


def ivf_plain(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    return _inverted(x, probe.plain(probe.ranked(x.qtok, x.cen, p.nc), p.nc), p, mask)


def ivf_tokens(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    return _inverted(x, probe.imputed(probe.ranked(x.qtok, x.cen, p.nc + 1), p.nc), p, mask, x.codes.select("cid", "tok_id", "pid"))


def _residual_postings(x: Fixtures, p: Params, mask: int) -> DataFrame:
    opened = probe.imputed(probe.ranked(x.qtok, x.cen, p.nc + 1), p.nc).where(F.col("base") > 0)
    lists = x.residual.select("cid", "pid", "data")
    if mask:
        lists = lists.join(_passing(x, mask), "pid", "left_semi")
    d = opened.join(lists, "cid").join(x.qtok, ["qid", "qt"])
    return d.withColumn("base", F.greatest(F.col("base") + vec.dot(F.col("emb"), codec.decoded(F.col("data"), WEIGHTS)), F.lit(0.0)))


def ivf_residual(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    return _final(score.rerank(_candidates(_residual_postings(x, p, mask), p), x.queries, x.passages), p.top_k)


def ivf_residual_only(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    return _final(score.summed_max(_residual_postings(x, p, mask)).withColumnRenamed("approx", "score"), p.top_k)


def _counts(x: Fixtures, mask: int) -> DataFrame:
    return probe.list_counts(x.ivf, _passing(x, mask))


def _depth(x: Fixtures, p: Params, n: int) -> int:
    return min(probe.CAP * p.nc, n - 1)


def ivf_adaptive(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    if not mask:
        return ivf_impute(x, p)
    ncap = _depth(x, p, x.cen.count())
    ranks = probe.ranked(x.qtok, x.cen, ncap + 1)
    sel = filters.selectivity(x.pred, mask).first()[0]
    return _inverted(x, probe.probed_to(ranks, probe.adaptive(ranks, _counts(x, mask), p.nc, ncap, sel)), p, mask)


def ivf_nonempty(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    if not mask:
        return ivf_impute(x, p)
    counts = _counts(x, mask)
    nc = max(1, min(p.nc, counts.where(F.col("pass") > 0).count() - 1))
    return _inverted(x, probe.imputed(probe.ranked(x.qtok, probe.passing(x.cen, counts), nc + 1), nc), p, mask)


def ivf_nonempty_adaptive(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    if not mask:
        return ivf_impute(x, p)
    counts = _counts(x, mask)
    n = counts.where(F.col("pass") > 0).count()
    ncap = _depth(x, p, n)
    ranks = probe.ranked(x.qtok, probe.passing(x.cen, counts), ncap + 1)
    sel = filters.selectivity(x.pred, mask).first()[0]
    return _inverted(x, probe.probed_to(ranks, probe.adaptive(ranks, counts, p.nc, ncap, sel)), p, mask)


def ivf_floor_nonempty(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    """Opens the usual lists; the floor is the nearest lower score of a list that isn't empty."""
    opened = probe.plain(probe.ranked(x.qtok, x.cen, p.nc), p.nc)
    return _inverted(x, probe.with_floor(opened, x.qtok, probe.passing(x.cen, _counts(x, mask))), p, mask)


def ivf_skip_empty(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    """Opens lists that aren't empty; the floor is the nearest lower score of any list."""
    opened = probe.plain(probe.ranked(x.qtok, probe.passing(x.cen, _counts(x, mask)), p.nc), p.nc)
    return _inverted(x, probe.with_floor(opened, x.qtok, x.cen), p, mask)


def _codeword_lists(x: Fixtures, p: Params, mode: str) -> DataFrame:
    """qid, qt, s, eid, hit: the codewords that each query slice selects."""
    rows = x.rqtok.select("qid", "qt", "emb")
    if mode == "all":
        return codebook_steps.hits(rows, x.codewords, SUB, WIDTH)
    return codebook_steps.hits(rows, x.codewords, SUB, WIDTH, p.k_eids, 0.0 if mode == "topk" else p.tau)


def _codebook(x: Fixtures, p: Params, mask: int, mode: str, weight: float) -> DataFrame:
    opened = probe.ranked(x.rqtok, x.rcen, p.nc).select("qid", "qt", "cid", "score")
    lists = x.postings
    if mask:
        lists = lists.join(_passing(x, mask), "pid", "left_semi")
    if mode == "all":  # every codeword is selected: postings of the opened lists bring theirs
        known = lists.join(x.codewords, ["s", "eid"]).select("cid", "pid", "s", "w")
        d = opened.join(x.rqtok.select("qid", "qt", "emb"), ["qid", "qt"]).join(known, "cid")
        d = d.withColumn("base", F.col("score") + F.lit(weight) * vec.dot(vec.subspace(F.col("emb"), F.col("s"), WIDTH), F.col("w")))
        d = d.where(F.col("base") > 0).select("qid", "qt", "pid", "base")
    else:
        d = opened.join(_codeword_lists(x, p, mode), ["qid", "qt"]).withColumn("base", F.col("score") + F.lit(weight) * F.col("hit")).where(F.col("base") > 0)
        d = d.join(lists, ["s", "cid", "eid"])
    return _final(score.rerank(_candidates(d, p), x.queries, x.passages), p.top_k)


def codebook(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    return _codebook(x, p, mask, "threshold", 1.0)


def codebook_topk(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    return _codebook(x, p, mask, "topk", 1.0)


def codebook_all(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    return _codebook(x, p, mask, "all", 1.0)


def codebook_centroid(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    return _codebook(x, p, mask, "threshold", 0.0)


def rotated_ivf(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    from ..operators import index

    lists = index.plain_ivf(index.assign(x.rtok.select("pid", "pos", "tok_id", "emb"), x.rcen))
    return _inverted(x, probe.plain(probe.ranked(x.rqtok, x.rcen, p.nc), p.nc), p, mask, lists)


def _staged(x: Fixtures, p: Params, mask: int, early: bool) -> DataFrame:
    """Distinct passages of the opened lists, pruned and full centroid interaction: the survivors."""
    tops = probe.ranked(x.qtok, x.cen, p.ncells)
    cand = tops.select("qid", "cid").distinct().join(x.ivf, "cid").select("qid", "pid").distinct()
    if mask and early:
        cand = cand.join(_passing(x, mask), "pid", "left_semi")
    both = score.interaction(cand, x.codes, x.queries, x.cen, p.threshold)
    some = score.top(both, ["qid"], "pruned", p.ndocs).select("qid", "pid", "approx")
    return score.top(some, ["qid"], "approx", max(1, p.ndocs // 4)).select("qid", "pid")


def staged(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    """Filter after the final ranking (``post``)."""
    ranked = _final(score.rerank(_staged(x, p, 0, False), x.queries, x.passages), p.top_k).drop("rk")
    if mask:
        ranked = ranked.join(_passing(x, mask), "pid", "left_semi")
    return _final(ranked, p.top_k)


def staged_early(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    return _final(score.rerank(_staged(x, p, mask, True), x.queries, x.passages), p.top_k)


def staged_middle(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    """Filter on what survives the interaction, before the exact scores."""
    left = _staged(x, p, 0, False)
    if mask:
        left = left.join(_passing(x, mask), "pid", "left_semi")
    return _final(score.rerank(left, x.queries, x.passages), p.top_k)


def fixed_dimensional(x: Fixtures, p: Params, mask: int = 0) -> DataFrame:
    """Inner product of fixed-dimensional encodings, then the filter, then exact scores."""
    params = fde.Params(DIM)
    found = searched(fde.documents(x.tok, params), "pid", "fde", fde.queries(x.qtok, params), "qid", "fde", p.cands).select("qid", "pid")
    if mask:
        found = found.join(_passing(x, mask), "pid", "left_semi")
    return _final(score.rerank(found, x.queries, x.passages), p.top_k)


ENGINES = {
    "E0_exact": exact,
    "E1_staged_post": staged,
    "E2_staged_early": staged_early,
    "E3_staged_middle": staged_middle,
    "E4_staged_early_rerank": staged_early,
    "E5_codebook": codebook,
    "E6_codebook_scan": codebook,
    "E7_codebook_all": codebook_all,
    "E8_codebook_centroid": codebook_centroid,
    "E9_rotated_ivf": rotated_ivf,
    "E10_ivf_plain": ivf_plain,
    "E11_ivf_impute": ivf_impute,
    "E12_ivf_tokens": ivf_tokens,
    "E13_ivf_residual": ivf_residual,
    "E14_ivf_residual_only": ivf_residual_only,
    "E15_ivf_graph": ivf_impute,
    "E16_ivf_hash": ivf_impute,
    "E17_ivf_pairs": ivf_impute,
    "E18_ivf_adaptive": ivf_adaptive,
    "E19_ivf_nonempty": ivf_nonempty,
    "E20_ivf_nonempty_adaptive": ivf_nonempty_adaptive,
    "E21_ivf_floor_nonempty": ivf_floor_nonempty,
    "E22_ivf_skip_empty": ivf_skip_empty,
    "E23_fixed_dimensional": fixed_dimensional,
    "E24_codebook_topk": codebook_topk,
}


def search(engine: str, x: Fixtures, p: Params | None = None, mask: int = 0) -> DataFrame:
    """All queries of ``x`` through one engine: qid, rk, pid, score."""
    if engine not in ENGINES:
        raise ValueError(f"no engine {engine}; there are {', '.join(ENGINES)}")
    return ENGINES[engine](x, p or Params(), mask)
