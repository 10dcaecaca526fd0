"""Properties of the operators on small seeded inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import codec, vec
from quillon.operators import collection, diag, evaluate, fde, filters, index, probe, score
from quillon.operators.matrix import best, exact_scan
from quillon.plans.engines import Params, search
from quillon.sources import readers


def unit(rng, *shape):
    v = rng.normal(size=shape)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    tok = [(p, i, v.tolist()) for p in range(60) for i, v in enumerate(unit(rng, int(rng.integers(1, 6)), 16))]
    toks = spark.createDataFrame([(p, i, n, v) for n, (p, i, v) in enumerate(tok)], "pid long, pos int, tok_id long, emb array<double>").cache()
    cen = spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(unit(rng, 12, 16))], "cid long, emb array<double>").cache()
    qtok = spark.createDataFrame([(q, t, v.tolist()) for q in range(5) for t, v in enumerate(unit(rng, 4, 16))], "qid long, qt int, emb array<double>").cache()
    return toks, cen, qtok


def nested(df, key, pos):
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "emb"))), lambda x: x["emb"]).alias("toks"))


def test_exact_scan_is_maxsim(spark, corpus):
    toks, _, qtok = corpus
    p, q = nested(toks, "pid", "pos"), nested(qtok, "qid", "qt")
    docs, qs = {r.pid: np.array(r.toks) for r in p.collect()}, {r.qid: np.array(r.toks) for r in q.collect()}
    got = {(r.qid, r.rk): (r.pid, r.score) for r in exact_scan(p, q, 7, block=2).collect()}
    for qid, m in qs.items():
        want = sorted(((m @ d.T).max(axis=1).sum(), -pid) for pid, d in docs.items())[::-1][:7]
        assert [got[qid, i + 1][0] for i in range(7)] == [-b for _, b in want]
        assert np.allclose([got[qid, i + 1][1] for i in range(7)], [a for a, _ in want])


def test_imputation_keeps_the_ranking(spark, corpus):
    toks, cen, qtok = corpus
    ivf = index.plain_ivf(index.assign(toks, cen))
    o = probe.imputed(probe.ranked(qtok, cen, 4), 3).cache()
    shifted = {(r.qid, r.pid): r.approx for r in score.summed_max(o.join(ivf, "cid")).collect()}
    floors = {(r.qid, r.qt): r.floor for r in o.select("qid", "qt", "floor").distinct().collect()}
    hit = o.join(ivf, "cid").groupBy("qid", "qt", "pid").agg(F.max("score").alias("b")).collect()
    b = {(r.qid, r.qt, r.pid): r.b for r in hit}
    for (qid, pid), s in shifted.items():
        whole = sum(b.get((qid, t, pid), floors[qid, t]) for t in range(4))
        assert abs(whole - s - sum(floors[qid, t] for t in range(4))) < 1e-9


def test_nonempty_floor_is_lower(spark, corpus):
    toks, cen, qtok = corpus
    ivf = index.plain_ivf(index.assign(toks, cen))
    ranks = probe.ranked(qtok, cen, 12).cache()
    counts = probe.list_counts(ivf, toks.where(F.col("pid") < 4).select("pid"))
    plain = {(r.qid, r.qt): r.floor for r in probe.imputed(ranks, 2).collect()}
    deep = {(r.qid, r.qt): r.floor for r in probe.imputed(probe.nonempty(ranks, counts), 2).collect()}
    assert deep and all(deep[k] <= plain[k] + 1e-12 for k in deep)
    every = probe.list_counts(ivf, toks.select("pid"))
    full = probe.imputed(probe.nonempty(ranks.join(every, "cid", "left_semi"), every), 2).select("qid", "qt", "cid", "floor")
    assert full.exceptAll(probe.imputed(probe.nonempty(ranks, every), 2).select("qid", "qt", "cid", "floor")).count() == 0


def test_adaptive_depth(spark):
    ranks = spark.createDataFrame([(0, 0, r, r - 1, 1.0 - r / 100) for r in range(1, 34)], "qid long, qt int, rn int, cid long, score double")
    even = spark.createDataFrame([(c, 10, 2) for c in range(40)], "cid long, tot long, pass long")
    none = spark.createDataFrame([(c, 10, 0) for c in range(40)], "cid long, tot long, pass long")
    assert probe.adaptive(ranks, even, 4, 32, 0.2).first().nc_eff == 4
    assert probe.adaptive(ranks, none, 4, 32, 0.2).first().nc_eff == 32


def test_residual_lut_is_the_decoded_dot(spark):
    rng = np.random.default_rng(1)
    w = (-0.031, -0.009, 0.008, 0.030)
    d = spark.createDataFrame([(unit(rng, 16).tolist(), [int(x) for x in rng.integers(0, 256, 4)]) for _ in range(20)], "q array<double>, data array<int>")
    r = d.select(codec.lut_dot(codec.lut(F.col("q"), w, 16), F.col("data")).alias("a"), vec.dot(F.col("q"), codec.decoded(F.col("data"), w)).alias("b")).collect()
    assert all(abs(x.a - x.b) < 1e-12 for x in r)


def test_packing_keeps_buckets(spark):
    cuts = (-0.1, 0.0, 0.1)
    d = spark.createDataFrame([([-1.0, -0.05, 0.05, 1.0],)], "r array<double>")
    assert d.select(codec.packed(codec.quantized(F.col("r"), cuts), 4).alias("b")).first().b == [0b00011011]


@pytest.mark.parametrize("pid", [0, 1, 255, 256, 65535, 65536, 8388608, 16777215])
def test_pid24(spark, pid):
    d = spark.createDataFrame([(pid,)], "p long")
    assert d.select(codec.pid24_read(codec.pid24(F.col("p"))).alias("b")).first().b == pid


@pytest.mark.parametrize("pid", [16777216, -1])
def test_pid24_overflow(spark, pid):
    with pytest.raises(Exception, match="24 bits"):
        spark.createDataFrame([(pid,)], "p long").select(codec.pid24(F.col("p"))).collect()


@pytest.mark.parametrize("pid", [0, 16777215, 16777216, 8111 * 10_256, (1 << 40) + 5, -1])
def test_ids_beyond_24_bits(spark, pid):
    """The low bytes come first, and nothing of a wide id is lost."""
    b = spark.createDataFrame([(pid,)], "p long").select(codec.pid_bytes(F.col("p")).alias("b"))
    r = b.select("b", codec.pid_bytes_read(F.col("b")).alias("p")).first()
    assert r.p == pid and r.b[:3] == [pid >> 8 * i & 255 for i in range(3)] and len(r.b) == (3 if 0 <= pid < 1 << 24 else 8)


def test_pad_rows():
    assert index.real_tokens(1512, 1000) == 1000
    assert index.real_tokens(1000, 1000) == 1000
    for n in (999, 1001, 1511, 1513):
        with pytest.raises(ValueError):
            index.real_tokens(n, 1000)


def test_filters_only_keep_passing(spark):
    d = spark.createDataFrame([(1, 0b01), (2, 0b10), (3, 0b11), (4, 0)], "pid long, pred long")
    kept = lambda m: [r.pid for r in d.where(filters.passes(F.col("pred"), m)).orderBy("pid").collect()]
    assert kept(0) == [1, 2, 3, 4] and kept(1) == [1, 3] and kept(2) == [2, 3] and kept(3) == [1, 2, 3] and kept(1 << 31) == []


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 3, 9)], "qid long, rk int, pid long")
    qrels = spark.createDataFrame([(1, 9)], "qid long, pid long")
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    m = {r.qid: r for r in evaluate.metrics(run, qrels, q, 10).collect()}
    assert abs(m[1].mrr - 1 / 3) < 1e-12 and m[1].success == 1 and m[1].recall == 1 and m[2].mrr == 0
    assert evaluate.metrics(run, qrels, q, 2).where("qid = 1").first().success == 0
    truth = spark.createDataFrame([(1, 1, 5), (1, 2, 8), (1, 3, 9)], "qid long, rk int, pid long")
    r = {x.qid: x.recall for x in evaluate.truth_recall(run, truth, q, 10).collect()}
    assert abs(r[1] - 2 / 3) < 1e-12 and r[2] is None


def test_operating_points(spark):
    pts = spark.createDataFrame([("a", 1, 1.0, 0.5), ("a", 2, 2.0, 0.4), ("a", 3, 3.0, 0.9), ("b", 4, 1.5, 0.7)], "engine string, config long, lat double, quality double")
    assert [r.config for r in evaluate.pareto(pts, ["engine"]).orderBy("config").collect()] == [1, 3, 4]
    assert {r.engine: r.config for r in evaluate.fastest(pts, 0.6, ["engine"]).collect()} == {"a": 3, "b": 4}
    assert evaluate.primary(pts, [0.5, 0.7, 0.8]).first().target == 0.7
    with pytest.raises(Exception, match="no target"):
        evaluate.primary(pts, [0.95]).collect()


def test_split_is_stable(spark):
    q = spark.createDataFrame([(f"q{i}",) for i in range(200)], "qid string")
    a = {r.qid for r in evaluate.split(q, 20, 3).where("part = 'tune'").collect()}
    b = {r.qid for r in evaluate.split(q.orderBy(F.desc("qid")), 20, 3).where("part = 'tune'").collect()}
    c = {r.qid for r in evaluate.split(q, 20, 4).where("part = 'tune'").collect()}
    assert len(a) == 20 and a == b and a != c


def test_more_buckets_track_maxsim_better(spark):
    rng = np.random.default_rng(0)
    centers = unit(rng, 40, 16)
    tok = spark.createDataFrame([(p, i, (centers[rng.integers(40)] + 0.05 * rng.normal(size=16)).tolist()) for p in range(150) for i in range(6)], "pid long, pos int, emb array<double>")
    qt = spark.createDataFrame([(0, i, (centers[i] + 0.05 * rng.normal(size=16)).tolist()) for i in range(6)], "qid long, qt int, emb array<double>")
    exact = {r.pid: r.score for r in exact_scan(nested(tok, "pid", "pos"), nested(qt, "qid", "qt"), 150).collect()}

    def corr(k):
        p = fde.Params(16, reps=8, k=k, d_proj=8)
        got = {r.pid: r.score for r in best(fde.queries(qt, p).withColumnRenamed("fde", "v"), ["qid"], "v", fde.documents(tok, p), "pid", "fde", 150).collect()}
        return np.corrcoef([exact[p_] for p_ in sorted(exact)], [got[p_] for p_ in sorted(exact)])[0, 1]

    assert corr(4) > corr(0)


def test_kmeans_finds_blobs(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(4, 3)) * 5
    pts = spark.createDataFrame([((c[i % 4] + 0.01 * rng.normal(size=3)).tolist(),) for i in range(200)], "emb array<double>")
    got = index.kmeans(pts, 4)
    assert max(np.linalg.norm(got - x, axis=1).min() for x in c) < 0.1


def test_rotation_is_orthonormal(spark, corpus):
    r = index.rotation(corpus[1], 8)
    assert np.allclose(r.T @ r, np.eye(8)) and len(index.fingerprint(r)) == 64
    with pytest.raises(ValueError):
        index.compatible({"rotation": "a", "entries": 4, "top_m": 2}, {"rotation": "b", "entries": 4, "top_m": 2})


def test_sources(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("1\twhat\nbroken\n 2 \twhy\tnow\n")
    assert [(r.qid, r.text) for r in readers.questions(readers.lines(spark, str(tmp_path / "q.tsv"))).orderBy("qid").collect()] == [("1", "what"), ("2", "why")]
    (tmp_path / "r.tsv").write_text("a\t0\t5\t1\na\t0\t5\t1\nb\t7\t0\nc\t8\t2\n")
    assert sorted((r.qid, r.pid) for r in readers.qrels(readers.lines(spark, str(tmp_path / "r.tsv"))).collect()) == [("a", 5), ("c", 8)]
    (tmp_path / "c.tsv").write_text("0\ta\n2\tb\n")
    with pytest.raises(ValueError):
        readers.collection(readers.lines(spark, str(tmp_path / "c.tsv")), check=True)
    (tmp_path / "v.fvecs").write_bytes(b"".join(np.int32(2).tobytes() + np.array([i, i + 1], "<f4").tobytes() for i in range(3)))
    assert [list(r.vec) for r in readers.fvecs(spark, str(tmp_path / "v.fvecs")).orderBy("id").collect()] == [[0, 1], [1, 2], [2, 3]]
    readers.write_json({"a": np.arange(3), "b": np.float32(1)}, str(tmp_path / "x.json"))
    assert "[" in (tmp_path / "x.json").read_text()


def test_block_match_errors(spark):
    joint = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "b")], "pid long, text string")
    with pytest.raises(Exception, match="exactly once"):
        collection.block_offset(joint, spark.createDataFrame([(0, "a"), (1, "b")], "pid long, text string")).collect()
    assert collection.block_offset(joint, spark.createDataFrame([(0, "b"), (1, "a")], "pid long, text string")).first().offset == 1


def test_encoder_takes_every_word(spark):
    text = " ".join(f"w{i}" for i in range(100))
    d = spark.createDataFrame([(0, text)], "pid long, text string")
    assert [r.word for r in collection.hashed_encoder(d, 8).orderBy("pos").collect()] == text.split()
    assert collection.hashed_encoder(d, 8, most=32).count() == 32


def test_encoder_by_single_coordinates(spark):
    import hashlib

    d = collection.hashed_words(spark.createDataFrame([(0, "a  b\nc d")], "pid long, text string"))
    one = d.select("pos", "word", collection.hashed_sign(F.substring("h", 64, 1), 64).alias("last")).collect()
    whole = {r.pos: r.emb for r in collection.hashed_encoder(spark.createDataFrame([(0, "a  b\nc d")], "pid long, text string"), 64).collect()}
    assert {r.pos: r.last for r in one} == {i: e[63] for i, e in whole.items()}
    assert all(whole[r.pos] == [(-1) ** int(c, 16) / 8 for c in hashlib.sha256(r.word.encode()).hexdigest()] for r in one)


def test_slice_hits_of_many_queries(spark):
    rng = np.random.default_rng(3)
    q, p = unit(rng, 1100, 4), unit(rng, 3, 4)
    made = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{n} long, emb array<double>") for n, m in (("qid", q), ("pid", p))]
    got = {(r.qid, r.pid): r.hits for r in diag.slice_hits(*made, 2, 2, 0.5).collect()}
    near = ((q[:, None] - p[None]) ** 2).reshape(1100, 3, 2, 2).sum(axis=3) <= 0.5
    assert got == {(i, j): int(near[i, j].sum()) for i in range(1100) for j in range(3)}


def test_codebooks_of_every_subspace(spark):
    from quillon.plans import load, registry
    from quillon.plans.fixtures import SUB

    load()
    d = registry.queries()["B4_codebooks"](spark, "/root/testdata/sf0.001").groupBy("s").count()
    assert {r["s"]: r["count"] for r in d.collect()} == dict.fromkeys(range(SUB), 16)


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        Params(k_eids=0)
    with pytest.raises(ValueError):
        search("nothing", None)


def test_passage_of_over_block_borders(spark):
    """Ragged passages that span blocks, a block without any start, and ids that leave gaps."""
    rng = np.random.default_rng(4)
    starts = np.unique(rng.integers(3, 400, 25)) * 7
    tokens = np.unique(np.r_[rng.integers(0, 2900, 900), starts])
    d = index.passage_of(
        spark.createDataFrame([(int(t),) for t in tokens], "tok_id long").repartition(3),
        spark.createDataFrame([(int(t), 10 * i) for i, t in enumerate(starts)], "tok_id long, pid long"), block=50,
    )
    want = {int(t): (10 * (k - 1) if k else None) for t, k in zip(tokens, np.searchsorted(starts, tokens, side="right").tolist(), strict=True)}
    assert {r.tok_id: r.pid for r in d.collect()} == want


@pytest.mark.parametrize("most", [64_000_000, 60])
def test_held_sides_in_blocks(spark, monkeypatch, most):
    from quillon.operators import matrix

    monkeypatch.setattr(matrix, "MOST_HELD", most)
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(23, 6)), rng.normal(size=(57, 6))
    b[50] = b[3]  # a tie
    frame = lambda m, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, emb array<double>").repartition(3)
    for depth in (1, 4, 100):
        order = np.array([np.lexsort((np.arange(57), -np.round(r, 6)))[:depth] for r in a @ b.T])
        want = {(i, k + 1): int(j) for i, r in enumerate(order) for k, j in enumerate(r)}
        got = matrix.best(frame(a, "q"), ["q"], "emb", frame(b, "cid"), "cid", "emb", depth).collect()
        assert {(r.q, r.rn): r.cid for r in got} == want
        got = matrix.searched(frame(b, "pid"), "pid", "emb", frame(a, "qid"), "qid", "emb", depth).collect()
        assert {(r.qid, r.rn): r.pid for r in got} == want
    assert matrix.searched(frame(b, "pid").limit(0), "pid", "emb", frame(a, "qid"), "qid", "emb", 3).count() == 0
    near = {r.q: (r.cid, r.d2) for r in index.nearest(frame(a, "q"), frame(b, "cid")).collect()}
    d2 = ((a[:, None, :] - b[None]) ** 2).sum(axis=2)
    assert all(near[i][0] == int(d2[i].argmin()) and abs(near[i][1] - d2[i].min()) < 1e-9 for i in range(23))


def test_other_names_of_an_engine_agree(spark):
    from quillon.plans.engines import ENGINES, Params, search
    from quillon.plans.fixtures import MASK, Fixtures

    x = Fixtures(spark, "/root/testdata/sf0.001")
    rows = lambda name, mask: {tuple(r) for r in search(name, x, Params(), mask).select("qid", "rk", "pid").collect()}
    for names in (("E2_staged_early", "E4_staged_early_rerank"), ("E5_codebook", "E6_codebook_scan"), ("E11_ivf_impute", "E15_ivf_graph", "E16_ivf_hash", "E17_ivf_pairs")):
        for mask in (0, MASK):
            assert len({frozenset(rows(n, mask)) for n in names}) == 1 and all(n in ENGINES for n in names)


def test_stored_index_gives_the_same_answers(spark, tmp_path):
    from quillon.plans import store
    from quillon.plans.engines import ENGINES, Params, search
    from quillon.plans.fixtures import MASK, Fixtures

    x = Fixtures(spark, "/root/testdata/sf0.001")
    facts = store.build(x, f"file://{tmp_path}/index").first().asDict()
    assert facts.pop("postings") == x.ivf.count() and facts.pop("lists") == x.ivf.select("cid").distinct().count() and facts.pop("wide_ids") == 0
    assert all(v is True for v in facts.values())
    y = store.Stored(spark, f"file://{tmp_path}/index")
    rows = lambda name, v, mask: {(r.qid, r.rk, r.pid, round(r.score, 6)) for r in search(name, v, Params(), mask).select("qid", "rk", "pid", "score").collect()}
    for name in ("E0_exact", "E1_staged_post", "E5_codebook", "E11_ivf_impute", "E13_ivf_residual", "E18_ivf_adaptive"):
        assert name in ENGINES
        for mask in (0, MASK):
            assert rows(name, x, mask) == rows(name, y, mask), name
    y.postings.limit(5).withColumn("eid", F.lit(9999)).write.mode("append").parquet(f"file://{tmp_path}/index/postings")
    assert not store.check(store.Stored(spark, f"file://{tmp_path}/index")).first().eids_known


def test_ground_truth_is_resumed_and_merged(spark, tmp_path):
    made = []

    def exact(name):
        def run():
            made.append(name)
            return spark.createDataFrame([(1, 1, len(name), 0.5)], "qid long, rk int, pid long, score double")

        return run

    path = f"file://{tmp_path}/truth"
    evaluate.ground_truth(spark, path, {n: exact(n) for n in ("all", "syn14")})
    (tmp_path / "truth" / "filter=syn14" / "_SUCCESS").unlink()  # as if its writing had been cut off
    got = evaluate.ground_truth(spark, path, {n: exact(n) for n in ("all", "syn14", "own")})
    assert made == ["all", "syn14", "syn14", "own"]
    assert {(r["filter"], r.pid) for r in got.collect()} == {("all", 3), ("syn14", 5), ("own", 3)}


def test_binary_vectors(spark, tmp_path):
    m = np.random.default_rng(2).normal(size=(9000, 5)).astype("<f4")
    np.c_[np.full((9000, 1), 5, "<i4").view("<f4"), m].astype("<f4").tofile(tmp_path / "a.fvecs")
    np.save(tmp_path / "b.npy", m)
    rows = [(i, v.tolist()) for i, v in enumerate(m[:50].astype(float))]
    readers.write_npz(str(tmp_path / "c.npz"), emb=(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), "id", "v"))
    for name, d, want in (("a", readers.fvecs(spark, f"{tmp_path}/a.fvecs"), m), ("b", readers.npy(spark, f"{tmp_path}/b.npy"), m), ("c", readers.npy(spark, f"{tmp_path}/c.npz", "emb"), m[:50])):
        got = sorted(d.collect(), key=lambda r: r.id)
        assert [r.id for r in got] == list(range(len(want))) and np.array_equal(np.array([r.vec for r in got], np.float32), want), name
    (tmp_path / "bad.fvecs").write_bytes(np.array([5, 1], "<i4").tobytes())
    with pytest.raises(Exception, match="aren't vectors"):
        readers.fvecs(spark, f"{tmp_path}/bad.fvecs").collect()


def test_trained_views(spark):
    """A trained rotation turns tokens as numpy does; trained books are whole, stable and closer than picked ones of their size."""
    from quillon.plans.engines import search
    from quillon.plans.fixtures import ROT, SUB, Fixtures, Trained

    x = Trained(spark, "/root/testdata/sf0.001", 8)
    r = x.rotation
    assert r.shape == (64, ROT) and np.allclose(r.T @ r, np.eye(ROT))
    given = {t.tok_id: np.array(t.emb) for t in x.tok.select("tok_id", "emb").collect()}
    for t in x.rtok.select("tok_id", "emb").collect():
        want = given[t.tok_id] @ r
        assert np.allclose(t.emb, want / np.linalg.norm(want))
    words = {(w.s, w.eid): tuple(w.w) for w in x.codewords.collect()}
    slices = [(t.s, np.array(t.x), t.tenth) for t in x.slices.select("s", "x", x._tenth.alias("tenth")).collect()]
    assert len(words) == SUB * 8 and 0 < sum(t for _, _, t in slices) < len(slices) / 4
    seen = spark.createDataFrame([(s, v.tolist()) for s, v, t in slices[::-1] if not t], "s int, x array<double>").repartition(7)
    assert words == {(w.s, w.eid): tuple(w.w) for w in index.train_codebooks(seen, 8).collect()}
    for e in x.errors.collect():
        book = np.array([words[e.s, i] for i in range(8)])
        off = [(((book - v) ** 2).sum(axis=1).min(), (v * v).sum()) for s, v, t in slices if t and s == e.s]
        assert abs(e.mse - np.mean([d for d, _ in off])) < 1e-8 and abs(e.rel_err - sum(d for d, _ in off) / sum(n for _, n in off)) < 1e-6
    mse = lambda book: index.codebook_error(x.slices.select("s", "x"), book).agg(F.avg("mse")).first()[0]
    assert mse(x.codewords) < mse(Fixtures(spark, x.dir, 8).codewords)
    for engine in ("E5_codebook", "E9_rotated_ivf"):
        recall = evaluate.truth_recall(search(engine, x, Params(nc=8, ndocs=100)), x.truth, x.queries, 10).agg(F.avg("recall")).first()[0]
        assert recall > 0.5, (engine, recall)


def test_shortlist_by_principal_directions(spark):
    rng = np.random.default_rng(11)
    low = rng.normal(size=(12, 3)) @ rng.normal(size=(3, 12))  # three directions hold everything
    e = rng.normal(size=(80, 12)) @ low
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "pid long, emb array<double>")
    q = p.where("pid < 6").withColumnRenamed("pid", "qid")
    basis = np.linalg.svd(e, full_matrices=False)[2].T
    got = lambda m: {r.qid: r.recall for r in diag.shortlist_recall(q, p, m, 5, 2, basis).collect()}
    assert got(3) == dict.fromkeys(range(6), 1.0)
    short, top = e @ basis[:, :1], lambda s, k: set(np.lexsort((np.arange(80), -np.round(s, 6)))[:k])
    assert got(1) == {i: len(top(e @ e[i], 5) & top(short @ short[i], 10)) / 5 for i in range(6)}


def test_signed_masks(spark):
    d = spark.createDataFrame([(0,), (5,), (2**31 - 1,), (2**31,), (2**32 - 1,), (None,)], "m long")
    assert [r.s for r in d.select(filters.signed32(F.col("m")).alias("s")).collect()] == [0, 5, 2**31 - 1, -(2**31), -1, None]


def test_agreement_of_encodings(spark):
    a = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.0, 2.0]), (1, 3, [1.0, 1.0])], "qid long, tok_id long, emb array<double>")
    b = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.0])], "tok_id long, emb array<double>")
    got = {r.qid: (r.least, r.same_count) for r in diag.agreement(a, b, "tok_id").collect()}
    assert abs(got[0][0] - 0.5**0.5) < 1e-9 and got[0][1] is True and got[1] == (None, False)


def _words(spark, rng, n=150):
    w = rng.normal(size=(2, n, 3)).round(1)  # coarse, so that many are equal
    return w, spark.createDataFrame([(s, i, v.tolist()) for s in range(2) for i, v in enumerate(w[s])], "s int, eid int, w array<double>")


@pytest.mark.parametrize("most", [8_000_000, 200])
def test_codewords_of_slices(spark, monkeypatch, most):
    """Nearest ones, best hits and quantiles of distances as all pairs give them, with books in one block and in several."""
    from quillon.operators import codebook, matrix

    monkeypatch.setattr(matrix, "MOST_HELD", most)
    rng = np.random.default_rng(12)
    w, book = _words(spark, rng)
    x = rng.normal(size=(70, 6)).round(1)
    slices = spark.createDataFrame([(i, s, x[i, 3 * s : 3 * s + 3].tolist()) for i in range(70) for s in range(2)] * 2, "i long, s int, x array<double>").repartition(3)
    d2 = np.array([np.round(((x[:, None, 3 * s : 3 * s + 3] - w[s][None]) ** 2).sum(axis=2), 9) for s in range(2)])
    got = codebook.nearest(slices, book).collect()
    assert len(got) == 280 and all((r.eid, r.d2) == (int(d2[r.s, r.i].argmin()), d2[r.s, r.i].min()) for r in got)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, emb array<double>").repartition(3)
    hit = np.array([x[:, 3 * s : 3 * s + 3] @ w[s].T for s in range(2)])
    for k, least in ((4, 0.0), (3, 0.9), (None, None)):
        order = {(s, i): [e for e in np.lexsort((np.arange(150), -np.round(hit[s, i], 9)))[:k] if least is None or (hit[s, i, e] > 0 and hit[s, i, e] >= least)] for s in range(2) for i in range(70)}
        want = {(i, s, int(e)) for (s, i), es in order.items() for e in es}
        found = [(r.i, r.s, r.eid) for r in codebook.hits(rows, book, 2, 3, k, least).collect()]
        assert len(found) == len(want) and set(found) == want
    for part in (0.0, 0.25, 0.9, 1.0):
        got = {r.s: r.r2 for r in codebook.quantile(rows.select("emb"), book, 2, 3, part).collect()}
        assert got.keys() == {0, 1} and all(abs(got[s] - np.quantile(d2[s], part)) < 1e-8 for s in got)


def test_best_of_wide_sides():
    from quillon.operators import matrix

    s = np.random.default_rng(13).normal(size=(40, 3001)).round(2)  # ties everywhere
    for k in (1, 3, 20, 3001):
        r, c = matrix.top(s, k)
        assert (r == np.repeat(np.arange(40), k)).all()
        assert (c.reshape(40, k) == np.argsort(-s, axis=1, kind="stable")[:, :k]).all()


@pytest.mark.parametrize("most", [8_000_000, 64])
def test_floors_and_interaction_without_full_rankings(spark, corpus, monkeypatch, most):
    from quillon.operators import matrix

    monkeypatch.setattr(matrix, "MOST_HELD", most)
    toks, cen, qtok = corpus
    c = np.array([r.emb for r in cen.orderBy("cid").collect()])
    q = {k: np.array([r.emb for r in qtok.where(F.col("qid") == k).orderBy("qt").collect()]) for k in range(5)}
    floors = {(r.qid, r.qt): r.floor for r in probe.with_floor(probe.plain(probe.ranked(qtok, cen, 3), 3), qtok, cen.where("cid % 2 = 0")).collect()}
    for (k, t), f in floors.items():
        s = c @ q[k][t]
        assert abs(f - max(v for v in s[::2] if v < np.sort(s)[-3] - 1e-9)) < 1e-9
    passages, queries = nested(toks, "pid", "pos"), nested(qtok, "qid", "qt")
    codes = index.assign(toks, cen).cache()
    of = {r.pid: sorted(r.c) for r in codes.groupBy("pid").agg(F.collect_set("cid").alias("c")).collect()}
    cand = queries.select("qid").crossJoin(passages.select("pid")).where("(qid + pid) % 3 > 0")
    got = score.interaction(cand, codes, queries, cen, 0.6).collect()
    assert len(got) == cand.count()
    for r in got:
        s = q[r.qid] @ c[of[r.pid]].T
        kept = s[:, s.max(axis=0) >= 0.6]
        assert abs(r.approx - s.max(axis=1).sum()) < 1e-9 and abs(r.pruned - (kept.max(axis=1).sum() if kept.size else 0)) < 1e-9
    a, b = ({(r.qid, r.pid): r.score for r in f(cand, queries, passages).collect()} for f in (score.rerank, score.rerank_many))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_hits_are_counted_in_place(spark):
    rng = np.random.default_rng(14)
    q, p = unit(rng, 30, 8), unit(rng, 50, 8)
    qd, pd = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{n} long, emb array<double>") for m, n in ((q, "qid"), (p, "pid")))
    hits = (np.round(((q[:, None] - p[None]) ** 2).reshape(30, 50, 4, 2).sum(axis=3), 9) <= 0.4).sum(axis=2)
    truth = [(i, int(j)) for i in range(30) for j in np.argsort(-q[i] @ p.T)[:3]]
    r = diag.hit_filter(qd, pd, 4, 2, 0.4, spark.createDataFrame(truth, "qid long, pid long"), 3).first()
    assert abs(r.share - (hits >= 3).mean()) < 1e-12 and abs(r.recall - np.mean([hits[t] >= 3 for t in truth])) < 1e-12


def test_products_in_single_precision_are_those_in_double(monkeypatch):
    from quillon.operators import matrix
    from quillon.operators.matrix import top, top_products

    monkeypatch.setattr(matrix, "TILE", 256)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(900, 24))
    m[300:600] = m[:300] + rng.choice([0, 3e-8, 4e-7], size=(300, 1))  # nearer than single precision tells
    x = np.vstack([rng.normal(size=(50, 24)), m[:50]])
    for scale in (1.0, 1e-4, 1e9, 1e200):
        for k in (1, 4, 40, 900):
            s = (x * scale) @ m.T
            r, c = top(s, k)
            got = top_products(x * scale, m, k)
            assert (got[0] == r).all() and (got[1] == c).all()
            assert np.allclose(got[2], s[r, c], rtol=1e-12)
    assert (top_products(np.ones((3, 24)), np.ones((900, 24)), 2)[1] == [0, 1] * 3).all()


def test_hits_by_boxes_are_the_best_products():
    from quillon.operators.codebook import Tree, _pruned

    rng = np.random.default_rng(6)
    w = np.vstack([rng.normal(size=(3000, 3)), np.zeros((40, 3))])
    w[100:200] = w[:100]  # equal words: the lesser eid goes first
    eids, x = rng.permutation(len(w)) * 7, np.vstack([rng.normal(size=(300, 3)), np.zeros((1, 3))])
    order = np.argsort(eids)
    eids, w = eids[order], w[order]
    for k in (1, 4, 16):
        r, e, v = _pruned(x, Tree(eids, w), k, 9)
        h = np.round(x @ w.T, 9)
        want = np.array([np.lexsort((eids, -row))[:k] for row in h])
        assert (r == np.repeat(np.arange(len(x)), k)).all() and (e == eids[want].ravel()).all()
        assert np.allclose(v, h[r, want.ravel()], atol=1e-8)


@pytest.mark.parametrize("k", [3, 700])
def test_scan_reads_passages_once(spark, monkeypatch, k):
    from quillon.operators import matrix

    monkeypatch.setattr(matrix, "WORK", 500)  # so that a task's best are merged, and leave, early
    rng = np.random.default_rng(7)
    t, u = np.round(rng.normal(size=(600, 2, 4)), 2), np.round(rng.normal(size=(300, 3, 4)), 2)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], "pid long, toks array<array<double>>").repartition(2)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "qid long, toks array<array<double>>")
    d = exact_scan(p, q, k)
    assert d._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    s = np.round(np.einsum("qad,pbd->qpab", u, t).max(axis=3).sum(axis=2), 6)
    want = {(i, rk + 1): pid for i, row in enumerate(s) for rk, pid in enumerate(np.lexsort((np.arange(600), -row))[:k].tolist())}
    assert {(r.qid, r.rk): r.pid for r in d.collect()} == want


@pytest.mark.parametrize("held", [8_000_000, 40])
def test_interaction_by_several_floors(spark, monkeypatch, held):
    from quillon.operators import matrix, score

    rng = np.random.default_rng(8)
    cen = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 4)))], "cid long, emb array<double>")
    codes = spark.createDataFrame([(int(i), int(c)) for i in range(70_000, 70_060) for c in rng.integers(0, 20, 3)], "pid long, cid long")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(5, 2, 4)))], "qid long, toks array<array<double>>")
    cand = queries.select("qid").crossJoin(codes.select("pid").distinct())
    monkeypatch.setattr(matrix, "MOST_HELD", held)
    floors = (0.5, 1.5, 9.0)
    got = {(r.qid, r.pid): r for r in score.interaction(cand, codes, queries, cen, floors).collect()}
    assert len(got) == 300
    for i, least in enumerate(floors):
        for r in score.interaction(cand, codes, queries, cen, least).collect():
            assert got[r.qid, r.pid].pruned[i] == pytest.approx(r.pruned) and got[r.qid, r.pid].approx == pytest.approx(r.approx)


def test_budget_sweep_takes_each_step_once(spark):
    from quillon.plans import load, registry

    load()
    plan = registry.queries()["V16_filter_budget"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 8, plan.count("MapInArrow")


def test_rerank_of_empty_passages(spark):
    from quillon.operators import score

    q = spark.createDataFrame([(0, [[1.0, 0.0], [0.0, 2.0]]), (1, [])], "qid long, toks array<array<double>>")
    p = spark.createDataFrame([(0, [[3.0, 1.0], [0.0, 5.0]]), (1, [])], "pid long, toks array<array<double>>")
    cand = q.select("qid").crossJoin(p.select("pid"))
    d = score.rerank(cand, q, p)
    assert {(r.qid, r.pid): r.score for r in d.collect()} == {(0, 0): 13.0, (0, 1): None, (1, 0): 0.0, (1, 1): 0.0}
    assert "MapInArrow" in d._jdf.queryExecution().executedPlan().toString()


def test_assignment_is_made_once_for_its_readers(spark):
    from quillon.plans import fixtures

    x = fixtures.Fixtures(spark, "/root/testdata/sf0.001")
    d = x.ivf.join(x.codes.groupBy("pid").count(), "pid")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 2
    n = d.count()
    for _ in range(5):
        fixtures.Fixtures(spark, "/root/testdata/sf0.001").codes
    assert len(fixtures._KEPT) == 4 and d.count() == n
