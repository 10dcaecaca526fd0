"""Operators for training data against brute force, on small tables with odd rows."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm import op01_topk, op02_tokens, op03_mix, op04_jaccard, op05_fingerprints, op06_ring, op07_toxicity, op08_quality, op09_suffix, op10_pack
from quillon.llm.components import components

NO_CONTEXT = ([], np.zeros((0, op08_quality.CONTEXT), np.float32))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, th long, key string, root long, shard int"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randint(20, 160)) for _ in range(40)]
    shared = words(rng, 30)
    texts = base + [base[3], base[3], base[7].replace("w1", "x1", 1), base[7] + " tail"]
    texts += [shared + " " + words(rng, 20) for _ in range(5)] + [None, None, "", " ", "\n\t", "a", "é" * 70, "日本語 " * 40, "b " * 3000, "b " * 3000, "ab" * 60, "ab" * 61]
    sources = ["s1", "s2", None, "s3", ""]
    out = [(i, t, None if i % 9 == 0 else "en", sources[0] if i % 3 == 0 else sources[i % 5], None if i % 11 == 0 else len(t or "")) for i, t in enumerate(texts)]
    return [*out, (None, base[3], None, None, None), (None, None, None, None, None), out[5], out[5]]


def frame(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, "k", 3, 4) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_topk(spark):
    rng = np.random.default_rng(0)
    vecs = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)]
    vecs += [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("nan")] * 4), (503, [1.0, 2.0]), (550, [1.0, 2.0]), (None, [1.0] * 4), (50, [0.1] * 4), (7, [float("inf")] * 4), (600, [])]
    e = spark.createDataFrame([(i, v, 1, 2) for i, v in vecs], "vec_id long, embedding array<float>, q int, score int").repartition(5)
    for size in (4096, 3):
        got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in op01_topk.topk(e.where("vec_id % 50 = 0"), e, 5, chunk=size).collect())
        use = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
        want = Counter()
        for i, q in use:
            if i % 50 == 0:
                s = sorted((-int(q @ c), j) for j, c in use if j != i and len(c) == len(q))[:5]
                want.update((i, k + 1, j, -a) for k, (a, j) in enumerate(s))
        assert got == want
    assert op01_topk.topk(e.limit(0), e.limit(0), 5).count() == 0


def test_token_counts(spark, docs, rows, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = P.path(op02_tokens.MODEL)
    t = Tokenizer(models.Unigram(op02_tokens.pieces_of(path), 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    got = Counter((r.doc_id, r.n_chars, r.n_tokens) for r in op02_tokens.count_tokens(docs, path).collect())
    assert got == Counter((i, len(x or ""), len(t.encode(x or "").ids)) for i, x, *_ in rows)
    assert op02_tokens.count_tokens(none, path).count() == 0


def test_token_ties():
    """Equal scores: the earliest start wins; unknown runs count one without byte fallback."""
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", -1.0)]
    u, t = op02_tokens.Unigram(vocab, False), Tokenizer(models.Unigram(vocab, 0, False))
    rng = random.Random(1)
    for _ in range(300):
        w = "▁" + "".join(rng.choice("abz") for _ in range(rng.randint(0, 9)))
        assert u.word(w[1:])[0] == len(t.encode(w).ids), w


def size_of(t):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mix(docs, rows, none):
    got = op03_mix.Mix(docs, block=4).taken().collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size_of(t)) for i, t, *_ in rows)
    by = {}
    for _, t, _, s, _ in rows:
        by[s] = by.get(s, 0) + size_of(t)
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(by), sum(by.values())
    while True:
        level = left / max(1, sum(weight[s] for s in free))
        full = {s for s in free if 3 * by[s] < level * weight[s]}
        if not full:
            break
        for s in full:
            target[s] = 3 * by[s]
            left -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in got:
        assert r.source_size == by[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in by:
        assert abs(taken[s] - target[s]) <= 0.005 * target[s] + 1
    again = op03_mix.Mix(docs.repartition(2), block=4).taken()
    assert Counter((r.doc_id, r.taken) for r in again.collect()) == Counter((r.doc_id, r.taken) for r in got)
    assert op03_mix.Mix(none).taken().count() == 0


def test_mixed_texts_hold_what_is_taken(docs):
    mix = op03_mix.Mix(docs, block=4)
    want, got = Counter(), Counter()
    for r in mix.taken().where("taken > 0").collect():
        want[r.doc_id] += r.taken
    out = mix.texts(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += size_of(r.text)
        assert r.n_chars == len(r.text)
    assert got == want


def test_mixed_texts_of_repeated_and_long_rows(spark):
    """Rows that differ in other columns only keep them; a long text is cut like others."""
    long = " ".join(f"v{i}" for i in range(30_000))
    made = [(1, "a b c d e f", "x", k) for k in range(6)] + [(2, long, "x", 9), (3, "x" * 1_000_000, "y", 1), (None, long, None, 2), (None, None, None, 3)]
    d = spark.createDataFrame(made, "doc_id long, text string, source string, other long")
    mix = op03_mix.Mix(d)
    out, want, whole = mix.texts(d).collect(), Counter(), {(i, k): t for i, t, _, k in made}
    for r in mix.taken().collect():
        want[r.doc_id] += r.taken
    got = Counter()
    for r in out:
        got[r.doc_id] += size_of(r.text)
        left = iter(whole[r.doc_id, r.other].split())
        assert all(w in left for w in r.text.split())  # in order
    assert got == {i: n for i, n in want.items() if n}
    assert all(r.text == "a b c d e f" or len(r.text) < 11 for r in out if r.doc_id == 1)


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        d = op03_mix.permuted(spark.range(n), "p", F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).collect()
        assert sorted(r.p for r in d) == list(range(n))


def test_mix_shards(spark):
    """Counts of sources in shards: totals are the quotas, each block is used once a pass, and shards look like multinomial draws."""
    made = [(i, "w " * (5 + i % 7), f"s{i % 4}") for i in range(4000)] + [(10_000 + i, "w w w", "tiny") for i in range(4)]
    mix = op03_mix.Mix(spark.createDataFrame(made, "doc_id long, text string, source string"), block=4, shard_slots=250)
    sources = {r.s: r for r in mix.sources.collect()}
    shards = mix.shards.collect()
    total = sum(r.quota for r in sources.values())
    count = total // 250
    n = Counter()
    for r in shards:
        n[r.s] += r.n
    assert n == {s: r.quota for s, r in sources.items() if r.quota}
    size = Counter()
    for r in shards:
        size[r.shard] += r.n
    assert len(size) == count and max(size.values()) - min(size.values()) <= 1 and sum(size.values()) == total
    slots = mix.slots().collect()
    assert Counter((r.shard, r.s) for r in slots) == {(r.shard, r.s): r.n for r in shards}
    uses = Counter((r.s, r["pass"], r.block) for r in slots)
    assert set(uses.values()) == {1} and all(r.quota <= 3 * r.blocks for r in sources.values())
    for s, r in sources.items():
        assert sorted(x.slot for x in slots if x.s == s) == list(range(r.quota))
    early = [r for r in shards if r.shard < 0.8 * count]  # not yet touched by the correction
    for s, r in sources.items():
        p, got = r.quota / total, [x.n for x in early if x.s == s]
        if p > 0.05:
            assert 0.5 < np.var(got) / (250 * p * (1 - p)) < 1.7 and abs(np.mean(got) / (250 * p) - 1) < 0.06


def jaccard_brute(rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").encode().split()) else frozenset() for _, t, *_ in rows]
    n = len(rows)
    link = [[bool(sets[i]) and i != j and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    group[i] = group[j] = min(group[i], group[j])
    out = Counter()
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if group[j] == group[i] and rows[j][0] is not None]
        out[rows[i][0], min(ids) if ids else None, sum(link[i])] += 1
    return out


@pytest.mark.parametrize("tile,wide", [(1024, 8192), (2, 8192), (2, 2)])
def test_jaccard(docs, rows, tile, wide):
    got = Counter((r.doc_id, r.class_id, r.links) for r in op04_jaccard.join(docs, tile=tile, wide=wide).collect())
    assert got == jaccard_brute(rows)


@pytest.mark.parametrize("tile,wide", [(1024, 8192), (5, 8192), (5, 6)])
def test_jaccard_of_near_copies(spark, tile, wide):
    """Groups whose members lie at all distances from each other, and a chain."""
    rng, made = random.Random(12), []
    for g in range(3):
        base = words(rng, 120, 5000).split()
        for k in range(40):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            made.append((1000 * g + k, " ".join(w)))
    chain = words(rng, 200, 5000).split()
    for k in range(30):
        made.append((9000 - k, " ".join(chain)))
        chain[5 * k : 5 * k + 3] = [f"y{k}", f"x{k}", f"u{k}"]
    d = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.class_id, r.links) for r in op04_jaccard.join(d, tile=tile, wide=wide).collect())
    assert got == jaccard_brute(made)


def test_jaccard_recall():
    """Of pairs at a similarity of 0.8, hardly any is lost to bands or pruning."""
    rng, lost, tried = np.random.default_rng(5), 0, 0
    least = op04_jaccard.least_matches(Fraction(4, 5), op04_jaccard.TOLERANCE)
    for size in (9, 45, 450):
        for _ in range(150):
            common = rng.integers(0, 2**64, size * 8 // 9, dtype=np.uint64)
            own = rng.integers(0, 2**64, (2, size - len(common)), dtype=np.uint64)
            a, b = (op04_jaccard.signature(np.unique(np.r_[common, x])) for x in own)
            same = a == b
            lost += not same.reshape(op04_jaccard.BANDS, op04_jaccard.ROWS).all(axis=1).any() or any(same[:n].sum() < k for n, k in least.items())
            tried += 1
    assert lost <= 0.01 * tried


def test_jaccard_empty(none):
    assert op04_jaccard.join(none).count() == 0
    assert op04_jaccard.representatives(none).columns == none.columns


def test_representatives(docs, rows):
    brute = jaccard_brute(rows)
    kept = op04_jaccard.representatives(docs).collect()
    worded = {r[0] for r in rows if r[0] is not None and (r[1] or "").encode().split()}
    assert {r.doc_id for r in kept} & worded == {c for _, c, _ in brute} & worded
    assert sum((r.text or "").encode().split() != [] for r in kept) == len({c for i, c, _ in brute if i in worded})
    blank = lambda some: Counter((r[0], r[1]) for r in some if not (r[1] or "").encode().split())
    assert blank(kept) == blank(rows)


def test_pruning_spares_pairs_at_the_threshold():
    least = op04_jaccard.least_matches(Fraction(4, 5), 1e-6)
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(2000):
        m = np.cumsum(rng.random(op04_jaccard.HASHES) < 0.8)
        lost += any(m[n - 1] < k for n, k in least.items())
    assert lost <= 2 and least[op04_jaccard.HASHES] > 140


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_fingerprints(docs, rows, none):
    got = op05_fingerprints.fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 4
        e = t[: len(t) - m] + nxt[:m]
        a, b, c = (op05_fingerprints.chunk_sets([x.encode()])[0] for x in (t, e, nxt))
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), op05_fingerprints.written(a), op05_fingerprints.written(b), round(op05_fingerprints.likeness(a, b), 9), round(op05_fingerprints.likeness(a, c), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert op05_fingerprints.fingerprints(none).count() == 0


def test_fingerprint_buckets(spark, monkeypatch):
    monkeypatch.setattr(op05_fingerprints, "BUCKET_ROWS", 10)
    monkeypatch.setattr(op05_fingerprints, "GROUP_BYTES", 300)
    rng = random.Random(9)
    rows = [(3 * i, words(rng, 30)) for i in range(95)]
    rng.shuffle(rows)
    got = {r.doc_id: r.edited_sha256 for r in op05_fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    rows.sort()
    assert got == {i: hashlib.sha256(op05_fingerprints.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest() for k, (i, t) in enumerate(rows)}


def test_chunks_are_shift_resistant():
    rng = random.Random(2)
    t = words(rng, 3000).encode()
    a, b = op05_fingerprints.chunk_sets([t, b"something new in front " + t])
    assert op05_fingerprints.likeness(a, b) > 0.95
    assert op05_fingerprints.read(op05_fingerprints.written(a)) == a
    assert op05_fingerprints.likeness([], []) == 1.0 and op05_fingerprints.likeness([], a) == 0.0 == op05_fingerprints.likeness(a, [])


def ring_brute(keys, shards, vnodes):
    """Sequential admission in ring order."""
    arcs = op06_ring.ring(shards, vnodes)
    starts = [a for a, _ in arcs]
    room = op06_ring.capacities(len(keys), shards, 0.0)
    place = lambda k: int(hashlib.md5(k.encode()).hexdigest()[:15], 16)
    arc = lambda p: (np.searchsorted(starts, p, side="right") - 1) % len(starts)
    out = []
    for k in sorted(keys, key=lambda k: (arc(place(k)), (place(k) - starts[arc(place(k))]) % (1 << 60))):
        at = arc(place(k))
        while not room[arcs[at % len(arcs)][1]]:
            at += 1
        s = arcs[at % len(arcs)][1]
        room[s] -= 1
        out.append((k, s))
    return out


def test_ring(spark, monkeypatch):
    monkeypatch.setattr(op06_ring, "CELL", 7)
    ids = list(range(0, 3000, 7))
    got = op06_ring.shard(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string"), 5, vnodes=8).collect()
    assert sorted((str(r.doc_id), r.shard) for r in got) == sorted(ring_brute([str(i) for i in ids], 5, 8))


def test_ring_rows(docs, rows, none):
    got = op06_ring.shard(docs, 16).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    n = Counter(r.shard for r in got)
    assert max(n.values()) - min(n[s] for s in range(16)) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    assert op06_ring.shard(none, 16).count() == 0


def test_ring_moves_little(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = {r.doc_id: r.shard for r in op06_ring.shard(d, 15, slack=0.2).collect()}
    b = {r.doc_id: r.shard for r in op06_ring.shard(d, 16, slack=0.2).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.35 * len(a)


@pytest.mark.parametrize("op,bad", [(op07_toxicity, "idiot"), (op08_quality, "%%%")])
def test_classifiers(spark, rows, docs, none, op, bad):
    rng = random.Random(4)
    made = [(1000 + i, words(rng, 40) if i % 3 else " ".join(w + (" " + bad if k % 4 == 0 else "") for k, w in enumerate(words(rng, 40).split())), int(i % 3 == 0)) for i in range(600)]
    flip = op is op08_quality
    d = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    train = spark.createDataFrame([(i, t, 1 - y if flip else y) for i, t, y in made if zlib.crc32(str(i).encode()) % 5], "doc_id long, text string, y int")
    model = op.fit(train)
    got = {r.doc_id: r for r in op.score(d, model).collect()}
    test = [(i, 1 - y if flip else y) for i, _, y in made if got[i].held_out]
    assert len(test) > 50 and np.mean([got[i].predicted == y for i, y in test]) > 0.95
    odd = op.score(docs, model).collect()
    assert Counter(r.doc_id for r in odd) == Counter(r[0] for r in rows) and all(0 <= r.score <= 1 for r in odd)
    assert op.score(none, model).count() == 0
    blank = op.fit(train.limit(0))
    assert {r.score for r in op.score(docs, blank).collect()} == {0.5}


def test_topk_large_components(spark):
    vecs = [(0, [3e6, 1.0]), (1, [1e6, 0.0]), (2, [2e6, 0.0]), (3, [4e6, 7.0]), (4, [-5e6, 1.0]), (5, [6e5, 0.0])]
    e = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in op01_topk.topk(e.where("vec_id = 0"), e, 5).orderBy("rank").collect()]
    assert got == [(i, 65536 * sum(int(a) * int(b) for a, b in zip(vecs[0][1], v, strict=True))) for i, v in (vecs[3], vecs[2], vecs[1], vecs[5], vecs[4])]
    with pytest.raises(ValueError, match="64 bits"):
        op01_topk.topk(e, e.unionByName(spark.createDataFrame([(9, [1e30, 0.0])], e.schema)), 5)


@pytest.mark.parametrize("short", [32, 2])
def test_quality_whole_words(short, monkeypatch):
    monkeypatch.setattr(op08_quality, "SHORT", short)
    rng = random.Random(6)
    made = ["".join(rng.choice("abc日é") for _ in range(n)) for n in (1, 3, 31, 32, 33, 254, 255, 256, 257, 900, 70_000)]
    made += [made[-2] + "xyz", "z"]
    pooler = op08_quality.Pooler(NO_CONTEXT)
    got = pooler.vectors(made)
    for w, v in zip(made, got, strict=True):
        b = b"^" + w.encode() + b"$"
        code = np.array([b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)], dtype=np.uint64)
        want = pooler.grams[(op08_quality.mixed(code) % np.uint64(op08_quality.GRAMS)).astype(int)].astype(float).sum(axis=0)
        assert np.allclose(v[: op08_quality.DIM], want / np.sqrt((want * want).sum()), atol=1e-6)
    assert not np.array_equal(*pooler.pool([made[-3], made[-2]])[:, : op08_quality.DIM])


def test_quality_pool(rows, monkeypatch):
    """Against a plain pool of each text, whole and in parts."""
    texts = [t or "" for _, t, *_ in rows] + ["long " * 50_000, "x" * 1_000_000, " ".join(f"v{k % 977}" for k in range(90_000))]
    context = op08_quality.contexts([t for t in texts if t] * 5)
    for part in (op08_quality.PART, 7):
        monkeypatch.setattr(op08_quality, "PART", part)
        pooler, want = op08_quality.Pooler(context), []
        some = texts if part > 7 else texts[:-3]
        for t in some:
            w = t.split()
            v = pooler.vectors(w).astype(float) if w else np.zeros((0, 96))
            if not w:
                want.append(np.zeros(195))
                continue
            alike = (v[1:, :64] * v[:-1, :64]).sum() / max(1, len(w) - 1)
            kinds = list(dict.fromkeys(w))
            want.append(np.r_[v.mean(axis=0), v[[w.index(k) for k in kinds]].mean(axis=0), alike, np.log1p(len(w)), len(kinds) / len(w)])
        assert np.allclose(np.vstack([pooler.pool(g) for g in op08_quality._grouped(some)]), np.array(want), atol=1e-4)


def test_quality_network():
    """The score is a plain forward pass; the temperature is the grid's best on the held-out fifth."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0).astype(float)
    net = op08_quality.Network(0.5)
    net.fit(x, y)

    def logit(r):
        z = [min(8.0, max(-8.0, (r[j] - net.mean[j]) / net.sd[j])) for j in range(6)]
        h = [np.tanh(sum(z[j] * net.w1[j][k] for j in range(6)) + net.b1[k]) for k in range(op08_quality.HIDDEN)]
        return sum(a * b for a, b in zip(h, net.w2, strict=True)) + net.b2[0]

    z = np.array([logit(r) for r in x])
    assert np.allclose(net.score(x), 1 / (1 + np.exp(-z / net.temperature)))
    held = np.random.default_rng(7).permutation(400)[:80]
    loss = lambda t: np.mean(np.log1p(np.exp(-np.where(y[held] == 1, 1, -1) * z[held] / t)))
    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.exp(np.linspace(-1.5, 3, 91)))
    assert np.mean((net.score(x) >= 0.5) == y) > 0.8


def test_ftrl_by_the_book():
    """Against FTRL-proximal written a coordinate at a time."""
    rng, o = random.Random(3), op07_toxicity
    made = [(sorted(rng.sample(range(50), 8)), rng.randrange(2)) for _ in range(120)]
    model, z, n = o.Ftrl(), {}, {}
    bias = 1 << o.BITS

    def weight(i):
        if i == bias:
            return -z.get(i, 0.0) * o.ALPHA / (o.BETA + n.get(i, 0.0) ** 0.5)
        if abs(z.get(i, 0.0)) <= o.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * o.L1) / ((o.BETA + n[i] ** 0.5) / o.ALPHA + o.L2)

    for at, y in made * 4:
        at = [*at, bias]
        model.learn(np.array(at), y)
        w = {i: weight(i) for i in at}
        g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (o.POSITIVE if y else 1.0)
        for i in at:
            m = n.get(i, 0.0) + g * g
            z[i] = z.get(i, 0.0) + g - (m**0.5 - n.get(i, 0.0) ** 0.5) / o.ALPHA * w[i]
            n[i] = m
    at, w = model.sparse()
    assert {int(i) for i in at} == {i for i in z if i == bias or abs(z[i]) > o.L1}
    assert all(abs(weight(int(i)) - x) < 1e-9 for i, x in zip(at, w, strict=True)) and 0 < len(at) < 50


def test_labelled_sample(spark):
    from quillon.llm.common import labelled_sample

    rng = random.Random(8)
    docs = [(i, f"text {i} " + "x" * rng.randrange(50)) for i in range(200)] + [(3, "another"), (5, None), (5, ""), (None, "no id")] + [(7, "again")] * 50
    labels = [(i, rng.randrange(2)) for i in range(0, 300, 2)] + [(i, None) for i in range(1, 40, 4)] + [(7, 0), (7, 1), (None, 1), (3, 1), (5, 0)] + [(i, 1) for i in range(5000, 5400)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    best = {}
    for i, v in labels:
        if i is not None and v is not None and zlib.crc32(str(i).encode()) % 5:
            best[i] = max(v, best.get(i, 0))
    everything = {(i, t or "", best[i]) for i, t in docs if i in best}
    got = [tuple(r) for r in labelled_sample(d, y, "toxic", 10_000).collect()]
    assert len(got) == len(set(got)) and set(got) == everything
    hashed = {r.i: r.h for r in spark.createDataFrame([(i,) for i in best], "i long").select("i", F.xxhash64("i").alias("h")).collect()}
    for rows, size in ((5, 1 << 20), (10_000, 300), (3, 40)):
        some = [tuple(r) for r in labelled_sample(d, y, "toxic", rows, size).collect()]
        assert set(some) <= everything and len(some) <= rows and sum(len(t.encode()) for _, t, _ in some) <= size
        top = sorted({i for i, *_ in some}, key=lambda i: hashed[i])
        assert top == sorted({i for i, *_ in everything}, key=lambda i: hashed[i])[: len(top)]
        if rows == 5:
            assert len(some) == 5


def passages_brute(rows):
    first, out = {}, Counter()
    body = lambda t: (t or "").encode()
    for i, t in sorted((r[0], r[1] or "") for r in rows if r[0] is not None):
        for p in range(len(body(t)) - 49):
            first.setdefault(body(t)[p : p + 50], i)
    for i, t, *_ in rows:
        b, c = body(t), bytearray(len(body(t)))
        if i is not None:
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < i:
                    c[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, c, strict=True) if not y)
        out[i, sum(c), sum(c[k] and not (k and c[k - 1]) for k in range(len(c))), kept] += 1
    return out


def test_suffix_order():
    rng = random.Random(8)
    for _ in range(600):
        s = [rng.randrange(rng.choice((1, 2, 4))) for _ in range(rng.randrange(50))]
        assert op09_suffix.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_orders_of_many_texts():
    rng = random.Random(1)
    for _ in range(200):
        texts = [[rng.randrange(rng.choice((1, 2, 4, 256))) for _ in range(rng.randrange(1, 60))] for _ in range(rng.randrange(1, 9))]
        got, at = op09_suffix.suffix_orders(np.array(sum(texts, [])), np.cumsum([len(t) for t in texts])), 0
        for t in texts:
            assert (got[at : at + len(t)] - at).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
            at += len(t)


@pytest.mark.parametrize("size,bucket,fan", [(2 << 20, 16 << 20, 4096), (400, 4000, 4096), (400, 4000, 3)])
def test_suffix_dedup(docs, rows, none, size, bucket, fan, monkeypatch):
    monkeypatch.setattr(op09_suffix, "GROUP_BYTES", size)
    monkeypatch.setattr(op09_suffix, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(op09_suffix, "FAN", fan)
    got = Counter((r.doc_id, r.dedup.n_removed, r.dedup.n_spans, bytes(r.dedup.kept)) for r in op09_suffix.dedup(docs).collect())
    assert got == passages_brute(rows)
    assert op09_suffix.dedup(none).count() == 0


def test_units_find_every_window():
    rng = random.Random(6)
    text = "".join(rng.choice("ab ") for _ in range(700)).encode()
    h, doc, first, last, _ = op09_suffix.units(np.frombuffer(text + text[100:300], np.uint8), np.array([700, 900]))
    covered = sorted(p for a, z in zip(first, last, strict=True) for p in range(a, z + 1))
    assert covered == [*range(651), *range(700, 851)]
    of = {}
    for u, a, z in zip(h, first, last, strict=True):
        for p in range(a, z + 1):
            of.setdefault((text + text[100:300])[p : p + 50], set()).add(int(u))
    assert all(len(v) == 1 for v in of.values())


def test_pack(docs, rows, none, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(op10_pack, "RANGE_TOKENS", 2000)
    paths = op10_pack.public_paths()
    t = Tokenizer.from_file(paths[0])
    got = op10_pack.pack(docs, paths, length=64).toPandas()
    ids = {}
    for i, x, *_ in rows:
        ids.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 0])
    assert got.length.sum() == sum(len(v) for x in ids.values() for v in x)
    for i, g in got.groupby("doc_id", dropna=False):
        texts = ids[None if pd.isna(i) else int(i)]
        want = {}
        for v in texts:
            for r in g.itertuples():
                if r.doc_tokens == len(v):
                    want[r.start, r.length, r.ids_crc32] = zlib.crc32(np.array(v[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 or want.get((r.start, r.length, r.ids_crc32), False)
        assert all(want.values()) and sum(g.length) == sum(map(len, texts))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.r_[0, np.cumsum(g.length)[:-1]]) and g.length.sum() <= 64
    full = got.groupby("sequence_id").length.sum()
    assert (full < 64).sum() <= 2 * (got.length.sum() // 2000 + 1)
    assert op10_pack.pack(none, paths).count() == 0


def test_hilbert_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        k = op10_pack.hilbert(grid, bits)
        assert sorted(k) == list(range(len(grid))) and (np.abs(np.diff(grid[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def test_special_tokens_and_spaces():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t, ids, rng = Tokenizer.from_file(P.path("byte_bpe_50k.json")), op10_pack.Ids(*op10_pack.public_paths()), random.Random(3)
    odd = ["x<|endoftext|>y", " a", "a ", "a  b", "a \nb", "　 a b", "a\x1c b"] + ["".join(rng.choice("ab \n\té日.'1 ") for _ in range(30)) for _ in range(400)]
    assert all(np.frombuffer(ids.encode(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids for x in odd)


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_topk", "op3_mix", "op4_jaccard"])
def test_sql(spark, name):
    from quillon.llm import registry

    con = duckdb.connect()
    for x in ("documents", "embeddings"):
        con.execute(f"create view {x} as select * from '{SF}/{x}.parquet'")
    con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in con.description]
    want = Counter(con.fetchall())
    assert Counter(tuple(r) for r in registry.queries()[name](spark, SF).select(*cols).collect()) == want


def test_pipeline(spark):
    """Each stage against a plain version of its decision."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    start, quality, unique, cut, mixed, packed = seen
    assert all(d.columns == start.columns for d in seen[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in quality.collect()}
    assert np.mean([(i in kept) == bool(y) for i, y in labels.items()]) > 0.9
    q = [(r.doc_id, r.text) for r in quality.collect()]
    assert {r.doc_id for r in unique.collect()} == {c for (_, c, _), _ in jaccard_brute(q).items()}
    u = [(r.doc_id, r.text) for r in unique.collect()]
    want = {i: k.decode("utf-8", "ignore") for (i, n, _, k) in passages_brute(u) if k or not n}
    assert {r.doc_id: r.text for r in cut.collect()} == want
    taken = {r.doc_id: r.taken for r in op03_mix.Mix(cut).taken().collect() if r.taken}
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += size_of(r.text)
    assert got == taken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op10_pack.public_paths()[0])
    assert packed.agg(F.sum("length")).first()[0] == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())


@pytest.fixture(scope="module")
def long_rows():
    """A megabyte of words, one of a single word, one of two-byte letters, and their copies."""
    rng = random.Random(21)
    prose = words(rng, 200_000, 50_000)
    one = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    return [(0, prose), (1, one), (2, "é" * 400_000), (3, prose[:500_000] + " z " + prose[500_000:]), (4, one), (5, None), (6, ""), (7, "short text")]


def test_long_texts(spark, long_rows):
    """Every operator takes a megabyte of words, and one without any space, whole."""
    import public_tokenizers as P

    d = spark.createDataFrame([(i, t, "en", "s" if i % 2 else "t", len(t or "")) for i, t in long_rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    body = {i: t or "" for i, t in long_rows}
    counts = {r.doc_id: r for r in op02_tokens.count_tokens(d, P.path(op02_tokens.MODEL)).collect()}
    assert {i: r.n_chars for i, r in counts.items()} == {i: len(t) for i, t in body.items()} and counts[1].n_tokens == counts[4].n_tokens > 100_000
    mix = op03_mix.Mix(d)
    taken = {r.doc_id: r for r in mix.taken().collect()}
    assert all(r["size"] == size_of(body[i]) and r.taken <= 3 * r["size"] for i, r in taken.items()) and taken[0].taken > 0
    assert sum(size_of(r.text) for r in mix.texts(d).collect()) == sum(r.taken for r in taken.values())
    linked = {r.doc_id: (r.class_id, r.links) for r in op04_jaccard.join(d).collect()}
    assert linked == {0: (0, 1), 3: (0, 1), 1: (1, 1), 4: (1, 1), 2: (2, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0)}
    prints = {r.doc_id: r for r in op05_fingerprints.fingerprints(d).collect()}
    assert all(r.n_chars == len(body[i]) for i, r in prints.items()) and prints[1].fingerprint == prints[4].fingerprint and prints[0].near_edited > 0.6
    assert {r.doc_id: r["size"] for r in op06_ring.shard(d, 16).collect()} == {i: len(t.encode()) + 1 for i, t in body.items()}
    train = spark.createDataFrame([(i, words(random.Random(i), 30) + (" bad" if i % 2 else ""), i % 2) for i in range(60)], "doc_id long, text string, y int")
    for op in (op07_toxicity, op08_quality):
        scores = {r.doc_id: r.score for r in op.score(d, op.fit(train)).collect()}
        assert set(scores) == set(body) and scores[1] == scores[4] and scores[5] == scores[6]
    left = {r.doc_id: r.dedup for r in op09_suffix.dedup(d).collect()}
    assert left[0].n_removed == 0 == left[1].n_removed and left[4].n_removed == 1_000_000 and left[4].kept == b""
    assert len(left[3].kept) < 200 and body[2].encode() == bytes(left[2].kept)
    pieces = op10_pack.pack(d, op10_pack.public_paths()).toPandas()
    ids = op10_pack.Ids(*op10_pack.public_paths())
    assert pieces.groupby("doc_id").length.sum().to_dict() == {i: len(ids.encode(t)) // 2 + 1 for i, t in body.items()}


def test_chunks_byte_by_byte():
    """The chunker against one that rolls over each byte."""
    o, rng = op05_fingerprints, random.Random(17)

    def plain(t):
        out, at = set(), 0
        import xxhash

        while at < len(t):
            cut = min(len(t), at + o.MOST)
            for k in range(at + o.LEAST, cut + 1):
                h = 0
                for q in range(o.WINDOW):  # bytes before the text count as zero bytes, whose gear is 0
                    byte = t[k - 1 - q] if k - 1 - q >= 0 else 0
                    h = (h + (int(o.GEAR[byte]) << q)) & 0xFFFFFFFF
                bits = o.STRICT if k < at + o.NORMAL else o.LOOSE
                if h >> (32 - bits) == 0:
                    cut = k
                    break
            out.add((xxhash.xxh64_intdigest(t[at:cut]) >> 16) << 8 | (cut - at))
            at = cut
        return sorted(out)

    texts = [words(rng, n).encode() for n in (0, 1, 5, 60, 300)] + ["日本語 ".encode() * 90, b"a" * 700, bytes(rng.randrange(256) for _ in range(1500))]
    assert o.chunk_sets(texts) == [plain(t) for t in texts]


@pytest.mark.parametrize("name", ["op2_tokens", "op5_fingerprints", "op6_ring", "op7_toxicity", "op8_quality", "op9_suffix", "op10_pack"])
def test_registered_queries(spark, name):
    """The queries without SQL, over a whole table: their columns, ids and what their contract fixes."""
    from quillon.llm import registry

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.queries()[name](spark, SF).toPandas()
    if name == "op10_pack":
        assert set(got.doc_id) == set(docs) and (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all() and (got.offset + got.length <= 1024).all()
        return
    assert sorted(got.doc_id) == sorted(docs)
    rows = {r.doc_id: r for r in got.itertuples()}
    if name in ("op7_toxicity", "op8_quality"):
        kind, least = ("toxic", 0.5) if name == "op7_toxicity" else ("quality", 0.3)
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= least) and 0 <= r.score <= 1 for i, r in rows.items())
        known = {r.doc_id: r[kind] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
        assert np.mean([rows[i].predicted == y for i, y in known.items() if i in rows]) > 0.9
    elif name == "op9_suffix":
        want = {i: (len(docs[i].encode()), n, spans, hashlib.sha256(kept).hexdigest()) for (i, n, spans, kept) in passages_brute(list(docs.items()))}
        assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows.items()} == want
    elif name == "op6_ring":
        assert all(r.size == len(docs[i].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[i].encode()) and r.law == "rows" for i, r in rows.items())
        n = Counter(got.shard)
        assert max(n.values()) - min(n[s] for s in range(16)) <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    else:
        assert all(r.n_chars == len(docs[i]) for i, r in rows.items())


def test_pipeline_stages_on_odd_rows(spark, docs, none):
    """Nulls, repeated rows, clashing names and empty tables pass through every stage."""
    import corpus_pipeline as cp

    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == docs.columns, name
        assert out.count() > 0
        assert stage(spark, none, SF).count() == 0, name
