"""Quality by random-indexing word vectors and a two-layer network.

Random indexing gives every word a vector without a matrix to factor: the sum
of fixed sparse random vectors, here of its letter trigrams (so unseen words
have one too), and, for the words that are frequent in the fitting sample, the
sum of those of the words around it.  A document's vectors are pooled: their
mean over its words, their mean over its distinct words, how alike neighbours
are, how many words there are and how many of them differ.  A network of two
layers in numpy turns the standardised pool into a logit, and a temperature
fitted on documents that the network didn't see calibrates its probability.

The fit takes at most ``ROWS`` labelled documents and ``SAMPLE_BYTES`` of text
(those of the least id hashes; see ``labelled_sample``) in one task; scoring
takes every document, whole.  Neither lang, source, id nor labels are inputs of
a score.

Defined results: null and empty texts have the pool of no words (zeros).  Texts
and words of any length count whole: a long text is pooled in parts, holding its
different words alone, and a long word's trigrams are summed in steps.  Equal
texts have equal scores.  Without labels, or with labels of one kind, scores are
the share of label 1 among them (0.5 if there are none).  Each row of the table
gives one row.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, mixed, ready, spread, table

ROWS = 8_000
GRAMS, DIM, CONTEXT = 4096, 64, 32
FREQUENT, AROUND = 20_000, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 64, 3e-3, 1e-4
PART = 40_000
GROUP_CHARS = 1 << 18
SHORT = 32


def _ternary(rows: int, dim: int, salt: int, nonzero: int = 8) -> np.ndarray:
    """Sparse random vectors: ``nonzero`` entries of +1 or -1 a row (fewer where they meet)."""
    h = mixed(spread(rows * nonzero) + np.uint64(salt)).reshape(rows, nonzero)
    out = np.zeros((rows, dim), np.float32)
    for k in range(nonzero):
        np.add.at(out, (np.arange(rows), (h[:, k] % np.uint64(dim)).astype(int)), np.where(h[:, k] >> np.uint64(63), 1.0, -1.0))
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)


#: The frequent words and a vector for each.
Context = tuple[list[str], np.ndarray]


class Pooler:
    """Texts to pooled vectors, under the context vectors of frequent words.

    Words are looked up in parts of at most ``PART`` words: a part's different
    words get a row each in a small matrix, and nothing is kept afterwards.
    """

    def __init__(self, context: Context):
        self.grams = _ternary(GRAMS, DIM, 1)
        self.at = {w: i for i, w in enumerate(context[0])}
        self.context = np.vstack([context[1].reshape(-1, CONTEXT), np.zeros((1, CONTEXT), np.float32)])

    def vectors(self, words: list[str]) -> np.ndarray:
        """Unit sums of the words' letter trigrams, beside their context vectors."""
        parts = [w.encode() for w in words]
        data = np.frombuffer(b"^" + b"$^".join(parts) + b"$", dtype=np.uint8)
        n = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))  # as many trigrams as bytes
        first = np.cumsum(n + 2) - n - 2
        order = np.argsort(-n, kind="stable")
        n, first = n[order], first[order]
        sums = np.zeros((len(parts), DIM), np.float32)  # whole numbers
        codes = np.zeros(len(data), np.int16)
        for i in range(0, len(data) - 2, 1 << 16):
            d = data[i : i + (1 << 16) + 2].astype(np.uint64)
            codes[i : i + len(d) - 2] = mixed((d[:-2] << np.uint64(16)) | (d[1:-1] << np.uint64(8)) | d[2:]) % np.uint64(GRAMS)
        for k in range(min(SHORT, int(n.max(initial=0)))):
            m = int(np.searchsorted(-n, -k))  # the words of more than k trigrams
            sums[:m] += self.grams[codes[first[:m] + k]]
        for r in range(int(np.searchsorted(-n, -SHORT))):
            for i in range(SHORT, int(n[r]), 1 << 14):
                sums[r] += self.grams[codes[first[r] + i : first[r] + min(i + (1 << 14), n[r])]].sum(axis=0)
        out = np.zeros((len(parts), DIM + CONTEXT), np.float32)
        out[order, :DIM] = _unit(sums)
        get, none = self.at.get, len(self.at)
        out[:, DIM:] = self.context[np.fromiter((get(w, none) for w in words), dtype=np.int64, count=len(words))]
        return out

    def _looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        at = dict.fromkeys(words)
        for i, w in enumerate(at):
            at[w] = i
        kinds = list(at)
        return np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words)), self.vectors(kinds), kinds

    def _many(self, split: list[list[str]]) -> np.ndarray:
        """Texts that make one part together."""
        ids, v, _ = self._looked_up([w for s in split for w in s])
        rows, alike = v[ids], np.zeros(0)
        if len(ids):
            alike = np.einsum("ij,ij->i", rows[1:, :DIM], rows[:-1, :DIM])
        out, a = np.zeros((len(split), 2 * (DIM + CONTEXT) + 3), np.float32), 0
        for i, s in enumerate(split):
            if s:
                z = a + len(s)
                u = np.unique(ids[a:z])
                out[i] = np.r_[rows[a:z].sum(axis=0) / len(s), v[u].sum(axis=0) / len(u), alike[a : z - 1].sum() / max(1, len(s) - 1), np.log1p(len(s)), len(u) / len(s)]
                a = z
        return out

    def _one(self, text: str) -> np.ndarray:
        """A text of more than a part: parts add up; its different words alone are held."""
        n, alike, seen, previous = 0, 0.0, set(), None
        total, distinct = np.zeros(DIM + CONTEXT), np.zeros(DIM + CONTEXT)
        for part in _parts(text):
            ids, v, kinds = self._looked_up(part)
            rows = v[ids]
            n, total = n + len(part), total + rows.sum(axis=0)
            alike += float(np.einsum("ij,ij->", rows[1:, :DIM], rows[:-1, :DIM]))
            if previous is not None:
                alike += float(rows[0, :DIM] @ previous)
            previous = rows[-1, :DIM].copy()
            distinct += v[[w not in seen for w in kinds]].sum(axis=0)
            seen.update(kinds)
        if not n:
            return np.zeros(2 * (DIM + CONTEXT) + 3, np.float32)
        return np.r_[total / n, distinct / len(seen), alike / max(1, n - 1), np.log1p(n), len(seen) / n].astype(np.float32)

    def pool(self, texts: list[str]) -> np.ndarray:
        out, held, size = [], [], 0
        for t in texts:
            if len(t) > 2 * PART:  # at most PART words otherwise
                out += [self._many(held), self._one(t)[None]]
                held, size = [], 0
                continue
            s = t.split()
            if size + len(s) > PART:
                out.append(self._many(held))
                held, size = [], 0
            held.append(s)
            size += len(s)
        return np.vstack([*out, self._many(held)])


def _parts(text: str) -> Iterator[list[str]]:
    """The words of a text, ``PART`` of them at a time."""
    held: list[str] = []
    for m in re.finditer(r"\S+", text):
        held.append(m[0])
        if len(held) == PART:
            yield held
            held = []
    if held:
        yield held


def _grouped(texts: Iterable[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def contexts(texts: list[str]) -> Context:
    """Random-indexing context vectors of the most frequent words."""
    from collections import Counter

    import xxhash

    counts: Counter = Counter()
    for t in texts:
        counts.update(t.split())
    words = [w for w, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT] if c >= 5]
    del counts
    at = {w: i for i, w in enumerate(words)}
    index = _ternary(1 << 14, CONTEXT, 2, 4)
    rows = np.array([xxhash.xxh64_intdigest(w) & ((1 << 14) - 1) for w in words], dtype=np.int64)
    own = np.vstack([index[rows].reshape(-1, CONTEXT), np.zeros((1, CONTEXT), np.float32)])
    sums = np.zeros((len(words) + 1, CONTEXT), np.float32)
    for t in texts:
        ids = np.array([at.get(w, len(words)) for w in t.split()], dtype=np.int64)
        v = own[ids]
        for k in range(1, AROUND + 1):
            np.add.at(sums, ids[k:], v[:-k])
            np.add.at(sums, ids[:-k], v[k:])
    return words, _unit(sums[:-1])


class Network:
    """Two layers; ``fit`` trains them and the temperature."""

    def __init__(self, prior: float):
        self.prior, self.ready = prior, False

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(7)
        order = rng.permutation(len(x))
        cut = max(1, len(x) // 5)
        held, own = order[:cut], order[cut:]
        if len(np.unique(y[own])) < 2:
            return
        self.mean, self.sd = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
        x = np.clip((x - self.mean) / self.sd, -8, 8)
        d = x.shape[1]
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        params = ["w1", "b1", "w2", "b2"]
        m = {p: 0.0 for p in params}
        v = {p: 0.0 for p in params}
        step = 0
        for epoch in range(EPOCHS):
            rng.shuffle(own)
            for i in range(0, len(own), BATCH):
                at = own[i : i + BATCH]
                h = self._hidden(x[at])
                g = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -35, 35))) - y[at]) / len(at)
                back = np.outer(g, self.w2) * (1 - h * h)
                grads = {"w1": x[at].T @ back + DECAY * self.w1, "b1": back.sum(axis=0), "w2": h.T @ g + DECAY * self.w2, "b2": np.array([g.sum()])}
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for p in params:
                    m[p] = 0.9 * m[p] + 0.1 * grads[p]
                    v[p] = 0.999 * v[p] + 0.001 * grads[p] ** 2
                    setattr(self, p, getattr(self, p) - rate * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.999**step)) + 1e-8))
        z = self._hidden(x[held]) @ self.w2 + self.b2
        grid = np.exp(np.linspace(-1.5, 3, 91))
        loss = [np.mean(np.logaddexp(0, z / t) - y[held] * z / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        self.ready = True

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.prior)
        z = self._hidden(np.clip((x - self.mean) / self.sd, -8, 8)) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -35, 35)))


#: What a score needs.
Model = tuple[Context, Network]


def fit(sample: DataFrame) -> Model:
    """Context vectors and network from (doc_id, text, y)."""
    ready(sample.sparkSession)

    def run(batches):
        texts, y = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
        if not texts:
            return
        context, y = contexts(texts), np.array(y, dtype=float)
        pooler = Pooler(context)
        x = np.vstack([pooler.pool(g) for g in _grouped(texts)])
        net = Network(float(y.mean()))
        net.fit(x.astype(float), y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((context, net))], pa.binary())], ["model"])

    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "y")
    got = one.mapInArrow(run, "model binary").collect()  # at most FREQUENT vectors and one network
    return pickle.loads(got[0].model) if got else (([], np.zeros((0, CONTEXT), np.float32)), Network(0.5))


def _scores(sent) -> Callable[[pa.Array], np.ndarray]:
    """Texts of a batch to scores, a group of texts at a time."""
    context, net = sent.value
    pooler = Pooler(context)

    def scored(texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(net.score(pooler.pool(g)) for g in _grouped(t.as_py() or "" for t in texts))])

    return scored


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = ready(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        scored = _scores(sent)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scored(b.column(2)), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text reaches the threshold."""
    sent = ready(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        scored = _scores(sent)
        for b in batches:
            yield b.filter(pa.array(scored(b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", ROWS)))
