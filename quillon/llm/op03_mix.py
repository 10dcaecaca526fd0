"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, document after document, form one stream, which is
cut into blocks of ``block`` words (of fewer for a source of less than
``FINE * block`` words, so that small sources come near their targets too).  A
source's quota is a number of blocks, in the ratio of its target to its size.

Shards are drawn: each slot of each output shard draws a source, with the
quotas as weights, from a hash of its number, so a shard's counts of sources
are a multinomial draw and shards are independent.  Then, from the last shards
backwards, draws beyond a source's quota are taken back and given to sources
that are short of theirs; the totals are the quotas.  A source's slots are
numbered shard after shard from these counts.  Slot j takes block
``perm(j mod n)`` of the source's n blocks, under another permutation for each
pass ``j div n``, and slots meet blocks in a join by index.  As quotas are at
most ``cap`` times n, no block, and so no document, is used more than ``cap``
times.

The permutations are swap-or-not shuffles: each round pairs x with K - x (mod
n) and a hash bit of the pair says whether they swap; that is a bijection for
any n.  Hashes are congruences mod P = 2^31 - 1, all within 64 bits.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating; a target
stops at ``cap`` times the source's size and the excess is shared by weight
among the rest.  With r = cap * size / weight ascending, the stopped sources
are a prefix, so a window over the list of sources (as many rows as there are
sources) finds the level.

Prefix sums of words are in two steps (cells of about ``CELL`` documents, then
the cells of a source), so a hot source isn't one task's.  Windows over shards
have at most ``SHARDS`` rows for a source.  Joins that grow with the input are
asked to merge: Spark's estimate of a table that is generated from the small
list of sources would let it broadcast them.

Defined results: null texts have no words; documents without words take 0, and
mixed texts leave them out.  A null source is a source of its own, null ids and
repeated rows are documents of their own; rows that agree in id, source and
text are told apart by their other columns.  Texts of any length are cut into
blocks like others; a word isn't cut.  Ties in the stream's order (equal ids)
go by size.  All sizes 0: targets 0.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, rest_of, stored, table

WEIGHTS = (5, 2, 1)
BLOCK = 64
FINE = 256
CELL = 4096
PIECE = 4096
ROUNDS = 20
SHARD_SLOTS = 4096
SHARDS = 20_000
MOST_TASKS = 20_000
MOST_SOURCES = 100_000
P = (1 << 31) - 1
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def _keys(rounds: int) -> list[tuple[int, int, int]]:
    """(K, A, C) of each round, from a linear congruence."""
    x, out = 20240229, []
    for _ in range(rounds):
        row = []
        for _ in range(3):
            x = (x * 48271) % P
            row.append(x)
        out.append(tuple(row))
    return out


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def permuted(df: DataFrame, name: str, x: Column, n: Column, salt: Column, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with the place of ``x`` in a pseudo-random permutation of 0..n-1 chosen by ``salt`` (n < 2^62).

    A round is a column, so the rounds are compiled one after the other.
    """
    df = df.withColumn("_n", n).withColumn("_salt", salt).withColumn("_v", x.cast("long"))
    v, w, n, salt = (F.col(c) for c in ("_v", "_w", "_n", "_salt"))
    for k, a, c in _keys(rounds):
        df = df.withColumn("_w", F.pmod((_long(k) + salt * _long(a)) % _long(P) * _long(2) + salt - v, n))
        bit = F.shiftright((F.pmod(F.greatest(v, w) + salt * _long(7919), _long(P)) * _long(a) + _long(c)) % _long(P), 13).bitwiseAND(_long(1))
        df = df.withColumn("_v", F.when(bit == 1, w).otherwise(v)).drop("_w")
    return df.withColumnRenamed("_v", name).drop("_n", "_salt")


def drawn(t: Column) -> Column:
    """A hash of ``t``, from 0 to P - 1."""
    x = (t % _long(P) + F.floor(t / P).cast("long") * _long(48271) % _long(P)) % _long(P)
    for _, a, c in _keys(ROUNDS + 3)[ROUNDS:]:
        x = (x * _long(a) + _long(c)) % _long(P)
        x = x.bitwiseXOR(F.shiftright(x, 15)) % _long(P)
    return x


def sized(docs: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, source_size) -> with s (place in the list), weight and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("s") % len(weights) + 1).cast("int")).cast("long")
    d = sizes.withColumn("s", F.row_number().over(by_name) - 1).withColumn("weight", w)
    level = Window.orderBy(F.lit(cap) * F.col("source_size") / F.col("weight"), "s")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = (
        d.withColumn("i", F.row_number().over(level))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("all_w", F.sum("weight").over(every))
        .withColumn("cap_before", F.lit(cap) * (F.sum("source_size").over(level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size")))
        .withColumn("w_before", F.sum("weight").over(level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight"))
    )
    # Stopped: its cap is at most what the level would be with only the sources before it stopped.
    d = d.withColumn("stopped", F.lit(cap) * F.col("source_size") * (F.col("all_w") - F.col("w_before")) <= F.col("weight") * (F.col("total") - F.col("cap_before")))
    d = d.withColumn("rest", F.col("total") - F.lit(cap) * F.sum(F.when(F.col("stopped"), F.col("source_size")).otherwise(0)).over(every))
    d = d.withColumn("rest_w", F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(every))
    target = F.when(F.col("stopped"), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("rest")).cast("double") / F.greatest(F.col("rest_w"), F.lit(1)).cast("double"))
    return d.select("source", "source_size", "s", "weight", target.alias("target"))


class Mix:
    """The plan of a mix: documents with their place in the stream, shards and slots."""

    def __init__(self, docs: DataFrame, *, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, shard_slots: int = SHARD_SLOTS):
        self.cap, self._slots, spark = cap, None, docs.sparkSession
        # The ids, sources and sizes alone go through the plan.
        rows = stored(docs.select("doc_id", "source", sized(docs).alias("size"), F.xxhash64("text").alias("th"), rest_of(docs).alias("rest")), "mix")
        cells = max(1, rows.count() // CELL)
        by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
        by_source = by_source.withColumn("block", F.greatest(_long(1), F.least(_long(block), F.floor(F.col("source_size") / FINE).cast("long"))))
        by_source = by_source.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        by_source = by_source.withColumn("quota", F.least(F.round(ratio * F.col("blocks")).cast("long"), cap * F.col("blocks")))
        ends = F.sum("quota").over(Window.orderBy("s").rowsBetween(*_UPTO))
        self.sources = stored(by_source.withColumn("first", ends - F.col("quota")).withColumn("slots", F.sum("quota").over(Window.rowsBetween(*_ALL))), "mix-sources")
        many, total = self.sources.agg(F.count("*"), F.max("slots")).first()
        total = total or 0
        self.tasks = int(min(MOST_TASKS, total // (32 * PIECE) + 1))
        self.shards = stored(self._dealt(spark, total, max(1, min(SHARDS, total // shard_slots)), many), "mix-shards")
        spread = lambda c: F.pmod(F.pmod(F.col(c), F.lit(P)) * F.lit(48271) % F.lit(P), F.lit(cells))
        cell = F.coalesce(spread("doc_id"), spread("size"))
        sums = rows.withColumn("cell", cell).groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
        before = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(*_UPTO)) - F.col("cell_size")
        sums = sums.withColumn("before", before).select(F.col("source").alias("c_source"), F.col("cell").alias("c_cell"), "before")
        inside = F.sum("size").over(Window.partitionBy("source", "cell").orderBy("doc_id", "size", "th", "rest").rowsBetween(*_UPTO)) - F.col("size")
        copy = F.row_number().over(Window.partitionBy("source", "cell", "doc_id", "th").orderBy("rest"))
        named = self.sources.select(F.col("source").alias("s_source"), "s", "source_size", "target", "block", F.ceil(F.col("quota") / F.greatest("blocks", _long(1))).alias("passes"))
        self.docs = (
            rows.withColumn("cell", cell).withColumn("inside", inside).withColumn("copy", copy)
            .join(sums.hint("merge"), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cell") == F.col("c_cell")))
            .withColumn("start", F.col("before") + F.col("inside"))
            .join(named, F.col("source").eqNullSafe(F.col("s_source")))
            .select("doc_id", "source", "s", "size", "start", "source_size", "target", "th", "copy", F.col("block").alias("b"), "passes")
        )

    def _dealt(self, spark: SparkSession, total: int, shards: int, many: int) -> DataFrame:
        """shard, s, n (slots) and off (those of the source in shards before), with the source's blocks."""
        # A source's share of 0..P; cells of it make the look-up an equal join.
        lo, hi = (F.floor(x.cast("double") / F.col("slots") * P).cast("long") for x in (F.col("first"), F.col("first") + F.col("quota")))
        cell = max(1, P // (4 * max(1, many)))
        spans = self.sources.where(F.col("quota") > 0).select("s", "quota", lo.alias("lo"), hi.alias("hi")).where(F.col("hi") > F.col("lo"))
        spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
        spans = F.broadcast(spans) if many <= MOST_SOURCES else spans.hint("merge")  # 5 * many rows at most
        slots = spark.range(0, total, 1, self.tasks).select((F.col("id") % _long(shards)).alias("shard"), drawn(F.col("id")).alias("u"))
        slots = slots.withColumn("cell", F.floor(F.col("u") / cell)).join(spans, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        draws = slots.groupBy("shard", "s").agg(F.count("*").alias("drew"))
        wanted = self.sources.where(F.col("quota") > 0).select("s", "quota", "blocks")
        by_shard = Window.partitionBy("s").orderBy("shard").rowsBetween(*_BEFORE)
        room = F.col("quota") - F.coalesce(F.sum("drew").over(by_shard), _long(0))
        draws = stored(draws.join(wanted, "s").withColumn("n", F.greatest(_long(0), F.least("drew", room))).select("shard", "s", "drew", "n"), "mix-draws")
        # Slots taken back, shard after shard, and slots that sources are short of, laid beside each other.
        back = draws.groupBy("shard").agg(F.sum(F.col("drew") - F.col("n")).alias("f")).where(F.col("f") > 0)
        short = wanted.join(draws.groupBy("s").agg(F.sum("n").alias("n")), "s", "left").select("s", (F.col("quota") - F.coalesce("n", _long(0))).alias("f")).where(F.col("f") > 0)
        upto = lambda c: F.sum("f").over(Window.orderBy(c).rowsBetween(*_UPTO))
        points = back.select(upto("shard").alias("pos"), "shard", F.lit(None).cast("long").alias("s")).unionByName(short.select(upto("s").alias("pos"), F.lit(None).cast("long").alias("shard"), F.col("s").cast("long").alias("s")))
        order = Window.orderBy("pos", F.col("shard").asc_nulls_last())
        on = order.rowsBetween(0, Window.unboundedFollowing)
        given = points.select((F.col("pos") - F.coalesce(F.lag("pos").over(order), _long(0))).alias("n"), F.first("shard", True).over(on).alias("shard"), F.first("s", True).over(on).alias("s"))
        both = draws.select("shard", F.col("s").cast("long").alias("s"), "n").unionByName(given.select("shard", "s", "n")).where(F.col("n") > 0)
        dealt = both.groupBy("shard", "s").agg(F.sum("n").alias("n")).withColumn("off", F.coalesce(F.sum("n").over(by_shard), _long(0)))
        return dealt.join(wanted.select("s", "blocks"), "s").select("shard", "s", "n", "off", "blocks")

    def slots(self) -> DataFrame:
        """A row for each slot of the output: shard, s, slot (of the source), pass, block.

        It is written once: a filter that moves down through the rounds of a
        permutation would be copied in each of them.
        """
        if self._slots is None:
            self._slots = stored(self._mapped(), "mix-slots")
        return self._slots

    def _mapped(self) -> DataFrame:
        pieces = self.shards.withColumn("piece", F.explode(F.sequence(_long(0), F.floor((F.col("n") - 1) / PIECE)))).repartition(self.tasks, F.col("s"), F.col("shard"), F.col("piece"))
        j = F.explode(F.sequence(F.col("off") + F.col("piece") * PIECE, F.col("off") + F.least((F.col("piece") + 1) * PIECE, F.col("n")) - 1))
        d = pieces.select("shard", "s", "blocks", j.alias("slot")).withColumn("pass", F.floor(F.col("slot") / F.col("blocks")))
        d = permuted(d, "place", F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("s") * _long(self.cap + 1) + F.col("pass") + 1)
        return d.select("shard", "s", "slot", "pass", F.col("place").alias("block"))

    def pieces(self) -> DataFrame:
        """Which part of which block each document holds: s, start (the document's), passes, block, words."""
        b, start, end = F.col("b"), F.col("start"), F.col("start") + F.col("size")
        d = self.docs.where(F.col("size") > 0).select("s", "start", "size", "b", "passes", F.explode(F.sequence(F.floor(start / b), F.floor((end - 1) / b))).alias("block"))
        words = F.least((F.col("block") + 1) * b, end) - F.greatest(F.col("block") * b, start)
        return d.select("s", "start", "passes", "block", words.alias("words"))

    def taken(self) -> DataFrame:
        """The documents with the words that the mix takes from each, repeats counted, and the first and last shard that takes any."""
        uses = self.slots().groupBy("s", "block").agg(F.count("*").alias("uses"), F.min("shard").alias("lo"), F.max("shard").alias("hi"))
        words = self.pieces().join(uses.hint("merge"), ["s", "block"]).groupBy("s", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"), F.min("lo").alias("first_shard"), F.max("hi").alias("last_shard"))
        named = words.select(F.col("s").alias("t_s"), F.col("start").alias("t_start"), "taken", "first_shard", "last_shard")
        return self.docs.join(named.hint("merge"), (F.col("s") == F.col("t_s")) & (F.col("start") == F.col("t_start")) & (F.col("size") > 0), "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))

    def texts(self, docs: DataFrame) -> DataFrame:
        """The mixed documents: for each pass over its source, the taken words of a document as a row.

        ``docs`` are the documents that the mix was made of.  Words keep the
        white space before them; adjoining blocks join without a seam.  Of a
        document that is taken whole the text is as it was.
        """
        uses = self.slots().select("s", "block", "pass", F.lit(True).alias("used"))
        parts = self.pieces().withColumn("pass", F.explode(F.sequence(_long(0), F.col("passes") - 1))).join(uses.hint("merge"), ["s", "block", "pass"], "left")
        used = F.coalesce("used", F.lit(False))
        parts = parts.groupBy("s", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("block", used.alias("used")))).alias("flags"), F.sum(F.when(used, F.col("words")).otherwise(0)).alias("n")).where(F.col("n") > 0)
        parts = parts.withColumn("flags", F.transform("flags", lambda f: f["used"]))
        where = self.docs.where(F.col("size") > 0).join(parts.hint("merge"), ["s", "start"])
        plan = where.select(*[F.col(c).alias(f"_m_{c}") for c in ("doc_id", "source", "th", "copy", "size", "start", "b", "n", "flags")])
        rows = docs.select(*docs.columns, F.xxhash64("text").alias("_m_hash"), rest_of(docs).alias("_m_rest"))
        rows = rows.withColumn("_m_row", F.row_number().over(Window.partitionBy("doc_id", "source", "_m_hash").orderBy("_m_rest"))).drop("_m_rest")
        same = [F.col("doc_id").eqNullSafe(F.col("_m_doc_id")), F.col("source").eqNullSafe(F.col("_m_source")), F.col("_m_hash") == F.col("_m_th"), F.col("_m_row") == F.col("_m_copy")]
        out = rows.join(plan.hint("merge"), same[0] & same[1] & same[2] & same[3])
        words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
        start, b = F.col("_m_start"), F.col("_m_b")
        cut = F.array_join(F.filter(words, lambda w, i: F.get("_m_flags", (F.floor((start + i) / b) - F.floor(start / b)).cast("int"))), "")
        out = out.withColumn("_m_text", F.when(F.col("_m_n") == F.col("_m_size"), F.col("text")).otherwise(cut))
        new = {"text": F.col("_m_text"), "n_chars": F.length("_m_text").cast("long")}
        return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken", "first_shard", "last_shard")


def _oracle() -> str:
    def perm(x: str, n: str, salt: str) -> str:
        keys = ", ".join(f"{{'k': {k}::BIGINT, 'a': {a}::BIGINT, 'c': {c}::BIGINT, 'v': 0::BIGINT}}" for k, a, c in _keys(ROUNDS))
        w = f"(((r.k + ({salt}) * r.a) % {P} * 2 + ({salt}) - q.v) % ({n}) + ({n})) % ({n})"
        bit = f"((((greatest(q.v, {w}) + ({salt}) * 7919) % {P}) * r.a + r.c) % {P} >> 13) & 1"
        return f"list_reduce(list_prepend({{'k': 0::BIGINT, 'a': 0::BIGINT, 'c': 0::BIGINT, 'v': ({x})::BIGINT}}, [{keys}]), lambda q, r: {{'k': 0::BIGINT, 'a': 0::BIGINT, 'c': 0::BIGINT, 'v': CASE WHEN ({bit}) = 1 THEN ({w}) ELSE q.v END}}).v"

    def draw(t: str) -> str:
        x = f"(({t} % {P} + {t} // {P} * 48271 % {P}) % {P})"
        for _, a, c in _keys(ROUNDS + 3)[ROUNDS:]:
            x = f"(({x} * {a} + {c}) % {P})"
            x = f"(xor({x}, {x} >> 15) % {P})"
        return x

    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), n AS (SELECT greatest(1, count(*) // {CELL}) AS cells FROM d),
g AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS s FROM d GROUP BY source
), w AS (SELECT *, CASE s % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM g),
l AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_w,
    3 * (sum(source_size) OVER o - source_size) AS cap_before, sum(weight) OVER o - weight AS w_before
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, s ROWS UNBOUNDED PRECEDING)
), c AS (SELECT *, 3 * source_size * (all_w - w_before) <= weight * (total - cap_before) AS stopped FROM l),
t AS (
  SELECT source, source_size, s, greatest(1, least({BLOCK}, source_size // {FINE})) AS b, CASE WHEN stopped THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(weight * (total - 3 * sum(CASE WHEN stopped THEN source_size ELSE 0 END) OVER ()) AS DOUBLE) / CAST(greatest(sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER (), 1) AS DOUBLE) END AS target
  FROM c
), q AS (
  SELECT *, CAST(ceil(source_size / b) AS BIGINT) AS blocks,
    least(CAST(round((CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END) * ceil(source_size / b)) AS BIGINT), 3 * CAST(ceil(source_size / b) AS BIGINT)) AS quota FROM t
), o AS (
  SELECT *, CAST(sum(quota) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) - quota AS BIGINT) AS first, CAST(sum(quota) OVER () AS BIGINT) AS slots FROM q
), a AS MATERIALIZED (
  SELECT s, quota, blocks, CAST(floor(CAST(first AS DOUBLE) / slots * {P}) AS BIGINT) AS lo, CAST(floor(CAST(first + quota AS DOUBLE) / slots * {P}) AS BIGINT) AS hi FROM o WHERE quota > 0
), m AS (SELECT max(slots) AS slots, greatest(1, least({SHARDS}, max(slots) // {SHARD_SLOTS})) AS shards FROM o),
u AS MATERIALIZED (SELECT t % shards AS k, {draw("t")} AS u FROM (SELECT shards, unnest(range(slots)) AS t FROM m)),
r AS (SELECT k, s, count(*) AS drew FROM u JOIN a ON u >= lo AND u < hi GROUP BY k, s),
e AS MATERIALIZED (
  SELECT k, s, drew, greatest(0, least(drew, quota - (sum(drew) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING) - drew))) AS n FROM r JOIN a USING (s)
), f AS (SELECT k, sum(drew - n) AS f FROM e GROUP BY k HAVING sum(drew - n) > 0),
h AS (SELECT s, quota - coalesce(sum(n), 0) AS f FROM a LEFT JOIN e USING (s) GROUP BY s, quota HAVING quota - coalesce(sum(n), 0) > 0),
i AS (
  SELECT sum(f) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS pos, k, NULL::BIGINT AS s FROM f
  UNION ALL SELECT sum(f) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING), NULL, s FROM h
), x AS (
  SELECT pos - coalesce(lag(pos) OVER (ORDER BY pos, k NULLS LAST), 0) AS n,
    first_value(k IGNORE NULLS) OVER y AS k, first_value(s IGNORE NULLS) OVER y AS s
  FROM i WINDOW y AS (ORDER BY pos, k NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), z AS (SELECT k, s, sum(n) AS n FROM (SELECT k, s, n FROM e UNION ALL SELECT k, s, n FROM x) WHERE n > 0 GROUP BY k, s),
j AS (
  SELECT s, k, blocks, unnest(range(CAST(off AS BIGINT), CAST(off + n AS BIGINT))) AS j
  FROM (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING) - n AS off FROM z) JOIN a USING (s)
), v AS MATERIALIZED (
  SELECT s, {perm("j % blocks", "blocks", "s * 4 + j // blocks + 1")} AS block, count(*) AS uses, min(k) AS lo, max(k) AS hi FROM j GROUP BY 1, 2
), p AS MATERIALIZED (
  SELECT d.*, t.s, t.b, t.source_size, t.target, row_number() OVER () AS r,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY coalesce((doc_id % {P} + {P}) % {P} * 48271 % {P} % cells, size % {P} * 48271 % {P} % cells), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM d CROSS JOIN n JOIN t ON d.source IS NOT DISTINCT FROM t.source
), bl AS (SELECT r, s, b, start, size, unnest(range(start // b, (start + size - 1) // b + 1)) AS block FROM p WHERE size > 0),
k AS (
  SELECT r, sum((least((block + 1) * b, start + size) - greatest(block * b, start)) * uses) AS taken, min(lo) AS first_shard, max(hi) AS last_shard FROM bl JOIN v USING (s, block) GROUP BY r
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_shard, last_shard FROM p LEFT JOIN k USING (r)
"""


SQL = _oracle()
