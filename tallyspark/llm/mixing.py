"""Operator 1, mixing sources to target weights (DataFrame functions only).

*Weights.*  Source shares ``p`` of the words become ``p**a`` normalised.  The
exponent ``a`` in [0, 1] is found by repeated sectioning: the largest one, so
the least change of the corpus, whose mix has at least ``target`` times the
largest possible entropy; but never so small that a source would be read more
than ``max_repeats`` times.  Every step is one aggregate over the table of
sources, of any size, for 16 exponents at once.

*Realisation.*  The budget is the corpus's own number of words (or given);
a source's part is the rounded ``weight * budget``.  Its documents lie in
blocks by a keyed hash, at most 4096 a source.  An epoch is a permutation of
the blocks by a hash of epoch and block.  Full epochs take every block; the
last one takes blocks in order while they fit, and of the block that does not
fit the documents in hash order while they fit.  Running sums are over blocks
of one source and epoch, or documents of one block: never a whole source.

Null sources are a source of their own.  Documents without words cost
nothing and come with their block; a source without words has weight 0 and
is left out.  Repeated rows count each.  The hash is that of id and text, so
rows that share an id or have none spread over the blocks.  Texts are counted
whole; an empty table gives an empty mix.  All columns pass through; result
columns whose name the input has get a trailing underscore.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free, table

TARGET = 0.97
MAX_REPEATS = 4.0
BLOCK_WORDS = 100_000
MAX_BLOCKS = 4096
SEED = "mix"
STEPS = 1 << 20  # the exponent is a multiple of 1 / STEPS


def words(text: Column) -> Column:
    """Number of runs of characters that are not in \\x20\\x09-\\x0D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def exponent(sources: DataFrame, target: float, max_repeats: float, budget: int | None) -> float:
    """The exponent for the table (source, tokens), tokens > 0."""
    head = sources.agg(F.count("*"), F.sum("tokens")).first()
    if not head[0]:
        return 1.0
    goal, total = target * math.log(head[0]) - 1e-12, head[1]
    wanted = budget or total

    def fits(ks: list[int]) -> dict[int, tuple[bool, bool]]:
        """For exponents k / STEPS: entropy reaches the goal; repetition is within its limit."""
        a = F.explode(F.array(*map(F.lit, ks)))
        rows = sources.select(F.log(F.col("tokens") / F.lit(float(total))).alias("l"), F.col("tokens"), a.alias("k"))
        rows = rows.withColumn("e", F.col("k") / F.lit(float(STEPS)) * F.col("l"))
        got = rows.groupBy("k").agg(F.sum(F.exp("e")).alias("z"), F.sum(F.exp("e") * F.col("e")).alias("s"),
                                    F.max(F.exp("e") / F.col("tokens")).alias("r")).collect()
        return {g.k: (math.log(g.z) - g.s / g.z >= goal, g.r * wanted / g.z <= max_repeats + 1e-9) for g in got}

    def search(which: int, rising: bool) -> int:
        """rising False: the largest k for which the test holds (it holds up to some k).
        rising True: the smallest k for which it holds (it holds from some k on)."""
        lo, hi = 0, STEPS
        while hi > lo:
            step = max(1, (hi - lo) // 16)
            ks = sorted({*range(lo, hi, step), hi})
            ok = fits(ks)
            good = [k for k in ks if ok[k][which]]
            if rising:
                first = min(good, default=hi)
                below = [k for k in ks if k < first]
                lo, hi = (below[-1] + 1 if below else first), first
            else:
                last = max(good, default=lo)
                above = [k for k in ks if k > last]
                lo, hi = last, (above[0] - 1 if above else last)
        return lo

    return max(search(0, False), search(1, True)) / STEPS


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        target: float = TARGET, max_repeats: float = MAX_REPEATS, budget: int | None = None,
        block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """``docs`` with _words, _epoch, _block, _rank (of the block in its epoch), a
    row for each time that the mix reads a document."""
    out_names = [free(docs, c) for c in ("_words", "_epoch", "_block", "_rank")]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text_col, F.lit(""))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"),
                      words(F.col(text_col)).alias("n"), _hash(F.lit(seed), *key).alias("h"))
    narrow = table(own.select("source", "n", "h"), "mix-docs")

    sources = table(narrow.groupBy("source").agg(F.sum("n").alias("tokens")).where("tokens > 0"), "mix-sources")
    a = exponent(sources, target, max_repeats, budget)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    power = F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(total or 1))))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    plan = (sources.withColumn("part", F.round(power / F.lit(z) * F.lit(float(budget or total))).cast("long"))
            .select(F.col("source").alias("of"), "tokens", F.expr("part div tokens").alias("full"), F.expr("part % tokens").alias("rest"),
                    F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / F.lit(block_words))).cast("long").alias("blocks")))
    plan = table(plan, "mix-plan")

    placed = (narrow.join(plan, F.col("source").eqNullSafe(F.col("of")))
              .select("of", "n", "h", "full", "rest", F.expr("h % blocks").alias("block")))
    blocks = placed.groupBy("of", "block").agg(F.sum("n").alias("n"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    turns = blocks.withColumn("epoch", F.explode(F.expr("sequence(1L, full + 1)")))
    order = Window.partitionBy("of", "epoch").orderBy(_hash(F.lit(seed), F.col("epoch").cast("string"), F.col("block").cast("string")), "block")
    turns = (turns.withColumn("rank", F.row_number().over(order)).withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("room", F.when(F.col("epoch") <= F.col("full"), F.col("n")).otherwise(F.least("n", F.col("rest") - F.col("upto") + F.col("n"))))
             .where("epoch <= full or room > 0"))
    turns = table(turns.select("of", "block", "epoch", "rank", "room", (F.col("room") < F.col("n")).alias("cut")), "mix-turns")

    # the block that does not fit: the last hash whose documents still fit
    part = turns.where("cut").select(F.col("of").alias("of2"), F.col("block").alias("block2"), "room")
    inside = placed.join(part, F.col("of").eqNullSafe(F.col("of2")) & (F.col("block") == F.col("block2")))
    inside = inside.withColumn("sum", F.sum("n").over(Window.partitionBy("of", "block").orderBy("h"))).where("sum <= room")
    last = inside.groupBy("of", "block").agg(F.max("h").alias("last"))
    last = last.select(F.col("of").alias("of2"), F.col("block").alias("block2"), "last")
    turns = turns.join(last, F.col("cut") & F.col("of").eqNullSafe(F.col("of2")) & (F.col("block") == F.col("block2")), "left")
    turns = turns.where("not cut or last is not null").select("of", "block", "epoch", F.col("rank").cast("long").alias("rank"), "last")
    turns = turns.groupBy("of", "block").agg(F.collect_list(F.struct("epoch", "rank", "last")).alias("turns"))  # at most max_repeats + 1
    turns = table(turns.select("of", F.col("block").alias("of_block"), "turns"), "mix-blocks")

    sized = plan.select(F.col("of").alias("sized"), "blocks")
    out = (own.join(sized, F.col("source").eqNullSafe(F.col("sized"))).withColumn("block", F.expr("h % blocks"))
           .join(turns, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
           .withColumn("turn", F.explode("turns")).where("turn.last is null or h <= turn.last"))
    found = (F.col("n"), F.col("turn.epoch"), F.col("block"), F.col("turn.rank"))
    return out.select("row.*", *[c.alias(name) for c, name in zip(found, out_names)])


ORACLE = f"""
WITH RECURSIVE own AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM own GROUP BY source HAVING sum(n) > 0),
head AS (SELECT count(*) AS c, CAST(sum(tokens) AS DOUBLE) AS total FROM sources),
entropy AS (  -- bisection: the largest k / {STEPS} whose entropy reaches the goal
  SELECT 0 AS lo, {STEPS} AS hi
  UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid - 1 END FROM (
    SELECT lo, hi, (lo + hi + 1) // 2 AS mid,
      (SELECT ln(sum(exp(e))) - sum(exp(e) * e) / sum(exp(e)) FROM (SELECT ((lo + hi + 1) // 2) / {STEPS}.0 * ln(tokens / total) AS e FROM sources, head))
        >= (SELECT {TARGET} * ln(c) - 1e-12 FROM head) AS ok
    FROM entropy WHERE lo < hi)),
repeats AS (  -- bisection: the smallest k / {STEPS} within the repetition limit
  SELECT 0 AS lo, {STEPS} AS hi
  UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT lo, hi, (lo + hi) // 2 AS mid,
      (SELECT max(exp(e) / tokens) * max(total) / sum(exp(e)) FROM (SELECT tokens, total, ((lo + hi) // 2) / {STEPS}.0 * ln(tokens / total) AS e FROM sources, head))
        <= {MAX_REPEATS} + 1e-9 AS ok
    FROM repeats WHERE lo < hi)),
a AS (SELECT greatest((SELECT max(lo) FROM entropy WHERE lo = hi), (SELECT max(lo) FROM repeats WHERE lo = hi)) / {STEPS}.0 AS a),
powers AS (SELECT source, tokens, exp(a * ln(tokens / total)) AS p, total FROM sources, head, a),
parts AS (SELECT source, tokens, CAST(round(p / (SELECT sum(p) FROM powers) * total) AS BIGINT) AS part,
            least({MAX_BLOCKS}, CAST(ceil(tokens / {BLOCK_WORDS}) AS BIGINT)) AS blocks FROM powers),
placed AS (SELECT o.*, p.tokens, p.part // p.tokens AS "full", p.part % p.tokens AS rest, o.h % p.blocks AS block
           FROM own o JOIN parts p ON o.source IS NOT DISTINCT FROM p.source),
blocks AS (SELECT source, block, sum(n) AS n, max("full") AS "full", max(rest) AS rest FROM placed GROUP BY source, block),
turns AS (
  SELECT *, row_number() OVER w AS rank, sum(n) OVER w AS upto FROM (SELECT *, unnest(range(1, CAST("full" AS BIGINT) + 2)) AS epoch FROM blocks)
  WINDOW w AS (PARTITION BY source, epoch ORDER BY CAST('0x' || substr(md5('{SEED}:' || epoch || ':' || block), 1, 15) AS BIGINT), block ROWS UNBOUNDED PRECEDING)),
rooms AS (SELECT *, CASE WHEN epoch <= "full" THEN n ELSE least(n, rest - upto + n) END AS room FROM turns),
used AS (SELECT * FROM rooms WHERE epoch <= "full" OR room > 0),
sums AS (SELECT doc_id, source, h, n, block, sum(n) OVER (PARTITION BY source, block ORDER BY h) AS upto FROM placed)
SELECT s.doc_id, s.source, s.n AS n_words, CAST(u.epoch AS BIGINT) AS epoch, CAST(s.block AS BIGINT) AS block, CAST(u.rank AS BIGINT) AS block_rank
FROM sums s JOIN used u ON s.source IS NOT DISTINCT FROM u.source AND s.block = u.block
WHERE u.room = u.n OR s.upto <= u.room
"""
