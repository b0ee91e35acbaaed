"""Shards of a reproducible shuffle, by a Feistel permutation of row numbers.

Every row gets a global number 0 .. n-1: its rank by a digest (MD5) of its
columns.  The number thus depends on the rows alone, not on files, partitions
or retries; rows equal in every column have consecutive numbers.  A keyed
permutation of 0 .. n-1 gives the row's place p in the shuffle; the shard is
p mod shards and the slot p div shards, so shard sizes differ by one row at
most (law ``rows``) and slots have no gaps.

The permutation is a Feistel network on pairs (left, right) with left below a
and right below b, where a = ceil(sqrt(n)) and b = ceil(n / a): each round
adds a keyed hash of one half to the other, modulo its size.  A value of a * b
that is not below n walks the cycle on until it is.  So ``place`` and its
inverse ``row_at`` are computed from (n, key) alone, without a table.

Numbers come from narrow rows: digests are counted, ranked within 2^14 cells
of the digest, and the cells' offsets added.  The rows themselves are shuffled
once, by digest, after equal rows have met within each task.  Copies are made
up again in runs of at most 4096, and more common rows are spread by run.

Defined cases: nulls in any column have a digest of their own; empty and long
texts are digested whole; repeated rows each get a slot of their own; an empty
table gives an empty one.  Groups of equal texts are dealt like other rows.
Extra columns are part of the digest and pass through; result columns whose
name the input has get a trailing underscore.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free

SHARDS, KEY, ROUNDS = 24, 20_240, 8
RUN, SALTS = 4096, 64
#: Leading bytes of the digest that choose its cell: 256^2 / 4 cells.
CELL_BYTES, CELL_DIVISOR = 2, 4
#: Odd multipliers of the round function; values stay below 2^31, products below 2^62.
MULTIPLY = (1_540_483_477, 1_181_783_497)
LOW31 = (1 << 31) - 1


def round_keys(key: int, rounds: int = ROUNDS) -> list[int]:
    """A fixed 31-bit number for each round, by a linear congruence."""
    out, state = [], key & LOW31
    for _ in range(rounds):
        state = (state * 1_103_515_245 + 12_345) & LOW31
        out.append(state)
    return out


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed hash of 0 .. 2^31 - 1 to the same range."""
    for times in MULTIPLY:
        x = ((x ^ key) * times) & LOW31
        x = x ^ (x >> 15)
    return x


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0 .. n-1 (n at most 2^60)."""

    n: int
    key: int = KEY
    rounds: int = ROUNDS

    @property
    def sides(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(self.n - 1, 0)) + 1)
        return a, max(1, -(-self.n // a))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = self.sides
        left, right = x // b, x % b
        steps = list(enumerate(round_keys(self.key, self.rounds)))
        for i, k in reversed(steps) if back else steps:
            if i % 2 == 0:
                left = (left - _mixed(right, k) if back else left + _mixed(right, k)) % a
            else:
                right = (right - _mixed(left, k) if back else right + _mixed(left, k)) % b
        return left * b + right

    def _walk(self, x, back: bool) -> np.ndarray:
        out = np.array(x, np.int64)
        todo = np.arange(len(out))
        while len(todo):
            out[todo] = self._once(out[todo], back)
            todo = todo[out[todo] >= self.n]
        return out

    def place(self, rows) -> np.ndarray:
        """The places of row numbers."""
        return self._walk(rows, False)

    def row_at(self, places) -> np.ndarray:
        """The row numbers at places: the inverse of ``place``."""
        return self._walk(places, True)


def located(n: int, rows, shards: int = SHARDS, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers of a table of n rows."""
    places = Permutation(n, key).place(rows)
    return places % shards, places // shards


def digest(columns: list[str]) -> Column:
    """MD5 over the columns' texts, each with its length; nulls apart."""
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.unhex(F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])))


def _numbered(digests: DataFrame) -> DataFrame:
    """(id, count, first): copies of each digest and the least row number."""
    counts = digests.groupBy("id").agg(F.count(F.lit(1)).alias("count"))
    lead = F.conv(F.hex(F.substring("id", 1, CELL_BYTES)), 16, 10).cast("int")
    counts = counts.withColumn("cell", F.floor(lead / CELL_DIVISOR))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^14 cells
    cells = counts.groupBy("cell").agg(F.sum("count").alias("size"))
    cells = cells.select("cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("cell").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("first", F.sum("count").over(within) - F.col("count"))
    return counts.join(cells, "cell").select("id", "count", (F.col("first") + F.col("offset")).alias("first"))


def _runs(numbers: DataFrame, permutation: Permutation) -> DataFrame:
    """(id, run, number, place): a row for each copy, run by run."""

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(permutation.place(rows.to_numpy()))

    starts = numbers.select("id", "count", "first", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / RUN))).alias("run"))
    upto = F.least(F.col("count") - F.col("run") * RUN, F.lit(RUN)) - 1
    copies = starts.select("id", "run", (F.col("first") + F.col("run") * RUN).alias("from"), upto.alias("upto"))
    copies = copies.select("id", "run", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("upto"))).alias("number"))
    return copies.select("id", "run", "number", place("number").alias("place"))


def shard_rows(df: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """Every row with ``_number`` (its global number), ``_shard`` and ``_slot``."""
    names = [free(df, c) for c in ("_number", "_shard", "_slot")]
    keyed = df.select(digest(df.columns).alias("id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    digests = df.select(digest(df.columns).alias("id"))
    numbers = _numbered(digests)
    permutation = Permutation(digests.count(), key)
    rows = keyed.groupBy("id").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("count"))
    usual = rows.where(F.col("count") <= RUN).join(_runs(numbers.where(F.col("count") <= RUN), permutation), "id")
    salted = rows.where(F.col("count") > RUN).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = _runs(numbers.where(F.col("count") > RUN), permutation).withColumn("salt", (F.col("run") % SALTS).cast("int"))
    common = salted.repartition("id", "salt").join(spread.repartition("id", "salt"), ["id", "salt"])
    out = usual.select("row", "number", "place").union(common.select("row", "number", "place"))
    return out.select("row.*", F.col("number").alias(names[0]), (F.col("place") % shards).cast("int").alias(names[1]),
                      F.floor(F.col("place") / shards).alias(names[2]))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, key: int = KEY, pieces: int = 1) -> None:
    """Parquet folders ``_shard=0`` .. of the rows in slot order; ``pieces``
    files a shard, each a run of slots (more for larger tables)."""
    out = shard_rows(df, shards, key)
    shard, slot = out.columns[-2:]
    per = -(-df.count() // (shards * pieces)) or 1
    piece = F.floor(F.col(slot) / per)
    out = out.repartition(shards * pieces, shard, piece).sortWithinPartitions(shard, slot)
    out.write.partitionBy(shard).parquet(path)


def sharded_documents(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, number)."""
    placed = shard_rows(docs.select("doc_id", "text"), shards, key)
    text = F.coalesce("text", F.lit(""))
    return placed.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
                         F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), F.col("_number").alias("number"))
