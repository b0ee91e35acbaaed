"""Sharding against a brute-force version in plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import queries, sharding

DOCS = "doc_id long, text string, lang string"


def brute_place(x, n, key=sharding.KEY):
    """One number at a time, by the network's definition."""
    a = max(1, math.ceil(math.sqrt(n)))
    b = max(1, math.ceil(n / a))
    keys, state = [], key & (2 ** 31 - 1)
    for _ in range(sharding.ROUNDS):
        state = (state * 1103515245 + 12345) % 2 ** 31
        keys.append(state)
    while True:
        left, right = divmod(x, b)
        for i, k in enumerate(keys):
            h = left if i % 2 else right
            for times in sharding.MULTIPLY:
                h = ((h ^ k) * times) % 2 ** 31
                h ^= h >> 15
            left, right = ((left + h) % a, right) if i % 2 == 0 else (left, (right + h) % b)
        x = left * b + right
        if x < n:
            return x


def brute(rows, shards=24):
    """(doc_id, size, crc, shard, slot) of (doc_id, text) rows."""
    def mark(row):
        parts = ["-" if v is None else f"{len(str(v))}:{v}" for v in row]
        return hashlib.md5("".join(parts).encode()).digest()
    out = []
    for number, (i, t) in enumerate(sorted(rows, key=mark)):
        p = brute_place(number, len(rows))
        raw = (t or "").encode()
        out.append((i, len(raw) + 8, zlib.crc32(raw), p % shards, p // shards))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def check_law(rows, shards=24):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))


def test_query(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op12_feistel_shards(spark, small_dir)
    assert found.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = found.collect()
    check_law(rows)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert order((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows) == order(brute([tuple(r) for r in docs]))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 25, 1000, 9973])
def test_permutation(n):
    p = sharding.Permutation(n)
    places = p.place(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert p.row_at(places).tolist() == list(range(n))
    assert places[:50].tolist() == [brute_place(i, n) for i in range(min(n, 50))]


def test_permutation_of_many():
    p = sharding.Permutation(10 ** 12 + 39, key=5)
    rows = np.concatenate([np.arange(2000), 10 ** 12 + 38 - np.arange(2000)])
    places = p.place(rows)
    assert len(set(places.tolist())) == 4000 and 0 <= places.min() and places.max() <= 10 ** 12 + 38
    assert p.row_at(places).tolist() == rows.tolist()
    assert abs(places[:2000].mean() / 10 ** 12 - 0.5) < 0.03  # neighbours are spread
    shard, slot = sharding.located(10 ** 12 + 39, rows, key=5)
    assert (slot * 24 + shard == places).all()
    assert sharding.Permutation(10 ** 12 + 39, key=6).place(rows[:9]).tolist() != places[:9].tolist()


def test_odd_rows_do_not_depend_on_partitions(spark):
    rows = [(None, "x"), (None, None), (1, None), (1, ""), (2, "é" * 3), (2, "é" * 3), (3, "w " * 60_000), (4, "-"), (None, "x")]
    rows += [(5, "same")] * 40 + [(i, "same") for i in range(100, 140)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], DOCS)
    want = order(brute(rows))
    for n in (1, 7):
        found = sharding.sharded_documents(docs.repartition(n)).collect()
        check_law(found)
        assert order((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found) == want
    assert sharding.sharded_documents(docs.limit(0)).count() == 0


def test_more_copies_than_a_run(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 16)
    monkeypatch.setattr(sharding, "SALTS", 4)
    rows = [(1, "hot")] * 333 + [(2, "twin")] * 16 + [(3, "more")] * 17 + [(i, "one") for i in range(10, 60)]
    found = sharding.sharded_documents(spark.createDataFrame([(*r, "en") for r in rows], DOCS)).collect()
    assert order((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found) == order(brute(rows))


def test_clashing_names_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "en") for i in range(100)], DOCS)
    docs = docs.withColumn("_slot", F.lit("mine")).withColumn("id", F.lit(1)).withColumn("row", F.lit(2)).withColumn("place", F.lit(3)).withColumn("count", F.array(F.lit(1)))
    out = sharding.shard_rows(docs, 7)
    assert out.columns == [*docs.columns, "_number", "_shard", "_slot_"]
    assert Counter(r["_slot"] for r in out.collect()) == {"mine": 100}
    sharding.write_shards(docs, str(tmp_path / "shards"), 7, pieces=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    key = lambda df: sorted((r.doc_id, r["_shard"], r["_slot_"]) for r in df.collect())
    assert key(back) == key(out)
    for f in (tmp_path / "shards").rglob("*.parquet"):
        slots = [r["_slot_"] for r in spark.read.parquet(str(f)).collect()]
        assert slots == sorted(slots)
