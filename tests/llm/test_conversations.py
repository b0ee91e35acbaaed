"""Conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import conversations as cv, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def brute_edits(rows):
    """Cheapest (cost, audit, repaired rows) by a search over (rows taken,
    roles so far as a state), least cost and then least audit first."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        if (at, state, audit) in seen:
            continue
        seen.add((at, state, audit))
        for role in ("user", "assistant"):
            if (state, role[0]) in legal and not audit.endswith("II"):
                heapq.heappush(heap, (cost + 2, audit + "I", at, legal[state, role[0]], (*out, (role, ""))))
        if at < len(rows):
            role, text, gone, late = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, out))
            if not gone:
                for new in ("user", "assistant"):
                    if (state, new[0]) in legal:
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", at + 1, legal[state, new[0]], (*out, (new, text))))
                if (state, role[:1]) in legal:
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, legal[state, role[:1]], (*out, (role, text))))


def brute(rows):
    out = []
    after = brute_damage(rows)
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        seen, marked, counts = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, _, role, text in mine:
            shown = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("b", "d") and fault != "", int(fault == "t")))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, left = brute_edits(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_conversation_repair(spark, small_dir)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert order(found.collect()) == order(brute(rows))


def test_random_conversations(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(300):
        turn = rng.randrange(3)
        for _ in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", "", None, "u", "Assistant"])
            text = rng.choice(["Yes.", "No", "Why? ", " ", "", None, "é!", "x ", f"t{rng.random()}."])
            rows.append((conv if conv else None, rng.choice([turn, turn, None]), role, text))
            turn += rng.choice([1, 1, 1, 0, 2])
    df = spark.createDataFrame(rows, SCHEMA)
    want = order(brute(rows))
    assert order(cv.repaired_conversations(df).collect()) == want
    assert order(cv.repaired_conversations(df.repartition(5)).collect()) == want


@pytest.mark.parametrize("common", [2, 3, 10 ** 9])
def test_grammar_gives_the_same_repairs(common, monkeypatch):
    rng = random.Random(common)
    sequences = [bytes(rng.choice([0, 1, 2, 1, 2, 1, 2, 3, 5, 6, 8]) for _ in range(rng.randrange(0, 12))) for _ in range(400)] + [b"", bytes([1] * 9), bytes([1, 2] * 5)]
    rules, short = cv.re_pair(sequences, common)
    assert (not rules) == (common > 10 ** 6)

    def grown(symbols):
        return b"".join(grown(rules[s - 9]) if s >= 9 else bytes([s]) for s in symbols)

    assert [grown(s) for s in short] == sequences
    monkeypatch.setattr(cv, "COMMON", common)
    monkeypatch.setattr(cv.re_pair, "__defaults__", (common,))
    names = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    for s, (cost, audit) in zip(sequences, cv.repaired(sequences)):
        rows = [(names.get(x % 4, ""), "t", x == 8, int(4 <= x < 8)) for x in s]
        assert (cost, audit) == brute_edits(rows)[:2]


def test_ropes():
    rng = random.Random(1)
    strings = ["".join(rng.choice("KD") for _ in range(rng.randrange(0, 200))) for _ in range(60)]
    strings += [s[:-1] + "R" for s in strings if s] + [s + "K" for s in strings]

    def rope(s):
        if len(s) < 4:
            return cv.Rope(s)
        cut = rng.randrange(1, len(s))
        return rope(s[:cut]) + rope(s[cut:])

    ropes = [rope(s) for s in strings]
    assert [str(r) for r in ropes] == strings
    for a, x in zip(strings, ropes):
        for b, y in zip(strings[::7], ropes[::7]):
            assert (x < y) == (a < b)


def test_long_empty_and_clashing(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"line {t}" + "." * (t % 5 > 0)) for t in range(5000)]
    rows += [(8, 1, "user", "w " * 100_000 + "."), (8, 2, "assistant", "ok.")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.conv_id: r for r in cv.repaired_conversations(df).collect()}
    small = {r[0]: r for r in brute([r for r in rows if r[0] == 8])}
    assert tuple(found[8]) == small[8]
    assert len(found[7].audit.replace("I", "")) == len(brute_damage(rows[:5000]))
    none = cv.repaired_conversations(df.limit(0))
    assert none.count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    lost = cv.repaired_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in lost] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    extra = df
    for name in ("digest", "copy", "part", "audit", "id", "initial", "fault"):
        extra = extra.withColumn(name, F.lit(1))
    assert order(cv.repaired_conversations(extra.where("conv_id = 8")).collect()) == order([found[8]])
