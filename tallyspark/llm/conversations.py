"""Repair of conversation structure by grammar-compressed dynamic programming.

A conversation should read ``(s?(ua)+)?`` by its roles' initials.  Its rows
become symbols: the role's class (s, u, a or other) and whether the row is
sound, truncated or must go (blank, or role and text seen earlier).  Edits are
Keep (0), Rerole to user or assistant (2), Delete (3) and Insert of an empty
user or assistant row (2); a truncated row that stays costs 1 more.

Each symbol has a min-plus transfer matrix over the four states of the
pattern: least cost and least audit string of its edit, with the insertions
before it.  Audits are ropes (concatenations that share their parts).  Strings
of one cell end in an edit that takes a row, so none begins with another, and
the least string of a product is the least of the products' concatenations:
products keep ties right.

Re-Pair replaces the commonest adjacent pair of symbols over all different
sequences of a batch by a new symbol until no pair is common; each rule's
matrix is one product, made once bottom-up and shared by all conversations.  A
conversation is then a short row of matrices.

Work in Spark: rows are damaged, flagged and digested without their texts'
moving; the first of equal rows is found by a window over (conversation, role,
text digest), which a long conversation does not land in whole; the sequence
of each conversation (a byte a row) is repaired in a task; the texts then move
once, sorted by conversation behind their audit, and are hashed as a stream.
One conversation's audit and sequence must fit one string.

Defined cases: null roles and texts count as one space, null ids and turns as
one space in the damage key; rows with a null id form one conversation; null
turns come first; rows of equal turn are ordered by role, text digest and
copy.  A conversation without rows after damage has zeros, an empty audit and
the hash of the empty string.  Texts are used whole; repeated rows are
duplicates; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
END = (START, ASSISTANT)
ROLES = "sua-"
GONE = 8  # symbols 0-3: sound rows by role; 4-7: truncated; 8: blank or duplicate
COMMON = 3  # least uses of a pair that becomes a rule
BATCH = 1 << 14  # symbols of one grammar, but for a longer conversation
LEAF = 48  # ropes of at most so many letters are plain strings
REMEMBER = 1 << 16  # different sequences whose repair a task keeps

SPACE = r"[\x20\x09-\x0D]"


# --- ropes -------------------------------------------------------------------

_PRIME, _RADIX = (1 << 61) - 1, 1_000_003


class Rope:
    """A string as a shared tree: length, hash, and a leaf or two halves."""

    __slots__ = ("size", "hash", "power", "left", "right", "leaf")

    def __init__(self, leaf: str | None = None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.left, self.right, self.leaf = left, right, leaf
        if leaf is not None:
            self.size, h = len(leaf), 0
            for c in leaf:
                h = (h * _RADIX + ord(c)) % _PRIME
            self.hash, self.power = h, pow(_RADIX, self.size, _PRIME)
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * right.power + right.hash) % _PRIME
            self.power = left.power * right.power % _PRIME

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return other if not self.size else self
        if self.leaf is not None and other.leaf is not None and self.size + other.size <= LEAF:
            return Rope(self.leaf + other.leaf)
        return Rope(None, self, other)

    def __str__(self) -> str:
        parts, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.leaf is not None:
                parts.append(r.leaf)
            else:
                todo += [r.right, r.left]
        return "".join(parts)

    def __lt__(self, other: Rope) -> bool:
        """ASCII order; parts that both begin with are skipped by hash."""
        mine, others = [self], [other]
        while mine and others:
            a, b = mine.pop(), others.pop()
            if a.size == b.size and a.hash == b.hash:
                continue
            if a.leaf is not None and b.leaf is not None:
                n = min(a.size, b.size)
                if a.leaf[:n] != b.leaf[:n]:
                    return a.leaf < b.leaf
                if a.size > n:
                    mine.append(Rope(a.leaf[n:]))
                if b.size > n:
                    others.append(Rope(b.leaf[n:]))
            elif b.leaf is not None or (a.leaf is None and a.size >= b.size):
                mine += [a.right, a.left]
                others.append(b)
            else:
                mine.append(a)
                others += [b.right, b.left]
        return bool(others)


# --- transfer matrices ---------------------------------------------------------

Matrix = list  # [from][to]: (cost, rope) or None


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; among equal costs the ASCII-least audit."""
    out = []
    for row in a:
        new: list = [None] * 4
        for mid, first in enumerate(row):
            if first is None:
                continue
            for to, second in enumerate(b[mid]):
                if second is None:
                    continue
                cost, old = first[0] + second[0], new[to]
                if old is None or cost < old[0]:
                    new[to] = (cost, first[1] + second[1])
                elif cost == old[0]:
                    audit = first[1] + second[1]
                    if audit < old[1]:
                        new[to] = (cost, audit)
        out.append(new)
    return out


def _insertions() -> Matrix:
    """Cheapest runs of insertions from state to state."""
    out: Matrix = [[(0, Rope("")) if i == j else None for j in range(4)] for i in range(4)]
    for start in range(4):
        at, cost, audit = start, 0, ""
        while True:
            nxt = STEP.get(("u", at), STEP.get(("a", at)))
            cost, audit = cost + INSERT, audit + "I"
            if out[start][nxt] is not None:
                break
            out[start][nxt] = (cost, Rope(audit))
            at = nxt
    return out


def _symbol_matrix(symbol: int) -> Matrix:
    """One row's edits, each after the cheapest insertions."""
    edit: Matrix = [[None] * 4 for _ in range(4)]
    for state in range(4):
        edit[state][state] = (DELETE, Rope("D"))
        if symbol == GONE:
            continue
        late = TRUNCATED if symbol >= 4 else 0
        for role in "ua":
            if (to := STEP.get((role, state))) is not None:
                edit[state][to] = (REROLE + late, Rope("R"))
        if (to := STEP.get((ROLES[symbol % 4], state))) is not None:
            edit[state][to] = (KEEP + late, Rope("K"))
    return product(INSERTIONS, edit)


INSERTIONS = _insertions()
SYMBOLS = [_symbol_matrix(s) for s in range(9)]


# --- grammar -------------------------------------------------------------------

def re_pair(sequences: list[bytes], common: int = COMMON) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(rules, compressed sequences): rule i makes symbol 9 + i of two symbols."""
    flat = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int64), -1) for s in sequences]) if sequences else np.zeros(0, np.int64)
    rules: list[tuple[int, int]] = []
    while len(flat) > 1:
        left, right = flat[:-1], flat[1:]
        code = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)
        pairs, uses = np.unique(code[code >= 0], return_counts=True)
        if not len(pairs) or uses.max() < common:
            break
        best = int(pairs[uses.argmax()])
        a, b = best >> 32, best & 0xFFFFFFFF
        at = np.flatnonzero(code == best)
        if a == b:  # of overlapping pairs every second one
            run = np.cumsum(np.append(True, np.diff(at) > 1)) - 1
            first = at[np.append(True, np.diff(at) > 1)]
            at = at[(at - first[run]) % 2 == 0]
        flat[at] = 9 + len(rules)
        flat = np.delete(flat, at + 1)
        rules.append((a, b))
        if len(at) < common:
            break
    ends = np.flatnonzero(flat < 0)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    return rules, [flat[i:j].tolist() for i, j in zip(starts, ends)]


def repaired(sequences: list[bytes]) -> list[tuple[int, str]]:
    """(cost, audit) of the cheapest edits of each symbol sequence."""
    rules, short = re_pair(sequences)
    matrices = list(SYMBOLS)
    for a, b in rules:
        matrices.append(product(matrices[a], matrices[b]))
    out = []
    for symbols in short:
        state: Matrix = [[(0, Rope("")), None, None, None]]
        for s in symbols:
            state = product(state, matrices[s])
        state = product(state, INSERTIONS)
        best = None
        for end in END:
            cell = state[0][end]
            if cell is not None and (best is None or cell[0] < best[0] or (cell[0] == best[0] and cell[1] < best[1])):
                best = cell
        out.append((best[0], str(best[1])))
    return out


# --- rows in Spark -------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with ``copy`` (1 for an added repeat)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(fate != 0).select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
                                        text.alias("text"), F.explode(copies).alias("copy"))


ORDER = ("turn", "role", "digest", "copy")
_FACTS = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string")]


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row's values differ from the row's before (first: True)."""
    n = len(columns[0])
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = False
        for col in columns:
            values = col.to_pylist()
            out[1:] |= np.array([a != b for a, b in zip(values[1:], values[:-1])], bool)
    return out


class _Repairs:
    """Repairs of sequences in batches of one grammar, remembered in a task."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, str]] = {}

    def __call__(self, sequences: list[bytes]) -> list[tuple[int, str]]:
        new = [s for s in dict.fromkeys(sequences) if s not in self.known]
        if len(self.known) + len(new) > REMEMBER:
            self.known = {}
            new = list(dict.fromkeys(sequences))
        self.known.update(zip(new, repaired(new)))
        return [self.known[s] for s in sequences]


def _judged(batches, typ):
    """One row for each conversation of sorted rows (conv_id, turn, initial,
    fault): its facts, cost and audit."""
    repairs, waiting, symbols = _Repairs(), [], 0
    open_ = None  # conversation that is being read

    def close(c):
        faults = np.bincount(np.frombuffer(bytes(c["faults"]), np.uint8), minlength=4)
        initials = bytes(c["initials"]).decode("ascii")
        legal = sum(initials[i:i + 2] in ("su", "ua", "au") for i in range(len(initials) - 1))
        gaps = c["last"] - c["first"] + 1 - c["turns"] if c["turns"] else 0
        symbol = bytes(GONE if f in (1, 2) else ROLES.index(r) + 4 * (f == 3) for r, f in zip(initials, c["faults"]))
        return c["id"], gaps, int(faults[1]), int(faults[2]), int(faults[3]), max(len(initials) - 1, 0) - legal, symbol

    def flush(rows):
        costs = repairs([r[-1] for r in rows])
        table = [(*r[:-1], cost, audit) for r, (cost, audit) in zip(rows, costs)]
        cols = list(zip(*table))
        return pa.record_batch([pa.array(cols[0], typ)] + [pa.array(c, pa.int64()) for c in cols[1:7]] + [pa.array(cols[7], pa.string())],
                               names=["conv_id"] + [n for n, _ in _FACTS])

    for batch in batches:
        ids, turns, initials, faults = (batch.column(i).to_pylist() for i in range(4))
        heads = _changes([batch.column(0)])
        if open_ is not None and len(ids):
            heads[0] = ids[0] != open_["id"]
        for i, head in enumerate(heads):
            if head:
                if open_ is not None:
                    waiting.append(close(open_))
                    symbols += len(waiting[-1][-1])
                open_ = {"id": ids[i], "faults": bytearray(), "initials": bytearray(), "turns": 0, "first": None, "last": None}
                if symbols >= BATCH:
                    yield flush(waiting)
                    waiting, symbols = [], 0
            c, turn = open_, turns[i]
            c["faults"].append(faults[i])
            c["initials"] += initials[i].encode()
            if turn is not None and turn != c["last"]:
                c["turns"] += 1
                c["first"] = turn if c["first"] is None else c["first"]
                c["last"] = turn
    if open_ is not None:
        yield flush([*waiting, close(open_)])


def judged(rows: DataFrame, typ: T.DataType) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of
    the conversations of digested rows."""
    first = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"), "copy")) == 1
    initial = F.substring("role", 1, 1)
    marked = rows.select("conv_id", "turn", "role", "digest", "copy", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"),
                         F.when(F.col("blank"), 1).when(~first, 2).when(F.col("open"), 3).otherwise(0).alias("fault"))
    marked = marked.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "copy")
    schema = T.StructType([T.StructField("conv_id", typ), *(T.StructField(n, {"long": T.LongType(), "string": T.StringType()}[t]) for n, t in _FACTS)])
    arrow = _arrow(typ)
    return marked.select("conv_id", "turn", "initial", "fault").mapInArrow(lambda batches: _judged(batches, arrow), schema)


def _arrow(typ: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(typ)


class _Reader:
    """Applies an audit to rows that come one by one, hashing what is left."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.hash, self.lines = audit, 0, START, hashlib.sha256(), 0

    def _write(self, role: str, initial: str, text: str) -> None:
        self.hash.update(("\n" if self.lines else "").encode() + role.encode() + b":" + text.encode())
        self.lines, self.state = self.lines + 1, STEP[initial, self.state]

    def _own(self) -> tuple[str, str]:
        return ("assistant", "a") if self.state == USER else ("user", "u")

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._write(*self._own(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self._write(role, role[:1], text)
        elif edit == "R":
            self._write(*self._own(), text)

    def end(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def _hashed(batches, arrow, names):
    """Sorted headers and rows to one row for each conversation."""
    reader, header = None, None
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        done = []
        for i, audit in enumerate(cols["audit"]):
            if audit is not None:
                if reader is not None:
                    done.append((*header, reader.end()))
                header = [cols[n][i] for n in names[:-1]]
                reader = _Reader(audit)
            else:
                reader.row(cols["role"][i], cols["text"][i])
        if done:
            yield _facts_batch(done, arrow, names)
    if reader is not None:
        yield _facts_batch([(*header, reader.end())], arrow, names)


def _facts_batch(rows, arrow, names):
    cols = list(zip(*rows))
    kinds = [arrow, *({"long": pa.int64(), "string": pa.string()}[t] for _, t in _FACTS), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256): one row for each conversation of the table, after damage."""
    typ = conversations.schema["conv_id"].dataType
    rows = damaged(conversations)
    shown = F.regexp_replace("text", SPACE, "")
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "copy", (F.length(shown) == 0).alias("blank"),
                         (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("open"))
    facts = judged(narrow, typ)
    ids = conversations.select("conv_id").distinct()
    zero = {n: F.coalesce(n, F.lit(0 if t == "long" else "").cast(t)).alias(n) for n, t in _FACTS}
    facts = facts.withColumnRenamed("conv_id", "id")
    facts = ids.join(facts, F.col("conv_id").eqNullSafe(F.col("id")), "left").select("conv_id", *zero.values())
    heads = facts.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(conversations.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
                         F.lit(b"").alias("digest"), F.lit(0).alias("copy"), F.lit("").alias("text"), *[n for n, _ in _FACTS])
    body = rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), "copy", "text",
                       *[F.lit(None).cast(t).alias(n) for n, t in _FACTS])
    both = heads.union(body).repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), "part", F.asc_nulls_first("turn"), "role", "digest", "copy")
    names = ["conv_id", *[n for n, _ in _FACTS], "repaired_sha256"]
    schema = T.StructType([T.StructField("conv_id", typ), *(T.StructField(n, {"long": T.LongType(), "string": T.StringType()}[t]) for n, t in _FACTS),
                           T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(typ)
    return both.select("conv_id", "role", "text", *[n for n, _ in _FACTS]).mapInArrow(lambda batches: _hashed(batches, arrow, names), schema)
