"""Operator 3, benchmark decontamination by template canonicalisation.

Texts are cut into words (letters, digits and what is not ASCII), in scripts
without blanks (Chinese, Japanese, Thai, Lao, Khmer, Burmese) into characters.  Numbers
(also with points and commas inside), units after a number, and capitalised
words inside a sentence become typed placeholders; everything else counts in
lower case.  Every window of ``WINDOW`` such words with at least ``LITERALS``
plain ones is hashed.  A filter of 2**23 bits made from the benchmark's
windows, whatever their number, lets few document windows through; those are
joined with the benchmark's windows on their hash by Spark.

A match of a document and an item along one alignment is dropped if its
slots contradict each other (one value of the item stands for two values of
the document): a re-parameterised question replaces a value everywhere.  A
document is contaminated by an item if its windows cover at least
``COVERAGE`` of the item's words, or of the words that its windows can reach
where those are a third of the item or more; in that case they also cover
two windows' words, or all that can be reached.

Items of which the windows reach less (dense in numbers or names) take
windows of ``2 * WINDOW`` words with as many plain ones.  Where these too reach
less than a third, all windows of ``WINDOW`` words as they stand, in lower case,
are taken: such an item is found where it is copied, not where its values are
replaced.

Items of fewer than ``WINDOW`` words take their whole sequence as their
window, down to ``LITERALS`` words, a character of a script without blanks
counting as half a word; shorter ones cannot be told from chance
and match nothing.  Null or empty texts have no windows.  Equal rows give one
result; a null id is a value like others; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free, mix, powers, stream, table, text_slices

WINDOW = 6
LITERALS = 4
COVERAGE = 0.6
FILTER_BITS = 23

# Units of measure, lower case.
UNITS = """mg g kg t lb lbs oz mm cm m km mi mile miles inch inches ft foot feet yd yards ml l liter liters litre litres
gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years
meter meters metre metres gram grams kilogram kilograms kilometer kilometers mph kmh percent dollar dollars euro euros
cent cents pound pounds degrees celsius fahrenheit watt watts volt volts hz khz mhz ghz kb mb gb tb""".split()

# Code points: scripts written without blanks, and signs that are not letters.
ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x9FFF),
         (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
SIGNS = ((0x3000, 0x3004), (0x3008, 0x303F), (0x30FB, 0x30FB), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
STOPS = (0x3002, 0xFF01, 0xFF0E, 0xFF1A, 0xFF1F)

LITERAL, NUMBER, NAME, UNIT = range(4)
_LONG = 1 << 22  # bytes of a long text that are looked at together


class Templates:
    """Words of concatenated texts with their placeholder hashes."""

    def __init__(self) -> None:
        b = np.arange(256)
        self.alnum = (b >= 48) & (b <= 57) | (b >= 65) & (b <= 90) | (b >= 97) & (b <= 122) | (b >= 128)
        self.digit = (b >= 48) & (b <= 57)
        self.upper = (b >= 65) & (b <= 90)
        self.low = np.where(self.upper, b + 32, b).astype(np.uint8)
        self.ends = np.isin(b, np.frombuffer(b".!?:\n\"", np.uint8))
        self.value = stream(41, 256)
        self.place = stream(43, 2 * WINDOW)
        self.slot = stream(47, 4)
        self.up = self.down = np.zeros(0, np.uint64)
        self.units = np.zeros(0, np.uint64)
        text = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        self.units = np.sort(self.words(text, np.array([0, len(text)]))[0])

    def words(self, data: np.ndarray, offs: np.ndarray):
        """(hash, start, end, kind) of each word, the first word of each text and
        the end, the hash as it stands, and whether it is a character alone."""
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = powers(n + 1), powers(n + 1, pow(0x9E3779B97F4A7C15, -1, 2 ** 64))
        if not n:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none, none, np.zeros(len(offs), np.int64), none.astype(np.uint64), none.astype(bool)
        ink, low = self.alnum[data], self.low[data]
        after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        after[:-1], before[1:] = data[1:], data[:-1]
        # e2 80 .., e2 81 .. and c2 .. are dashes, quotes and signs, not letters; c3 80 to c3 9e are capitals
        for at in np.flatnonzero((data == 0xE2) & ((after == 0x80) | (after == 0x81))):
            ink[at:at + 3] = False
        sign = np.flatnonzero(data == 0xC2)
        ink[sign] = False
        ink[np.minimum(sign + 1, n - 1)] = False
        high = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        low[high] += 0x20
        wide, width, code = _wide(data)
        within = lambda ranges: np.any([(code >= a) & (code <= b) for a, b in ranges], axis=0)
        alone = within(ALONE) & ~within(SIGNS)
        for at in wide[within(SIGNS)]:
            ink[at:at + 3] = False
        digit = self.digit[data]
        number = wide[(code >= 0xFF10) & (code <= 0xFF19)]
        for j in range(3):
            digit[number + j] = True
        inner = ((data == 46) | (data == 44)) & self.digit[before] & self.digit[after]
        ink |= inner
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        full = offs[:-1] < offs[1:]
        first[offs[:-1][full]], last[offs[1:][full] - 1] = ink[offs[:-1][full]], ink[offs[1:][full] - 1]
        head, tail = wide[alone], (wide + width)[alone]
        first[head] = last[tail - 1] = True
        first[tail[tail < n]] = ink[tail[tail < n]]
        last[head[head > 0] - 1] = ink[head[head > 0] - 1]
        single = np.zeros(n, bool)
        single[head] = True
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[low] * self.up[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * self.down[start])
        count = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        digits = count(digit | inner)
        kind = np.where(digits[end] - digits[start] == end - start, NUMBER, LITERAL)
        capital = self.upper[data[start]] | (data[start] == 0xC3) & high[np.minimum(start + 1, n - 1)]
        caps = count(self.upper[data] | high)
        ends = self.ends[data]
        ends[wide[np.isin(code, STOPS)]] = True
        stops = count(ends)
        at = np.searchsorted(start, offs)
        gap = np.concatenate([[0], end[:-1]]) if len(start) else start
        begins = np.zeros(len(start), bool)
        begins[at[:-1][at[:-1] < len(start)]] = True
        begins |= stops[start] > stops[gap]
        kind[(kind == LITERAL) & capital & ~begins & (caps[end] - caps[start] == 1)] = NAME
        if len(self.units) and len(h):
            unit = np.isin(h, self.units) & (kind != NUMBER)
            unit[1:] &= (kind[:-1] == NUMBER) & (end[:-1] + 2 > start[1:])
            unit[0] = False
            kind[unit] = UNIT
        return np.where(kind == LITERAL, h, self.slot[kind]), start, end, kind, at, h, single[start]

    def windows(self, h, kind, at, size: int = WINDOW, raw: bool = False):
        """(hash, first word) of the windows of ``size`` words inside one text
        with enough plain words; ``raw`` are words as they stand, of any kind."""
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = h[:n] * self.place[0]
        for j in range(1, size):
            out += h[j:n + j] * self.place[j]
        plain = np.concatenate([[0], np.cumsum(kind == LITERAL)])
        text = np.searchsorted(at, np.arange(len(h)), "right")
        ok = (text[:n] == text[size - 1:]) & (raw | (plain[size:] - plain[:n] >= LITERALS))
        first = np.flatnonzero(ok)
        return mix(out[first] + np.uint64(size + 64 * raw)), first


def _wide(data: np.ndarray):
    """(place, bytes, code point) of the characters of three or four bytes."""
    at = np.flatnonzero(data >= 0xE0)
    width = np.where(data[at] >= 0xF0, 4, 3)
    at, width = at[at + width <= len(data)], width[at + width <= len(data)]
    code = data[at].astype(np.int64) & np.where(width == 4, 0x07, 0x0F)
    for j in (1, 2, 3):
        code = np.where(j < width, code << 6 | data[np.minimum(at + j, len(data) - 1)] & 0x3F, code)
    return at, width, code


def _pieces(col):
    """Slices of texts; a long text in pieces that overlap by a few KB, cut at blanks, or characters where there are none."""
    for i, j, data, offs in text_slices(col):
        if j - i > 1 or len(data) <= _LONG:
            yield i, data, offs, 0
            continue
        at = 0
        while at < len(data):
            end = min(len(data), at + _LONG)
            yield i, data[at:end], np.array([0, end - at]), at
            if end == len(data):
                break
            back = np.flatnonzero(data[end - 4096:end] == 32)
            if not len(back):
                back = np.flatnonzero(data[end - 4096:end] & 0xC0 != 0x80)
            at = end - 4096 + int(back[0]) if len(back) else end


def _reach(templates: Templates, h, kind, at, most: int) -> np.ndarray:
    """How many words of each text lie in windows of ``most`` words, or of the whole text where it has fewer."""
    n, steps = np.diff(at), np.zeros(len(h) + 1, np.int64)
    for size in range(LITERALS, most + 1):
        first = templates.windows(h, kind, at, size)[1]
        first = first[np.minimum(n, most)[np.searchsorted(at, first, "right") - 1] == size]
        np.add.at(steps, first, 1)
        np.add.at(steps, first + size, -1)
    return np.diff(np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])[at])


def _windows(items: bool, sizes: list[tuple[int, bool]], bits=None):
    """Windows of documents, or of items: those that the item is matched by."""
    schema = "key long, id long, h long, at int, n int, reach int, size int, raw boolean, slots array<string>"

    def run(batches):
        templates = Templates()
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cols = ([], [], [], [], [], [], [], [], [])
            for row, data, offs, moved in _pieces(batch.column(2)):
                h, start, end, kind, at, plain, single = templates.words(data, offs)
                n = np.diff(at)
                if items:
                    chars = np.concatenate([[0], np.cumsum(single)])
                    enough = 2 * n - np.diff(chars[at]) >= 2 * LITERALS
                    reach, wide = (_reach(templates, h, kind, at, most) for most in (WINDOW, 2 * WINDOW))
                    copied = 3 * np.maximum(reach, wide) < n
                    own_size = np.minimum(n, np.where((3 * reach >= n) | copied, WINDOW, 2 * WINDOW))
                    reach = np.where(copied, n, np.where(3 * reach >= n, reach, wide))
                for size, raw in sizes:
                    got, first = templates.windows(plain if raw else h, kind, at, size, raw)
                    if bits is not None:
                        x = (got & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                        hit = (bits.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1
                        got, first = got[hit], first[hit]
                    text = np.searchsorted(at, first, "right") - 1
                    if items:
                        own = enough[text] & (copied[text] == raw) & (own_size[text] == size)
                        got, first, text = got[own], first[own], text[own]
                    for w, f, t in zip(got.view(np.int64).tolist(), first.tolist(), text.tolist()):
                        slots = [] if raw else [bytes(data[start[p]:end[p]]).decode("utf-8", "replace").lower() for p in range(f, f + size) if kind[p] != LITERAL]
                        reaches = int(reach[t] if items else n[t])
                        for c, v in zip(cols, (keys[row + t], ids[row + t], w, f - int(at[t]) + moved, int(n[t]), reaches, size, raw, slots)):
                            c.append(v)
            if cols[0]:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "id", "h", "at", "n", "reach", "size", "raw", "slots"])

    return run, schema


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """Names a row by its id and text: equal rows have one fate."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(key, doc_id, item_id, n_windows, coverage, exact): a row for each
    document and item that it contains, key by :func:`row_key`; coverage of
    the words that the item's windows reach; exact if no slot differs."""
    spark = docs.sparkSession
    sizes = [(size, raw) for size in range(LITERALS, 2 * WINDOW + 1) for raw in (False, True)]
    run, schema = _windows(True, sizes)
    items = benchmark.select(F.xxhash64(F.col(item_col).cast("long"), F.col(item_text_col)), F.col(item_col).cast("long"), F.col(item_text_col))
    items = table(items.mapInArrow(run, schema).select(F.col("key").alias("item"), F.col("id").alias("item_id"), "h", F.col("at").alias("item_at"), "n", "reach", "size", "raw", F.col("slots").alias("item_slots")), "template-items")
    low = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = (items.select(F.shiftright(low, 3).cast("int").alias("i"), F.expr("shiftleft(1, cast(h & 7 as int))").alias("b"))
            .groupBy("i").agg(F.bit_or("b").alias("b")).toArrow())
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    bits[rows.column("i").to_numpy()] = rows.column("b").to_numpy()
    # sizes but WINDOW, and words as they stand, only where items have them
    held = items.select("size", "raw").distinct().collect()
    run, schema = _windows(False, sorted({*((r["size"], r["raw"]) for r in held), (WINDOW, False)}), spark.sparkContext.broadcast(bits))
    seen = docs.select(row_key(id_col, text_col), F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
    seen = seen.select("key", F.col("id").alias("doc_id"), "h", "at", "slots")
    hits = seen.join(items, "h").select("key", "doc_id", "item", "item_id", "n", "reach", "size", "item_at", (F.col("at") - F.col("item_at")).alias("line"), "slots", "item_slots")
    hits = table(hits, "template-hits")

    values = hits.select("key", "item", "line", F.explode(F.arrays_zip("item_slots", "slots")).alias("v")).distinct()
    wrong = values.groupBy("key", "item", "line", F.col("v.item_slots").alias("value")).agg(F.count("*").alias("n")).where("n > 1")
    wrong = wrong.select("key", "item", "line").distinct()
    good = hits.join(wrong, ["key", "item", "line"], "left_anti")
    found = (good.groupBy("key", "item", "n", "reach", "size").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"),
                                                  F.collect_set("item_at").alias("ats"), F.min(F.expr("slots <=> item_slots")).alias("exact"))
             .withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform("ats", lambda x: F.sequence(x, x + F.col("size") - 1)))))))
    whole = F.col("covered") >= coverage * F.col("n")
    reached = (F.col("covered") >= coverage * F.col("reach")) & (F.col("covered") >= F.least("reach", F.lit(2 * WINDOW)))
    return found.where(whole | reached).select(
        "key", "doc_id", "item_id", F.size("ats").alias("n_windows"), (F.col("covered") / F.col("reach")).alias("coverage"), "exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that contain a benchmark item."""
    name = free(docs, "_bad")
    bad = table(matches(docs, benchmark, id_col, text_col).select(F.col("key").alias(name)).distinct(), "template-bad")
    return docs.join(bad, row_key(id_col, text_col) == F.col(name), "left_anti")
