"""Operator 4, n-gram Jaccard join by a token-group matrix.

Two documents link when ``100 * |A & B| >= 75 * |A | B|`` over their sets of
distinct five-word shingles (64-bit hashes).  The steps, all over whole texts:

1. *Sets.*  One pass hashes each text's set; equal sets are one class.  The
   pass also counts shingles that several classes of a task share.  The most
   shared ones (as many as fit a measured 2**21 entries) are ordered last;
   any order keeps the join exact, this one keeps common passages out of the
   prefixes.
2. *Prefixes.*  In that order two linked sets share a token among the first
   ``q - ceil(0.75 q) + 1`` of each.  Tokens that one class alone has go: most
   before any row is shuffled, by a bit filter of the tokens that two classes
   have (tasks send sorted hashes of a few bits more than their number needs,
   coded by their differences), the rest after it, exactly.
3. *Groups.*  Each token names two leads among its classes, those with the
   fewest tokens that are not common, so the likely centres of near copies.
   A class is compared exactly with the leads that it shares most with, if
   the prefixes allow a link.  What is linked in this way is a
   group, kept in blocks of about 32 classes so that no group is ever whole
   in one row.  Pairs inside a group are never listed: it is connected.
4. *Matrix.*  Rows (token, block) of the blocks' prefix tokens.  A query
   class meets the blocks of other groups with which it shares a token that
   comes early in both.  Its prefix tokens that the block has are counted;
   the block's complete knowledge up to its smallest prefix end bounds how
   many of the query's tokens it can still share.  Blocks over the bound get their
   whole token union, the exact query-union overlap is bounded again, and
   only qualifying blocks are opened: their members are compared exactly.
5. *Components* over the verified links.

Class ids and tokens are 64-bit hashes: two different sets share an id with
probability n**2 / 2**65.  Rows with a null id take part in the links and get
the smallest id of their component (null if it has none); a null text is
empty; repeated rows are copies; a text without words has ``n_shingles`` 0
and is alone.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, Shingler, free, mix, text_slices
from .components import components

FLUSH = 2_000_000   # tokens that a task holds before it counts them
COMMON = 1 << 21    # most tokens that are ordered last (16 MB)
MAP_BITS = 26       # size of the class filter: 2**26 bits, 8 MB
BLOCK = 32          # classes in a block, about
HASH_MORE = 6       # bits of a token's hash beyond those of the tokens' number
FILTER_BITS = 28    # size of the token filter: at most 2**28 bits, 32 MB
GRID = 15           # steps of a prefix profile


def _class_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _needed(n, num: int, den: int):
    return -(-n * num // den)


def _sets(k: int):
    schema = "kind int, doc_id long, n long, c long, cnt long, t long"

    def run(batches):
        shingles, seen, held, size = Shingler(k), set(), [], 0

        def shared():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts > 1].view(np.int64), counts[counts > 1]
            n = len(tokens)
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), none, none, pa.array(tokens), pa.array(counts), none], ["kind", "doc_id", "n", "c", "cnt", "t"])

        for batch in batches:
            ns, cs = [], []
            for _, _, data, offs in text_slices(batch.column(1)):
                for tokens in shingles(data, offs):
                    ns.append(len(tokens))
                    c = _class_id(tokens) if len(tokens) else None
                    cs.append(c)
                    if c is not None and c not in seen:
                        seen.add(c)
                        held.append(tokens)
                        size += len(tokens)
                if size > FLUSH:
                    yield shared()
                    held, size = [], 0
            n = len(ns)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(cs, pa.int64()), pa.nulls(n, pa.int64()), batch.column(2)], ["kind", "doc_id", "n", "c", "cnt", "t"])
        if held:
            yield shared()

    return run, schema


def _keys(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Signed sort keys of a set's tokens, common ones last."""
    keys = (tokens >> np.uint64(1)).view(np.int64)
    if len(common):
        at = np.searchsorted(common, tokens)
        at[at == len(common)] = 0
        keys = np.where(common[at] == tokens, keys, keys - np.int64(2 ** 62) - np.int64(2 ** 62))
    else:
        keys = keys - np.int64(2 ** 62) - np.int64(2 ** 62)
    keys.sort()
    return keys


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of ``bits`` bits of sort keys."""
    return mix(keys.view(np.uint64)) >> np.uint64(64 - bits)


def coded(values: np.ndarray) -> bytes:
    """Sorted numbers as their differences, seven bits a byte."""
    steps = np.diff(values, prepend=values.dtype.type(0)).astype(np.uint64)
    width = np.ones(len(steps), np.int64)
    for i in range(1, 10):
        width += steps >= np.uint64(1 << 7 * i)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(width.max(initial=0))):
        has = width > i
        more = (width[has] > i + 1).astype(np.uint8) << 7
        out[ends[has] - width[has] + i] = (steps[has] >> np.uint64(7 * i)).astype(np.uint8) & 127 | more
    return out.tobytes()


def decoded(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    first = np.append(0, np.flatnonzero(raw < 128)[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first), dtype=np.uint64)


def _prefix_of(tokens: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    n = len(tokens)
    return _keys(tokens, common), n - _needed(n, 75, 100) + 1


def _hashes(k: int, common, bits: int, cell_bits: int):
    """Each task's prefix tokens, hashed: those of one class, those of more."""
    schema = "cell int, ones binary, many binary"

    def run(batches):
        shingles, seen, held, size, last = Shingler(k), set(), [], 0, common.value

        def sent():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(values, np.arange((1 << cell_bits) + 1, dtype=np.uint64) << np.uint64(bits - cell_bits))
            rows = [(c, values[i:j], counts[i:j]) for c, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if i < j]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in rows], pa.int32()), pa.array([coded(v[n == 1]) for _, v, n in rows], pa.binary()),
                                               pa.array([coded(v[n > 1]) for _, v, n in rows], pa.binary())], ["cell", "ones", "many"])

        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0)):
                for tokens in shingles(data, offs):
                    if len(tokens) and (c := _class_id(tokens)) not in seen:
                        seen.add(c)
                        keys, p = _prefix_of(tokens, last)
                        held.append(_short(keys[:p], bits))
                        size += p
                if size > FLUSH:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return run, schema


def _token_filter(texts: DataFrame, members: DataFrame, k: int, common) -> tuple[np.ndarray, int, int]:
    """(bytes of the filter, bits of a hash, bits of the filter's index): set
    for every prefix token that two classes have, and for few others."""
    p = F.col("n") - F.ceil(F.col("n") * 75 / 100) + 1
    tokens = members.where("n > 0").agg(F.sum(p).cast("long")).first()[0] or 1
    bits = max(16, min(60, tokens.bit_length() + HASH_MORE))
    size = min(bits, FILTER_BITS)
    cell_bits = max(4, min(size - 3, tokens.bit_length() - 20))
    run, schema = _hashes(k, common, bits, cell_bits)

    def merged(table):
        ones, many = (np.concatenate([decoded(x) for x in table.column(i).to_pylist()]) for i in (1, 2))
        ones.sort()
        again = ones[1:][ones[1:] == ones[:-1]]
        cell = table.column(0)[0].as_py()
        at = (np.concatenate([again, many]) >> np.uint64(bits - size)).astype(np.int64) - (cell << size - cell_bits)
        mask = np.zeros(1 << size - cell_bits, bool)
        mask[at] = True
        return pa.table({"cell": pa.array([cell], pa.int32()), "mask": pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << size - 3, np.uint8)
    step = 1 << size - cell_bits - 3
    rows = texts.mapInArrow(run, schema).groupBy("cell").applyInArrow(merged, "cell int, mask binary").toArrow()
    for cell, mask in zip(rows.column(0).to_pylist(), rows.column(1)):
        out[cell * step:(cell + 1) * step] = np.frombuffer(mask.as_py(), np.uint8)
    return out, bits, size


def _prefixes(k: int, common, wanted, bits: int, size: int):
    schema = "token long, c long, pos int, size int, odd int, prof array<long>"

    def run(batches):
        shingles, seen, last, filled = Shingler(k), set(), common.value, wanted.value
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0)):
                cols = ([], [], [], [], [], [])
                for tokens in shingles(data, offs):
                    if not len(tokens) or (c := _class_id(tokens)) in seen:
                        continue
                    seen.add(c)
                    keys, p = _prefix_of(tokens, last)
                    at = (_short(keys[:p], bits) >> np.uint64(bits - size)).astype(np.int64)
                    kept = filled[at >> 3] >> (at & 7).astype(np.uint8) & 1
                    kept[0] = 1  # the class's own row
                    kept = np.flatnonzero(kept).astype(np.int32)
                    m = len(kept)
                    cols[0].append(keys[kept])
                    cols[1].append(np.full(m, c, np.int64))
                    cols[2].append(kept)
                    cols[3].append(np.full(m, len(tokens), np.int32))
                    cols[4].append(np.full(m, np.searchsorted(keys, 0), np.int32))
                    cols[5].append([keys[np.arange(GRID + 1) * (p - 1) // GRID]] + [None] * (m - 1))
                if cols[0]:
                    flat = [pa.array(np.concatenate(x)) for x in cols[:5]]
                    prof = pa.array([x for y in cols[5] for x in y], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*flat, prof], ["token", "c", "pos", "size", "odd", "prof"])

    return run, schema


def _arrays(k: int, bits):
    schema = "c long, arr array<long>"

    def run(batches):
        shingles, seen, wanted = Shingler(k), set(), bits.value
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0)):
                cs, arrs = [], []
                for tokens in shingles(data, offs):
                    if not len(tokens) or (c := _class_id(tokens)) in seen:
                        continue
                    x = c & ((1 << MAP_BITS) - 1)
                    if wanted[x >> 3] >> (x & 7) & 1:
                        seen.add(c)
                        cs.append(c)
                        arrs.append(tokens.view(np.int64))
                if cs:
                    yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(arrs, pa.list_(pa.int64()))], ["c", "arr"])

    return run, schema


def _common_tokens(sets: DataFrame, table) -> np.ndarray:
    """The most shared tokens: the lowest power of two (from 4 up) as count
    threshold whose tokens number at most COMMON, by a measured histogram."""
    counts = table(sets.where("kind = 1").groupBy("c").agg(F.sum("cnt").alias("cnt")), "ngj-counts")
    levels = {r.level: r.n for r in counts.groupBy(F.floor(F.log2("cnt")).alias("level")).agg(F.count("*").alias("n")).collect()}
    least = 2
    while sum(n for level, n in levels.items() if level >= least) > COMMON:
        least += 1
    rows = counts.where(F.floor(F.log2("cnt")) >= least).select("c").toArrow()
    return np.sort(rows.column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _sets_of(texts: DataFrame, classes: DataFrame, k: int, table) -> DataFrame:
    """(c, arr) of the given classes.  A filter of 2**26 bits, whatever their
    number, spares most other sets the shuffle; the join then is exact."""
    low = F.col("c").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    byte = classes.select(F.shiftright(low, 3).cast("int").alias("i"), F.expr("shiftleft(1, cast(c & 7 as int))").alias("b"))
    rows = byte.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    bits[rows.column("i").to_numpy()] = rows.column("b").to_numpy()
    run, schema = _arrays(k, texts.sparkSession.sparkContext.broadcast(bits))
    found = texts.mapInArrow(run, schema).join(classes, "c", "left_semi")
    return table(found.dropDuplicates(["c"]), "ngj-arrays")


def _linked(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets meet the threshold."""
    x = arrays.select(F.col("c").alias("a"), F.col("arr").alias("xs"))
    y = arrays.select(F.col("c").alias("b"), F.col("arr").alias("ys"))
    both = F.size(F.array_intersect("xs", "ys"))
    return pairs.join(x, "a").join(y, "b").where(100 * both >= 75 * (F.size("xs") + F.size("ys") - both)).select("a", "b")


def _until(prof: str, n: str, end: str) -> str:
    """SQL: at least how many tokens of a set of ``n`` have keys up to ``end``, by its prefix profile."""
    below = f"size(filter({prof}, v -> v <= {end}))"
    return f"if({below} = 0, 0, floor(({below} - 1) * ({n} - ceil({n} * 75 / 100)) / {GRID}) + 1)"


def _labelled(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, n, t, label), one row per row of ``docs``, in a table of
    ``scratch``: t is a hash of the text as it is, label names the component
    (null without words).  Other tables are dropped when no step needs them."""
    spark = docs.sparkSession
    table = scratch.table
    texts = docs.select(F.col(text_col).alias("text"))
    run, schema = _sets(k)
    sets = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    sets = table(sets.mapInArrow(run, schema), "ngj-sets")
    members = sets.where("kind = 0").select("doc_id", "n", "c", "t")

    # prefixes of the classes, without tokens that one class alone has
    common = spark.sparkContext.broadcast(_common_tokens(sets, table))
    wanted, bits, size = _token_filter(texts, members, k, common)
    run, schema = _prefixes(k, common, spark.sparkContext.broadcast(wanted), bits, size)
    by = Window.partitionBy("token")
    pre = texts.mapInArrow(run, schema)
    pre = (pre.withColumn("before", F.lag("c").over(by.orderBy("c")))
              .withColumn("lead", F.min(F.struct("odd", "c")).over(by).getField("c"))
              .withColumn("other", F.min(F.struct("odd", (-F.col("c")).alias("d"), "c")).over(by).getField("c"))
              .withColumn("met", F.min("c").over(by) != F.max("c").over(by))
              .where("(met or pos = 0) and (before is null or before <> c)")
              .select("token", "c", "pos", "size", "prof", "lead", "other", "met"))
    pre = table(pre, "ngj-prefixes")
    scratch.drop(keep=(sets, pre))
    scratch.release()
    met = pre.where("met").select("token", "c", "pos", "size", "lead", "other")

    # groups: a token's leads are the classes with the fewest odd tokens, the
    # likely centres; of its leads a class tries those it shares most with
    own = pre.where("pos = 0").select("c", "size", "prof", F.element_at("prof", -1).alias("own"))
    star = met.select("c", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("lead").alias("o")), F.struct(F.lit(1).alias("end"), F.col("other").alias("o")))).alias("e"))
    star = star.select("c", "e.end", "e.o").where("c <> o").groupBy("c", "end", "o").agg(F.count("*").alias("x"))
    p = "(size - ceil(size * 75 / 100) + 1)"
    star = star.groupBy("c", "end").agg(F.max(F.struct("x", "o")).alias("best")).select("c", "best.x", "best.o").distinct()
    star = star.join(own, "c").where(F.expr(f"x >= 0.15 * {p}"))
    star = (star.join(own.select(F.col("c").alias("o"), F.col("size").alias("most"), F.col("prof").alias("prof2"), F.col("own").alias("own2")), "o")
                .withColumn("need", F.expr("greatest(ceil(greatest(size, most) * 75 / 100), ceil((size + most) * 3 / 7))"))
                .where(F.expr(f"{_until('prof', 'size', 'own2')} - x <= size - need and {_until('prof2', 'most', 'own')} - x <= most - need")))
    star = table(star.select(F.col("c").alias("a"), F.col("o").alias("b")).distinct(), "ngj-star")
    scratch.release()
    ends = star.select(F.col("a").alias("c")).union(star.select(F.col("b").alias("c"))).distinct()
    arrays = _sets_of(texts, ends, k, table)
    scratch.release()
    first = table(_linked(star, arrays), "ngj-links")
    scratch.drop(keep=(sets, pre, first))
    scratch.release()
    group = components(first, scratch)
    many = group.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    group = group.join(many, "label").select("c", "label", F.xxhash64("label", F.pmod(F.xxhash64("c"), "parts")).alias("block"))
    group = table(group, "ngj-groups")
    scratch.drop(keep=(sets, pre, first, group))

    # the matrix, and which blocks a class of another group has to look at
    cls = (pre.where("pos = 0").select("c", "size", "prof").join(group, "c", "left")
              .select("c", "size", "prof", F.coalesce("label", "c").alias("label"), F.coalesce("block", "c").alias("block")))
    cls = table(cls, "ngj-classes")
    scratch.release()
    blocks = cls.groupBy("block").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count("*").alias("members"),
                                      F.min(F.element_at("prof", -1)).alias("known"), F.max(F.struct("c", "prof")).alias("one"))
    placed = (met.join(group, "c", "left")
                 .select("token", "c", "size", "pos", F.coalesce("label", "c").alias("label"), F.coalesce("block", "c").alias("block")))
    need = "greatest(ceil(size * 75 / 100), ceil((size + least) * 3 / 7))"
    early = (placed.where(F.expr("pos < size - ceil(size * 6 / 7) + 1")).groupBy("token", "block")
                   .agg(F.max("label").alias("other"), F.min("size").alias("least"), F.max("size").alias("most")))
    hits = (placed.select("token", "c", "size", "pos", "label").join(early, "token")
                  .where("label <> other and 100 * most >= 75 * size and least <= size").where(F.expr(f"pos <= size - {need}")))
    hits = table(hits.select("c", "block").distinct(), "ngj-hits")
    scratch.release()
    matrix = placed.join(hits.select("block").distinct(), "block", "left_semi").select("token", "block").distinct()
    hits = (hits.join(met.select("c", "token"), "c").join(matrix, ["token", "block"])
                .groupBy("c", "block").agg(F.count("*").alias("x")))
    cand = (hits.join(cls.select("c", "size", "prof", F.element_at("prof", -1).alias("own")), "c").join(blocks, "block")
                .where(F.expr(f"{_until('prof', 'size', 'known')} - x <= size - {need}"))
                .where(F.expr(f"members > 1 or {_until('one.prof', 'most', 'own')} - x <= most - {need}"))
                .select("c", "block", F.expr(need).alias("need")))
    cand = table(cand, "ngj-candidates")
    scratch.drop(keep=(sets, first, cls, cand))
    scratch.release()

    # open the qualifying blocks
    inside = cls.join(cand.select("block").distinct(), "block", "left_semi").select("block", F.col("c").alias("b"))
    ends = inside.select(F.col("b").alias("c")).union(cand.select("c")).distinct()
    arrays = _sets_of(texts, ends, k, table)
    scratch.release()
    union = (inside.join(arrays.withColumnRenamed("c", "b"), "b").groupBy("block")
                   .agg(F.array_distinct(F.flatten(F.collect_list("arr"))).alias("all")))
    opened = cand.join(arrays, "c").join(union, "block").where(F.size(F.array_intersect("arr", "all")) >= F.col("need"))
    pairs = table(opened.select(F.col("c").alias("a"), "block").join(inside, "block").select("a", "b"), "ngj-pairs")
    scratch.release()
    second = table(_linked(pairs, arrays), "ngj-links")

    scratch.drop(keep=(sets, first, second))
    scratch.release()
    label = components(first.union(second), scratch)
    rows = members.join(label, "c", "left").select("doc_id", "n", "t", F.coalesce("label", "c").alias("label"))
    rows = table(rows, "ngj-rows")
    scratch.drop(keep=(rows,))
    scratch.release()
    return rows


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    rows = _labelled(docs, scratch, id_col, text_col, k)
    least = scratch.table(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "ngj-least")
    return rows.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null
    ids last), of texts of that id that of the smallest text hash, and of
    equal rows any.  Rows whose text has no word are in no component and stay.
    Columns of any name pass through.
    """
    scratch = Scratch(docs.sparkSession)
    rows = _labelled(docs, scratch, id_col, text_col, k).where("label is not null")
    names = [free(docs, c) for c in ("_id", "_hash", "_copies")]
    each = rows.groupBy("label", "doc_id", "t").agg(F.count(F.lit(1)).alias("copies"))
    keep = each.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "copies")).alias("one"))
    keep = scratch.table(keep.select(*[F.col(f"one.{c}").alias(n) for c, n in zip(("doc_id", "t", "copies"), names)]), "ngj-keep")
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(text_col) == F.col(names[1]))
    kept = docs.where(worded).join(keep, same)
    one = kept.where(F.col(names[2]) == 1).select(docs.columns)
    more = kept.where(F.col(names[2]) > 1).select(docs.columns).dropDuplicates([id_col, text_col])
    return one.unionByName(more).unionByName(docs.where(~worded))
