"""Operator 2, document fingerprints by winnowing.

Rolling hashes of all ``K``-grams of code points; of every window of ``W``
consecutive hashes the smallest is kept, the rightmost where several are
equal, with its position.  Any passage of ``W + K - 1`` code points that two
texts share has a kept hash in both.  A text of fewer K-grams is one window;
one of fewer than K code points has one hash, of the whole text; an empty or
null text has none.  Texts of any length are read whole, in pieces that
overlap by a window.

``edited_pairs`` compares each text with its edited form, whose tail is the
head of the next document, and with the next document.  Documents are dealt
to chunks of neighbouring ids (one shuffle); the first document of a chunk
is also sent to the chunk before it, so every document meets the next one
without a window over all rows.  Chunks number at most ``MAX_CHUNKS``, and so
do the rows that are broadcast or collected.  The order is by id descending,
null ids last, equal ids by text descending; repeated rows follow each other.
Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix

K = 10
W = 40
CHUNK_BYTES = 8 << 20
MAX_CHUNKS = 20_000
PIECE = 1 << 20
_POS = (1 << 21) - 1


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 40 bits, positions) kept of a text, in order."""
    n = len(text)
    if n < k:
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        whole = int.from_bytes(hashlib.blake2b(text.encode("utf-32-le"), digest_size=5).digest(), "big")
        return np.array([whole], np.uint64), np.zeros(1, np.int64)
    hashes, places = [], []
    for at in range(0, max(1, n - k - w + 2), PIECE):
        c = np.frombuffer(text[at:at + PIECE + w + k - 2].encode("utf-32-le"), np.uint32)
        m = len(c) - k + 1
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += c[j:m + j]
        low = (mix(h) >> np.uint64(24) << np.uint64(21)) | np.arange(_POS, _POS - m, -1, dtype=np.uint64)
        size, full = 1, min(w, m)
        while 2 * size <= full:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < full:
            low = np.minimum(low[:size - full], low[full - size:])
        keep = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=keep[1:])
        low = low[keep]
        pos = at + _POS - (low & np.uint64(_POS)).astype(np.int64)
        if places and places[-1][-1] == pos[0]:
            low, pos = low[1:], pos[1:]
        if len(pos):
            hashes.append(low >> np.uint64(21))
            places.append(pos)
    return np.concatenate(hashes), np.concatenate(places)


def digest(hashes: np.ndarray) -> str:
    """The kept hashes in order, ten hexadecimal digits each."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted distinct hash arrays; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(doc_id, hashes, positions) of every document."""
    def run(batches):
        for batch in batches:
            got = [winnow(x or "", k, w) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())),
                                              pa.array([p for _, p in got], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (place, extra, doc_id, text), sorted: each chunk's documents, then the one after its last (extra)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    chunks = min(MAX_CHUNKS, max(1, -(-size // CHUNK_BYTES)))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / chunks for i in range(1, chunks)], 10 * MAX_CHUNKS)).first()[0] if chunks > 1 else None
    cuts = sorted(set(cuts or []))
    if cuts:  # number of cuts below the id, by bisection
        steps = len(cuts).bit_length() + 1
        found = (f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, i) -> if(s.lo >= s.hi, s,"
                 f" if(element_at(_cuts, cast((s.lo + s.hi) div 2 as int) + 1) < doc_id, named_struct('lo', cast((s.lo + s.hi) div 2 as int) + 1, 'hi', s.hi),"
                 f" named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)")
        rows = rows.withColumn("_cuts", F.lit(cuts)).withColumn("chunk", F.expr(f"if(doc_id is null, -1, {found})")).drop("_cuts")
    else:
        rows = rows.withColumn("chunk", F.expr("if(doc_id is null, -1, 0)"))
    heads = sorted((r.chunk, r.head) for r in rows.groupBy("chunk").agg(F.max("doc_id").alias("head")).collect())
    # a chunk's first document also goes where the one before it is: the next higher chunk, or from the highest to the lowest
    to = [(c, h, heads[(i + 1) % len(heads)][0]) for i, (c, h) in enumerate(heads)]
    heads = docs.sparkSession.createDataFrame(to, "chunk int, head long, target int")
    copies = F.expr("if(doc_id <=> head, array(struct(chunk as place, false as extra), struct(target as place, true as extra)), array(struct(chunk as place, false as extra)))")
    rows = rows.join(F.broadcast(heads), "chunk").withColumn("at", F.explode(copies)).select("at.place", "at.extra", "doc_id", "text")
    return rows.repartition("place").sortWithinPartitions("place", "extra", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness
    of its own to that and to the next document's."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        last, out, held = None, [], 0

        def flush():
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], list(names))

        for batch in batches:
            for place, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if last is not None and last[0] != place:
                    last = None
                if extra and last is None:
                    continue
                own = winnow(text, k, w)[0]
                now = (place, doc_id, text, own, np.unique(own))
                if last is not None:
                    _, doc, before, kept, kept_set = last
                    after = edited(before, text)
                    changed = winnow(after, k, w)[0]
                    out.append((doc, len(before), hashlib.sha256(after.encode()).hexdigest(), digest(kept), digest(changed),
                                likeness(kept_set, np.unique(changed)), likeness(kept_set, now[4])))
                    held += len(before)
                last = None if extra else now
                if held > 1 << 22:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return _neighbours(docs, id_col, text_col).mapInArrow(run, schema)
