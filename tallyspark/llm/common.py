"""Shared helpers: intermediate tables in the cluster's shared folder, text
slices of Arrow batches, and vectorised 64-bit hashes of words and shingles.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a private one only where the
    setting is absent and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="tallyspark-llm-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Intermediate tables in the shared folder.

    ``table`` writes a frame and reads it back: later steps, and retries
    after a lost executor, start from the files.  ``drop`` deletes the tables
    that no later step reads.  ``release`` lets Spark delete the shuffle
    files of finished steps now; it would do so when the driver's JVM next
    collects its garbage.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, keep: tuple[DataFrame, ...] = ()) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in [k for k in self.paths if k not in map(id, keep)]:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name)[0])
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def table(df: DataFrame, tag: str) -> DataFrame:
    """A table that stays for the rest of the run."""
    return Scratch(df.sparkSession).table(df, tag)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until the frame has no such column
    (Spark's names do not differ by case alone)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- slices of Arrow string columns -----------------------------------------

def text_slices(col: pa.Array, limit: int = SLICE_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) for runs of rows of at
    most ``limit`` bytes (a longer row alone); a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


# --- hashes -------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    start = (seed * 0x632BE59BD9B4E019 + 1) % 2 ** 64
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(start)) | np.uint64(1)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of the words of concatenated texts.

    A word is a maximal run of bytes that are not in ``\\x20\\x09-\\x0D``;
    A-Z count as a-z.  The hash is a polynomial over per-byte random values,
    taken as a difference of prefix sums, then finalised.
    """

    def __init__(self) -> None:
        self.value = stream(11, 256)
        for b in range(65, 91):
            self.value[b] = self.value[b + 32]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up = powers(n)
            self.down = powers(n, pow(_BASE, -1, 2 ** 64))

    def _run(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        self._grow(n + 1)
        space = self.space[data]
        first = ~space
        first[1:] &= space[:-1]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        first[heads] = ~space[heads]
        last = ~space
        last[:-1] &= space[1:]
        tails = offs[1:][offs[:-1] < offs[1:]] - 1
        last[tails] = ~space[tails]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=total[1:])
        words = mix((total[ends] - total[starts]) * self.down[starts])
        return words, np.searchsorted(starts, offs)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes, first word of each text and the end)."""
        if len(data) <= 2 * SLICE_BYTES or len(offs) != 2:
            return self._run(data, offs)
        parts, at = [], 0  # one long text, cut at white space
        while at < len(data):
            end, step = min(len(data), at + SLICE_BYTES), SLICE_BYTES
            while end < len(data):
                gaps = np.flatnonzero(self.space[data[end - step:end]])
                if len(gaps):
                    end = end - step + int(gaps[-1]) + 1
                    break
                end = min(len(data), end + step)
            parts.append(self._run(data[at:end], np.array([0, end - at]))[0])
            at = end
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])


class Shingler:
    """Sorted distinct shingle hashes of each text: ``k`` words in a row; a
    text of 1 to k-1 words has its whole sequence as its one shingle."""

    def __init__(self, k: int = 5) -> None:
        self.k, self.words = k, WordHasher()
        self.by_place, self.salt = stream(23, k), stream(29, k)

    def __call__(self, data: np.ndarray, offs: np.ndarray):
        k = self.k
        words, at = self.words(data, offs)
        if len(words) >= k:
            n = len(words) - k + 1
            all_ = words[:n] * self.by_place[0]
            for j in range(1, k):
                all_ += words[j:n + j] * self.by_place[j]
            all_ = mix(all_)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                yield np.unique(all_[a:b - k + 1])
            elif b > a:
                yield mix(np.sum(words[a:b] * self.by_place[:b - a], dtype=np.uint64, keepdims=True) + self.salt[b - a])
            else:
                yield np.zeros(0, np.uint64)
