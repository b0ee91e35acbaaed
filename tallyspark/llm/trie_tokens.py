"""Operator 5, token counts by dynamic programming over a trie.

A word (run of characters other than \\x20\\x09-\\x0D) with the mark U+2581 in
front is a pre-token.  Its tokens are its likeliest cut into pieces of a
public vocabulary under a unigram model; a character that is no piece counts
as its UTF-8 bytes.  The vocabulary file is a BPE one, whose stored scores
are merge ranks, so the piece of rank r has the Zipf-Mandelbrot log
probability ``-log(r + 2.7)`` (a constant apart).  Of equal cuts the one
whose last pieces are longer counts.

The distinct pre-tokens of a batch are sorted and laid into a trie: a node
is a prefix, shared by its neighbours in sorted order.  Level by level, the
forward score of each node (best score of its prefix) and its token count are
computed once, for all nodes of the level together; terminal counts go to a
table that later batches of the task look up (cleared when it is full, which
costs time, not results).  A pre-token of more than ``WIDE`` characters is
split wherever no piece holds the two characters side by side: every cut has
an edge there, so the likeliest cut is that of the parts (scores are summed
part by part), and the parts go into the trie.  Text of scripts without
blanks becomes short parts in this way.  Only a part that is still longer
than ``WIDE`` runs the same recursion by itself.

Null and empty texts have 0 words and tokens; rows pass one by one, repeated
or not; only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHasher, mix, powers, text_slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WIDE = 62
BLOCK = 1 << 15     # words in a trie block
KNOWN = 1_500_000   # words that a task remembers
MARK = "▁"
_BASE = 0x9E3779B97F4A7C15


def load_pieces(path: str = VOCABULARY) -> tuple[dict[str, float], float]:
    """({piece: log probability}, log probability of a byte)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte = {}, 0.0
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte = -math.log(i + 2.7)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = -math.log(i + 2.7)
    return pieces, byte


def cut(word: str, pieces: dict[str, float], byte: float, longest: int) -> int:
    """Tokens of one pre-token, by the plain recursion."""
    best, count = [0.0], [0]
    for d in range(1, len(word) + 1):
        if word[d - 1] in pieces:
            top, n = -math.inf, 0
        else:
            size = len(word[d - 1].encode())
            top, n = best[d - 1] + byte * size, count[d - 1] + size
        for size in range(1, min(d, longest) + 1):
            score = pieces.get(word[d - size:d])
            if score is not None and best[d - size] + score >= top:
                top, n = best[d - size] + score, count[d - size] + 1
        best.append(top)
        count.append(n)
    return count[-1]


class TrieCounter:
    """Token counts of sorted distinct pre-tokens of at most WIDE + 1 characters."""

    def __init__(self, pieces: dict[str, float], byte: float) -> None:
        self.byte, self.longest = byte, max(map(len, pieces), default=1)
        self.up, self.down = powers(WIDE + 2), powers(WIDE + 2, pow(_BASE, -1, 2 ** 64))
        self.beside = {x[i:i + 2] for x in pieces for i in range(len(x) - 1)}
        names = list(pieces)
        grid, _ = self._grid(names, self.longest)
        sums = self._sums(grid)
        hashes = mix(sums[np.arange(len(names)), [len(x) for x in names]])
        order = np.argsort(hashes)
        self.hash, self.score = hashes[order], np.array([pieces[x] for x in names])[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    @staticmethod
    def _grid(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        grid = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
        return grid, np.array([len(x) for x in words])

    def _sums(self, grid: np.ndarray) -> np.ndarray:
        out = np.zeros((len(grid), grid.shape[1] + 1), np.uint64)
        np.cumsum(mix(grid.astype(np.uint64) + np.uint64(1)) * self.up[:grid.shape[1]], axis=1, out=out[:, 1:])
        return out

    def parts(self, word: str) -> list[str]:
        """``word`` split at the edges that every cut has."""
        edges = [0, *(i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.beside), len(word)]
        return [word[a:b] for a, b in zip(edges, edges[1:])]

    def __call__(self, words: list[str]) -> np.ndarray:
        grid, length = self._grid(words, max(map(len, words)))
        n, width = grid.shape
        sums = self._sums(grid)
        same = np.zeros(n, np.int64)  # characters shared with the word before
        if n > 1:
            differ = grid[1:] != grid[:-1]
            same[1:] = np.where(differ.any(1), differ.argmax(1), width)
        best, count = np.zeros((n, width + 1)), np.zeros((n, width + 1), np.int32)
        rows = np.arange(n)
        for d in range(1, width + 1):
            here = length >= d
            new = np.flatnonzero(here & (same < d))  # one word per node of this level
            if not len(new):
                break
            top, tokens = np.full(len(new), -np.inf), np.zeros(len(new), np.int32)
            for size in range(1, min(d, self.longest) + 1):
                h = mix((sums[new, d] - sums[new, d - size]) * self.down[d - size])
                at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
                if len(at):
                    place = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
                    true = self.hash[place] == h[at]
                    at, place = at[true], place[true]
                if size == 1:
                    other = np.ones(len(new), bool)
                    other[at] = False
                    for i in np.flatnonzero(other):
                        wide = len(chr(grid[new[i], d - 1]).encode("utf-8", "surrogatepass"))
                        top[i], tokens[i] = best[new[i], d - 1] + self.byte * wide, count[new[i], d - 1] + wide
                if len(at):
                    score = best[new[at], d - size] + self.score[place]
                    better = score >= top[at]
                    at = at[better]
                    top[at], tokens[at] = score[better], count[new[at], d - size] + 1
            best[new, d], count[new, d] = top, tokens
            node = np.zeros(n, np.int64)  # every word below a node reads the node's values
            node[new] = new
            node = np.maximum.accumulate(node)
            best[here, d], count[here, d] = best[node[here], d], count[node[here], d]
        return count[rows, length]


def _counter(pieces: dict[str, float], byte: float):
    schema = "doc_id long, n_words long, n_tokens long"

    def run(batches):
        trie, hasher = TrieCounter(pieces, byte), WordHasher()
        hasher.value[65:91] = mix(np.arange(65, 91, dtype=np.uint64)) | np.uint64(1)  # capitals count here
        known, tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            words, total = [], []
            for _, _, data, offs in text_slices(batch.column(1), 1 << 21):
                h, at = hasher(data, offs)
                each, first, back = np.unique(h, return_index=True, return_inverse=True)
                if len(each):
                    place = np.minimum(np.searchsorted(known, each), max(len(known) - 1, 0))
                    fresh = known[place] != each if len(known) else np.ones(len(each), bool)
                    if fresh.any():
                        start = np.flatnonzero(_starts(hasher, data, offs))[first[fresh]]
                        got = _fresh(trie, hasher, pieces, byte, data, start, offs)
                        if len(known) > KNOWN:
                            known, tokens = each[~fresh], tokens[place[~fresh]]
                        place = np.searchsorted(known, each[fresh])
                        known, tokens = np.insert(known, place, each[fresh]), np.insert(tokens, place, got)
                    sums = np.concatenate([[0], np.cumsum(tokens[np.searchsorted(known, each)][back])])
                else:
                    sums = np.zeros(1, np.int64)
                words.append(np.diff(at))
                total.append(sums[at[1:]] - sums[at[:-1]])
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, total)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in cols)], ["doc_id", "n_words", "n_tokens"])

    return run, schema


def _starts(hasher: WordHasher, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    first = ~hasher.space[data]
    first[1:] &= hasher.space[data[:-1]]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] = ~hasher.space[data[heads]]
    return first


def _fresh(trie, hasher, pieces, byte, data, start, offs) -> np.ndarray:
    """Token counts of the words that begin at ``start``."""
    edge = np.union1d(np.flatnonzero(hasher.space[data]), offs)
    end = edge[np.searchsorted(edge, start, "right")]
    raw = data.tobytes()
    found = [MARK + raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]
    each, of_word, of_part = {}, [], []  # distinct parts, and which word has which
    for i, x in enumerate(found):
        for part in trie.parts(x) if len(x) > WIDE else (x,):
            of_word.append(i)
            of_part.append(each.setdefault(part, len(each)))
    tokens = np.zeros(len(each), np.int64)
    order = sorted((x, i) for x, i in each.items() if len(x) <= WIDE)
    for a in range(0, len(order), BLOCK):
        block = order[a:a + BLOCK]
        tokens[[i for _, i in block]] = trie([x for x, _ in block])
    for x, i in each.items():
        if len(x) > WIDE:
            tokens[i] = cut(x, pieces, byte, trie.longest)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, of_word, tokens[of_part])
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens), a row for each document."""
    run, schema = _counter(*load_pieces(vocabulary))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
