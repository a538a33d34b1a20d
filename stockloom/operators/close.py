"""Pairs of sparse unit vectors whose cosine reaches a threshold. Exact.

Words are numbered from the rarest on. If a word is the first one that two vectors share, their cosine is at most the product of
their lengths from that word on. So a pair that counts shares a word among the first of both, those from
which on a vector is still as long as the threshold. Only these are indexed and looked up. What a pair has in common there, and
the lengths behind the last word found, bound its cosine; then the most common words, held as a matrix, tighten that bound;
only pairs still in question are summed over all their words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Similarities are rounded, so that equal ones compare equal whatever the order of summation.
PLACES = 9

#: Bounds are kept in single precision and compared with this much to spare.
SLACK = 1e-4

#: Most common words held as a matrix, rows compared at a time, and the most numbers in a step's arrays.
COMMON, ROWS, MOST = 512, 64, 2_000_000


@dataclass
class Vectors:
    """Rows of words (numbers, ascending) and weights; row r lies from ends[r] to ends[r + 1]."""

    ids: pa.Array
    words: np.ndarray
    weights: np.ndarray
    ends: np.ndarray
    n_words: int
    _index: Index | None = field(default=None, repr=False)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.ends))

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """The length of a word's vector from the word on, and behind it."""
        squares = self.weights * self.weights
        upto = np.concatenate([[0.0], np.cumsum(squares)])
        left = np.repeat(upto[self.ends[1:]], np.diff(self.ends))
        return tuple(np.sqrt(np.maximum(left - x, 0.0)).astype(np.float32) for x in (upto[:-1], upto[1:]))

    def common(self, rows: np.ndarray | None = None) -> np.ndarray:
        """The weights of the most common words."""
        low = max(0, self.n_words - COMMON)
        out = np.zeros((len(self.ids), self.n_words - low), np.float32)
        take = self.words >= low
        out[self.rows()[take] if rows is None else rows[take], self.words[take] - low] = self.weights[take]
        return out

    def index(self, threshold: float) -> Index:
        """Made once per process that holds this block."""
        if self._index is None:
            self._index = Index(self, threshold)
        return self._index


class Index:
    """The first words of a block's vectors, by word."""

    def __init__(self, block: Vectors, threshold: float):
        on, behind = block.lengths()
        first = np.flatnonzero(on >= threshold - SLACK)
        first = first[np.argsort(block.words[first], kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(block.words[first], minlength=block.n_words))])
        self.row = np.searchsorted(block.ends, first, "right").astype(np.int32) - 1
        self.weight, self.behind = block.weights[first].astype(np.float32), behind[first]
        self.common = block.common()
        self.common_squares = np.square(self.common).sum(1)
        self.dense = np.zeros(block.n_words)


def vectors(ids: pa.Array, words: pa.Array, values: pa.Array, n_words: int, alone: int, steps: tuple[np.ndarray, np.ndarray] | None) -> Vectors:
    """Rows as stored. Values are weights or, with ``steps``, counts: the first word of each idf, and the idfs.

    The first ``alone`` words, held by one vector each, count for its length and are left out then.
    """
    words, values = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (words, values))
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat, weights = words.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False).astype(float)
    if steps is not None and len(flat):
        weights *= steps[1][np.searchsorted(steps[0], flat, "right") - 1]
        weights /= np.repeat(np.sqrt(np.add.reduceat(weights * weights, ends[:-1])), sizes)
    shared = flat >= alone
    if not shared.all():
        ends = np.concatenate([[0], np.cumsum(shared)])[ends]
        flat, weights = flat[shared], weights[shared]
    return Vectors(ids, (flat - alone).astype(np.int32), weights, ends, n_words - alone)


def close_pairs(own: Vectors, block: Vectors, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``own``, rows of ``block`` and the cosines that reach ``threshold``."""
    index, found = block.index(threshold), []
    on, behind = own.lengths()
    for low in range(0, len(own.ids), ROWS):
        high = min(low + ROWS, len(own.ids))
        group = slice(own.ends[low], own.ends[high])
        part = Vectors(own.ids[low:high], own.words[group], own.weights[group], own.ends[low : high + 1] - own.ends[low], own.n_words)
        x, y = _candidates(part, on[group] >= threshold - SLACK, behind[group], len(block.ids), index, threshold)
        for a, b, similarity in _exact(part, block, index, x, y):
            kept = similarity >= threshold
            found.append((a[kept] + low, b[kept], similarity[kept]))
    kinds = (np.int64, np.int64, float)
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate(kinds))


def _candidates(part: Vectors, first: np.ndarray, behind: np.ndarray, n: int, index: Index, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that the bounds leave, in order."""
    rows = part.rows()
    row, word, weight, behind = rows[first], part.words[first], part.weights[first].astype(np.float32), behind[first]
    start = index.start[word]
    counts = index.start[word + 1] - start
    upto = np.concatenate([[0], np.cumsum(counts)])
    if not upto[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums, lengths, other_lengths = np.zeros(len(part.ids) * n), np.empty(len(part.ids) * n, np.float32), np.empty(len(part.ids) * n, np.float32)
    at = 0
    while at < len(word):  # in the order of words, so that the last one found for a pair is left
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + MOST, "right")) - 1)
        count = counts[at:to]
        where = np.repeat(start[at:to] - upto[at:to] + upto[at], count) + np.arange(upto[to] - upto[at])
        pair = np.repeat(row[at:to].astype(np.int64) * n, count) + index.row[where]
        met = np.bincount(pair, np.repeat(weight[at:to], count) * index.weight[where], len(sums))
        sums = met if not at else sums + met
        lengths[pair], other_lengths[pair] = np.repeat(behind[at:to], count), index.behind[where]
        at = to
    pair = np.flatnonzero(sums > 0)
    pair = pair[sums[pair] + lengths[pair] * other_lengths[pair] >= threshold - SLACK]
    common = part.common(rows)
    squares = np.square(common).sum(1)
    kept = []
    for at in range(0, len(pair), MOST // COMMON):
        some = pair[at : at + MOST // COMMON]
        x, y = some // n, some % n
        left = [np.maximum(length[some] ** 2 - square, 0.0) + 1e-6 for length, square in ((lengths, squares[x]), (other_lengths, index.common_squares[y]))]
        bound = sums[some] + np.einsum("ij,ij->i", common[x], index.common[y]) + np.sqrt(left[0] * left[1])
        kept.append(some[bound >= threshold - SLACK])
    pair = np.concatenate(kept) if kept else pair
    return pair // n, pair % n


def _exact(part: Vectors, block: Vectors, index: Index, x: np.ndarray, y: np.ndarray):
    """Cosines of pairs of rows over all words."""
    if not len(x):
        return
    sizes = np.diff(block.ends)[y]
    new = np.flatnonzero(np.diff(x, prepend=-1))
    for lo, hi in zip(new, np.append(new[1:], len(x)), strict=True):
        own = slice(part.ends[x[lo]], part.ends[x[lo] + 1])
        index.dense[part.words[own]] = part.weights[own]
        while lo < hi:
            upto = np.cumsum(sizes[lo:hi])
            to = lo + max(1, int(np.searchsorted(upto, MOST, "right")))
            size, upto = sizes[lo:to], upto[: to - lo]
            where = np.repeat(block.ends[y[lo:to]] - upto + size, size) + np.arange(upto[-1])
            similarity = np.add.reduceat(block.weights[where] * index.dense[block.words[where]], upto - size)
            yield x[lo:to], y[lo:to], np.rint(similarity * 10.0**PLACES) / 10.0**PLACES
            lo = to
        index.dense[part.words[own]] = 0.0
