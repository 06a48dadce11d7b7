"""Kernels of the fragment bias model: letters as codes, scores of sequence ends, and effective lengths under bias."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Letters of an end outside and inside the fragment, highest order, lengths that an effective length sums over.
OUTER, INNER, HIGHEST_ORDER, LENGTHS = 5, 15, 6, 200
WIDTH = OUTER + INNER
_CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def codes(text: str) -> np.ndarray:
    """Letters as 0 to 3; others count as A."""
    return _CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def cells(rows: np.ndarray, place: int, order: int) -> np.ndarray:
    """Number of each row's (letter, following `order` letters) at a place: the letter first, then the context, the nearest letter highest."""
    at = rows[:, place].astype(np.int64)
    for i in range(1, order + 1):
        at = at << 2 | rows[:, place + i]
    return at


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log of foreground over background probability of each cell, from counts (2, cells) of background and foreground, each with one more."""
    n = (counts + 1.0).reshape(2, 4, -1)
    p = n / n.sum(axis=1, keepdims=True)
    return (np.log(p[1]) - np.log(p[0])).ravel()


@dataclass
class SequenceBias:
    """Order of each place, -1 where it is left out, and its cells' log ratios."""

    orders: list[int]
    tables: list[np.ndarray]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log bias of ends given as codes, a row each."""
        out = np.zeros(len(rows))
        for place, order in enumerate(self.orders):
            if order >= 0:
                out += self.tables[place][cells(rows, place, order)]
        return out


def padding(name: str, n: int) -> np.ndarray:
    """Letters for places outside a sequence, drawn by its name."""
    return np.random.default_rng(zlib.crc32(name.encode())).integers(0, 4, n).astype(np.uint8)


def ends(name: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): for each position, the letters about a fragment that begins there, and about one that ends there."""
    pad = padding(name, 2 * WIDTH)
    padded = np.concatenate([pad[:WIDTH], codes(text), pad[WIDTH:]])
    windows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)
    at = np.arange(len(text)) + WIDTH
    return windows[at - OUTER], windows[at - INNER + 1]


@dataclass
class FragmentBias:
    """Both ends' models and the ratio of each hundredth of GC share, 0 to 100."""

    left: SequenceBias
    right: SequenceBias
    gc: np.ndarray

    def by_position(self, name: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left bias, right bias, number of G and C up to and with each position) of a transcript."""
        if not text:
            return np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        left, right = ends(name, text)
        return np.exp(self.left.score(left)), np.exp(self.right.score(right)), np.cumsum(np.isin(np.frombuffer(text.upper().encode("latin-1", "replace"), np.uint8), [67, 71]))

    def effective_length(self, left: np.ndarray, right: np.ndarray, gc: np.ndarray, lengths: np.ndarray, pmf: np.ndarray) -> float:
        """Sum over lengths and positions of pmf times the biases of a fragment there, at least 1."""
        total, upto = 0.0, np.concatenate(([0], gc))
        for k, p in zip(lengths.tolist(), pmf.tolist(), strict=True):
            if k <= len(left):
                share = (upto[k:] - upto[:-k]) / k
                total += p * float(left[: len(left) - k + 1] @ (right[k - 1 :] * self.gc[hundredths(share)]))
        return max(total, 1.0)


def hundredths(share: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(share * 100 + 0.5), 0, 100).astype(np.int64)


def flat() -> FragmentBias:
    """No bias at all."""
    none = SequenceBias([-1] * WIDTH, [np.zeros(0)] * WIDTH)
    return FragmentBias(none, none, np.ones(101))
