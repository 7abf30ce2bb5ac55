"""The subsampled Hartley transform of a block of rows, without a cosine per row and frequency.

An index j = r + B q is split in two.  e^(2 pi i j k / m) is e^(2 pi i r k / m), which takes only
B values per sampled frequency k and is tabled once a task, times a twiddle for q, which is the
product of one table entry per further digit of j in base B.  Phases are reduced modulo m in
integers before the tables are made, so accuracy does not fall with m.

* Dense groups (much of 0..B-1 present under one q, as in rows stored in key order): stage 1
  multiplies the tables with the rows of all groups at once; stage 2 turns each group's c sums by
  its twiddles.  That is two real multiplications per row, frequency and column, in BLAS.
* Sparse groups: the entries of each row are products of its digits' table rows.

Rows are never moved or sorted outside their Arrow batch.
"""

from __future__ import annotations

import math

import numpy as np

from tallsketch.functions import hashing as H

#: Entries of one table (real and imaginary parts, 8 bytes each).
TABLE = 1 << 19
#: Entries of rows x frequencies held at once for sparse groups.
CHUNK = 1 << 15
#: A group is dense when it holds at least this share of its B rows.
DENSE = 0.25


def mulmod(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """(a*b) % m for int64 a, b in [0, m) without overflow (m < 2^47)."""
    if m < (1 << 31):
        return (a * b) % m
    if m >= (1 << 47):
        raise ValueError("srdht supports m < 2^47 rows")
    res = np.zeros(np.broadcast(a, b).shape, dtype=np.int64)
    for shift in (32, 16, 0):
        chunk = (b >> shift) & 0xFFFF
        res = (((res << 16) % m) + (a * chunk) % m) % m
    return res


class Hartley:
    """Sums of sqrt(2/c) cos(2 pi j k / m - pi/4) s_j x_j over rows j, for the c frequencies k."""

    def __init__(self, m: int, freqs, seed: int, trial: int):
        self.m, self.freqs = m, np.asarray(freqs, dtype=np.int64)
        self.c = len(self.freqs)
        self.base = 1 << max(4, (TABLE // self.c).bit_length() - 1)
        self.sign = H.srdht_sign_poly(seed, trial)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []

    def _table(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and sines (base, c) of 2 pi d base^level k / m for the digits d."""
        while len(self.tables) <= level:
            power = pow(self.base, len(self.tables), self.m) if self.m > 1 else 0
            step = mulmod(np.full(1, power, np.int64), self.freqs % self.m, self.m)
            phase = mulmod(np.arange(self.base, dtype=np.int64)[:, None] % self.m, step[None, :], self.m)
            angle = phase * (2 * math.pi / self.m) if self.m < (1 << 31) else 2 * math.pi * (phase / self.m)
            self.tables.append((np.cos(angle), np.sin(angle)))
        return self.tables[level]

    def _turns(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and sines (rows, c) of 2 pi group base k / m, by the digits of ``group``."""
        cos, sin = self._table(1)
        at = group % self.base
        c, s = cos[at], sin[at]
        level, group = 1, group // self.base
        while group.any():
            level += 1
            cos, sin = self._table(level)
            at = group % self.base
            c, s = c * cos[at] - s * sin[at], c * sin[at] + s * cos[at]
            group = group // self.base
        return c, s

    def add(self, acc: np.ndarray, index: np.ndarray, X: np.ndarray) -> None:
        """Add the rows X = [A b] at ``index`` (0 .. m-1) to ``acc`` (c x width)."""
        X = X * H.np_sign(H.np_hash_key(index, self.sign))[:, None] / math.sqrt(self.c)
        group, at = np.unique(index // self.base, return_inverse=True)
        size = np.bincount(at, minlength=len(group))
        # a transform shorter than one group fills what there is of it
        dense = size >= max(1, DENSE * min(self.base, self.m))
        rows = dense[at]
        if dense.any():
            acc += self._groups(group[dense], np.cumsum(dense)[at[rows]] - 1, index[rows] % self.base, X[rows])
        rest = np.flatnonzero(~rows)
        step = max(1, CHUNK // self.c)
        cos, sin = self._table(0)
        for lo in range(0, len(rest), step):
            part = rest[lo:lo + step]
            c, s = self._turns(index[part] // self.base)
            r = index[part] % self.base
            # cos(x + y - pi/4) sqrt 2 = cos x (cos y + sin y) + sin x (cos y - sin y)
            acc += (cos[r] * (c + s) + sin[r] * (c - s)).T @ X[part]

    def _groups(self, group: np.ndarray, at: np.ndarray, r: np.ndarray, X: np.ndarray) -> np.ndarray:
        width = X.shape[1]
        laid = np.zeros((self.base, len(group), width))
        laid[r, at] = X
        laid = laid.reshape(self.base, -1)
        cos, sin = ((t.T @ laid).reshape(self.c, len(group), width) for t in self._table(0))
        c, s = self._turns(group)
        return np.einsum("gc,cgw->cw", c + s, cos) + np.einsum("gc,cgw->cw", c - s, sin)
