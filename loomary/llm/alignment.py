"""Progressive alignment of token sequences, and voting per column.

A profile is a list of columns; a column maps each token seen there (None: a gap) to its vote.
Two ways to add up votes: ``sum`` adds weights; ``rank`` lets a voter outweigh all less trusted
ones together, so a vote is that of the most trusted supporter.

An alignment matches as many tokens as possible (a longest common subsequence), at any length: the
dynamic programme runs over whole rows, and of a long one only every so many rows are kept, from
which the way back recomputes the others.  Memory grows with the square root of the cells, and the
alignment is the same as with all rows at hand.
"""

from __future__ import annotations

import re
from collections.abc import Container
from math import isqrt

import numpy as np

TOKENS = re.compile(r"\s+|\w+|[^\w\s]")
#: Cells of the dynamic programme up to which all rows are kept.
CELLS = 1_000_000

Vote = tuple  # rank: (-trust, id), the smallest wins; sum: (-weight, id)


def tokens(value: str) -> list[str]:
    """Words, marks and white space; joined they give the value again."""
    return TOKENS.findall(value)


def best(votes: dict):
    """The token with the best vote; a gap wins ties, then the smallest id."""
    return min(votes.items(), key=lambda kv: (kv[1][0], kv[0] is not None, kv[1][1]))[0]


def add_vote(votes: dict, token, vote: Vote, mode: str) -> None:
    had = votes.get(token)
    if had is None:
        votes[token] = vote
    elif mode == "sum":
        votes[token] = (had[0] + vote[0], min(had[1], vote[1]))
    else:
        votes[token] = min(had, vote)


def _matches(columns: list[Container], seq: list[str]) -> list[tuple[int, int]]:
    """Positions (i, j), rising in both, of most tokens ``seq[j]`` that are in ``columns[i]``."""
    n, m = len(columns), len(seq)
    if not n or not m:
        return []
    code: dict[str, int] = {}
    b = np.array([code.setdefault(t, len(code)) for t in seq], np.int32)

    def hits(i: int) -> np.ndarray:
        col = columns[i]
        known = [code[t] for t in col if t in code]
        return np.isin(b, known) if len(known) > 3 else np.logical_or.reduce([b == c for c in known]) if known else np.zeros(m, bool)

    def row(above: np.ndarray, i: int) -> np.ndarray:
        out = np.zeros(m + 1, np.int32)
        out[1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + hits(i)))
        return out

    step = n if n * m <= CELLS else isqrt(n) + 1
    kept, r = [np.zeros(m + 1, np.int32)], np.zeros(m + 1, np.int32)
    for i in range(n - 1 if n % step else n - step):  # rows at which a block starts
        r = row(r, i)
        if (i + 1) % step == 0:
            kept.append(r)
    out, j = [], m
    for at in range((n - 1) // step, -1, -1):
        block = [kept[at]]
        for i in range(at * step, min(n, (at + 1) * step)):
            block.append(row(block[-1], i))
        i = len(block) - 1
        while i and j:
            if block[i][j] == block[i - 1][j]:
                i -= 1
            elif block[i][j] == block[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((at * step + i, j))
    return out[::-1]


def align(columns: list[Container], seq: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions in ``columns`` and ``seq``, -1 for a gap; unmatched stretches pair up in order."""
    n, m = len(columns), len(seq)
    lo = 0
    while lo < n and lo < m and seq[lo] in columns[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and seq[m - 1 - hi] in columns[n - 1 - hi]:
        hi += 1
    inner = [(i + lo, j + lo) for i, j in _matches(columns[lo : n - hi], seq[lo : m - hi])]
    out, x, y = [(i, i) for i in range(lo)], lo, lo
    for i, j in [*inner, (n - hi, m - hi)]:
        k = min(i - x, j - y)
        out += [(x + d, y + d) for d in range(k)] + [(d, -1) for d in range(x + k, i)] + [(-1, d) for d in range(y + k, j)]
        if i < n - hi and j < m - hi:
            out.append((i, j))
        x, y = i + 1, j + 1
    return out + [(n - hi + d, m - hi + d) for d in range(hi)]


class Profile:
    """Sequences aligned so far, with the votes of each column."""

    def __init__(self, mode: str):
        self.mode, self.columns, self.total = mode, [], None

    def add(self, seq: list[str], vote: Vote) -> None:
        if self.total is None:
            self.columns, self.total = [{t: vote} for t in seq], vote
            return
        columns = []
        for i, j in align(self.columns, seq):
            votes = self.columns[i] if i >= 0 else {None: self.total}
            add_vote(votes, seq[j] if j >= 0 else None, vote, self.mode)
            columns.append(votes)
        total = {0: self.total}
        add_vote(total, 0, vote, self.mode)
        self.columns, self.total = columns, total[0]

    def consensus(self) -> list[str]:
        return [t for t in map(best, self.columns) if t is not None]


def distance(a: list[str], b: list[str]) -> int:
    """Tokens to change, add or drop from ``a`` to ``b`` under their alignment."""
    if a == b:
        return 0
    return sum(1 for i, j in align([(t,) for t in a], b) if i < 0 or j < 0 or a[i] != b[j])
