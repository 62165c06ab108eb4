"""Format-preserving pseudonyms: keyed permutations of numbers and dates within their format.

A balanced Feistel network over decimal digits (rounds keyed by BLAKE2b) permutes all strings of a
length; walking its cycle until a value passes the format's own rule permutes the valid ones.  Equal
values get equal pseudonyms in every document, different ones different pseudonyms, and whoever has
the key can undo it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from hashlib import blake2b

ROUNDS = 10


def _round(key: bytes, tweak: str, i: int, width: int, half: str) -> int:
    return int.from_bytes(blake2b(f"{tweak}|{i}|{width}|{half}".encode(), key=key, digest_size=16).digest(), "big")


def _once(key: bytes, tweak: str, digits: str, back: bool) -> str:
    n = len(digits)
    if n == 1:  # one digit has no halves: a keyed rotation
        k = _round(key, tweak, 0, 1, "")
        return str((int(digits) + (-k if back else k)) % 10)
    u = n // 2
    a, b = digits[:u], digits[u:]
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    for i in order:  # even rounds change the left half by the right one, odd rounds the other way
        if i % 2 == 0:
            k = _round(key, tweak, i, n, b)
            a = str((int(a) + (-k if back else k)) % 10 ** len(a)).zfill(len(a))
        else:
            k = _round(key, tweak, i, n, a)
            b = str((int(b) + (-k if back else k)) % 10 ** len(b)).zfill(len(b))
    return a + b


def permute(key: bytes, digits: str, tweak: str = "", valid: Callable[[str], bool] | None = None, back: bool = False) -> str:
    """The pseudonym of a digit string (or with ``back`` the original), valid if the original is."""
    if not digits:
        return digits
    out = _once(key, tweak, digits, back)
    if valid and valid(digits):
        while not valid(out):
            out = _once(key, tweak, out, back)
    return out


_FIRST, _LAST, _MAX = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal(), date.max.toordinal()


def permute_date(key: bytes, day: date, back: bool = False) -> date:
    """A day of 1900 to 2099 as another one of these years; any other day as another of the others."""
    lived = lambda d: _FIRST <= int(d) <= _LAST if 1 <= int(d) <= _MAX else None
    n = str(day.toordinal()).zfill(len(str(_MAX)))
    own = lived(n)
    return date.fromordinal(int(permute(key, n, "date", lambda d: lived(d) is own, back)))


def rewrite(template: str, digits: str) -> str:
    """``template`` with its digits replaced in order, all else kept."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)
