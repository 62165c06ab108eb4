"""Exact vector joins within scopes, by blocks.

Each side of a scope is cut into blocks by hash; every pair of blocks is one group of bounded size,
whatever share of the rows the scope holds.  Scopes that fit one block are one group.  The larger the
blocks, the fewer copies of a row are sent (one per block of the other side); their product is made
in slices, so that memory stays small.  Rows come and go as Arrow buffers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import hold

#: Rows of one block of a scope, on average, and rows of it whose scores are held at once.
BLOCK, SLICE = 8000, 1000
#: Rows of one Arrow batch of results, at most.
OUT = 100_000


def _placed(df: DataFrame, side: int, own: Column, mine: str, other: str) -> DataFrame:
    """One copy of each row per block of the other side."""
    place = F.pmod(F.xxhash64("id"), F.col(mine)).cast("int").alias("at")
    copies = F.explode(F.sequence(F.lit(0), (F.col(other) - 1).cast("int"))).alias("with")
    i, j = ("at", "with") if side == 0 else ("with", "at")
    return df.select("scope", "id", "vec", place, copies).select("scope", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "id", "vec")


def blocks(left: DataFrame, right: DataFrame, half: bool = False) -> DataFrame:
    """Rows (scope, i, j, side, id, vec) grouped and sorted by block pair. Inputs are (scope, id, vec).

    ``half`` is for a join of rows with themselves: of block pairs only those with i <= j.
    """
    n = lambda df, name: df.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    # written: of its real size, and a plain side of the joins, so that AQE can split a scope with a large share
    sizes = hold(n(left, "nl").join(n(right, "nr"), "scope"), "sizes")
    both = _placed(left.join(sizes, "scope"), 0, F.col("scope"), "nl", "nr").unionByName(_placed(right.join(sizes, "scope"), 1, F.col("scope"), "nr", "nl"))
    if half:
        both = both.filter("i <= j")
    return both.repartition("scope", "i", "j").sortWithinPartitions("scope", "i", "j", "side")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((scope, i, j), left ids, left matrix, right ids, right matrix) of each block pair of a sorted stream."""
    now, ids, vecs = None, ([], []), ([], [])

    def whole() -> tuple:
        sides = [(np.concatenate(ids[k]), _matrix(now[0], vecs[k])) for k in (0, 1)]
        return now, *sides[0], *sides[1]

    for b in batches:
        if not b.num_rows:
            continue
        scope = np.asarray(b.column("scope").to_pylist(), object)
        i, j, side = (b.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "side"))
        rid, lists = b.column("id").to_numpy(zero_copy_only=False), b.column("vec")
        values, at = lists.values.to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
        cuts = np.flatnonzero((scope[1:] != scope[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (side[1:] != side[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            key = (scope[lo], int(i[lo]), int(j[lo]))
            if key != now:
                if now and ids[0] and ids[1]:
                    yield whole()
                now, ids, vecs = key, ([], []), ([], [])
            n = np.diff(at[lo : hi + 1])
            if (n != n[0]).any():
                raise ValueError(f"vectors of different lengths in scope {key[0]}")
            ids[side[lo]].append(rid[lo:hi])
            vecs[side[lo]].append(values[at[lo] : at[hi]].reshape(hi - lo, n[0]))
    if now and ids[0] and ids[1]:
        yield whole()


def _matrix(scope: str, parts: list[np.ndarray]) -> np.ndarray:
    if len({p.shape[1] for p in parts}) > 1:
        raise ValueError(f"vectors of different lengths in scope {scope}")
    return np.concatenate(parts)


def _slices(n: int) -> Iterator[slice]:
    return (slice(lo, lo + SLICE) for lo in range(0, n, SLICE))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def pairs_above(rows: DataFrame, threshold: float, id_type: str = "bigint") -> DataFrame:
    """(scope, id_a, id_b, score) with id_a < id_b and raw cosine above the threshold (strictly).

    ``rows`` is (scope, id, vec) with usable vectors of one length per scope.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (scope, one, two), a, x, b, y in _groups(batches):
            x, y = _unit(x), _unit(y).T
            for part in _slices(len(a)):
                s = x[part] @ y
                i, j = np.nonzero(s > threshold)
                p, q, v = a[part][i], b[j], s[i, j]
                if one == two:  # within a block each pair is met in both directions
                    keep = p < q
                    p, q, v = p[keep], q[keep], v[keep]
                swap = p > q
                p[swap], q[swap] = q[swap], p[swap]
                for lo in range(0, len(p), OUT):
                    r = slice(lo, lo + OUT)
                    yield pa.record_batch([pa.array([scope] * len(p[r]), pa.string()), pa.array(p[r]), pa.array(q[r]), pa.array(v[r])], names=["scope", "id_a", "id_b", "score"])

    return blocks(rows, rows, half=True).mapInArrow(run, f"scope string, id_a {id_type}, id_b {id_type}, score double")


def _hits(s: np.ndarray, ok: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the allowed scores, of each row the ``k`` best (all if None); ties go to the first column."""
    if k == 0:
        return np.zeros(0, int), np.zeros(0, int)
    if k is not None and k < s.shape[1]:
        low = np.where(ok, -s, np.inf)
        ok = ok & (low <= np.partition(low, k - 1, axis=1)[:, k - 1 : k])
    i, j = np.nonzero(ok)
    if k is not None:
        order = np.lexsort((j, -s[i, j], i))
        i, j = i[order], j[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[keep], j[keep]
    return i, j


def _euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):  # by column: exact, and no array of rows x rows x columns
        out += (x[:, c, None] - y[None, :, c]) ** 2
    return np.sqrt(out)


def _manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        out += np.abs(x[:, c, None] - y[None, :, c])
    return out


#: Of each metric, the scores of two blocks, and whether the highest (1) or the lowest (-1) is nearest.
METRICS = {
    "cosine": (lambda x, y: np.clip(_unit(x) @ _unit(y).T, 0.0, 1.0), 1),
    "dot": (lambda x, y: x @ y.T, 1),
    "euclid": (_euclid, -1),
    "manhattan": (_manhattan, -1),
}


def nearest(probes: DataFrame, rows: DataFrame, k: int | None, threshold: float | None = None, id_type: str = "bigint", earlier: bool = False, metric: str = "cosine") -> DataFrame:
    """(scope, probe, id, score, rank): the k nearest rows of each probe's scope, by clamped cosine or another metric.

    The threshold is inclusive; ties go to the smallest id; a probe finds itself if it is a row.
    ``k`` None gives every row that reaches the threshold, without a rank.  With ``earlier`` a probe
    sees only rows up to its own id, before any cut.
    """
    if k is None and threshold is None:
        raise ValueError("k or a threshold is needed")
    if k is not None and k < 0:
        raise ValueError("k must not be negative")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    scores, sign = METRICS[metric]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (scope, _, _), a, x, b, y in _groups(batches):
            order = np.argsort(b, kind="stable")
            ids, y = b[order], y[order]
            for part in _slices(len(a)):
                own = a[part]
                s = sign * scores(x[part], y)
                ok = s >= sign * threshold if threshold is not None else np.ones(s.shape, bool)
                if earlier:
                    ok &= ids <= own[:, None]
                i, j = _hits(s, ok, k)
                for lo in range(0, len(i), OUT):
                    p, q = i[lo : lo + OUT], j[lo : lo + OUT]
                    yield pa.record_batch([pa.array([scope] * len(p), pa.string()), pa.array(own[p]), pa.array(ids[q]), pa.array(sign * s[p, q])], names=["scope", "probe", "id", "score"])

    found = blocks(probes, rows).mapInArrow(run, f"scope string, probe {id_type}, id {id_type}, score double")
    if k is None:
        return found
    rank = F.row_number().over(Window.partitionBy("scope", "probe").orderBy(F.desc("score") if sign > 0 else F.asc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
