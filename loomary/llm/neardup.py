"""Near-duplicate texts: an exact, size-aware heavy-light similarity join on word shingles.

Texts with the same shingle set form a class and are joined once.  Shingles are ordered by how
frequent they are, rarest first.  Two sets whose similarity reaches the threshold must share

* k shingles among the first ones of each, so a *heavy* set scans the inverted lists of its first
  shingles, in which all sets are entered, and keeps the partners it meets k times; and
* any fixed number of shingles among them at once, so *light* (small) sets find one another by the
  subsets of that size, without a scan of any list.

The size up to which sets are light is chosen where enumerating subsets costs less than scanning
the lists, summed over sets.  It changes the work, never the result.  Candidates are verified on
whole texts.

Frequencies are counted over all shingles in hash buckets: the order need only be the same everywhere,
so a bucket's total serves, and its table has a bounded size whatever the data.  A list that a large
share of the sets enters is cut into blocks, and joined block by block.
Classes and shingles are named by 64-bit hashes that include the scope.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import current_memories
from ..session import Scratch
from .components import connected_groups
from .sums import summed

#: Bits of the least and the largest frequency table (4 bytes a bucket, sent to every executor: 8 MB at most).
LEAST, MOST = 16, 21
#: Entries of an inverted list that are joined in one piece; longer lists are cut into blocks.
LIST = 2000
#: Common shingles among the first ones that a scanned partner must show, and size of a light set's subsets.
MEETINGS, SUBSET = 3, 2
#: The position that marks an enumerated subset; other positions take 30 bits, the two above tell the side of a block pair.
SUBSET_AT, SIDE = 0xFFFFFFFF, 30
#: Cost of one enumerated subset (hashed, shuffled, sorted), in scanned list entries.
SUBSET_COST = 3.0

_WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of words, remembered while they are few."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> list[int]:
        from xxhash import xxh3_64_intdigest

        seen, out = self.seen, []
        if len(seen) > 500_000:
            seen.clear()
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxh3_64_intdigest(w)
            out.append(h)
        return out


def shingle_sets(hasher: Hasher, scopes: list[str], texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct runs of ``size`` words of each text, sorted by both."""
    coded = [hasher(words_of(t)) for t in texts]
    n = np.array([len(c) for c in coded], np.int64)
    w = np.array([h for c in coded for h in c], np.uint64)
    owner = np.repeat(np.arange(len(texts)), n)
    if len(w) < size:
        return owner[:0], w[:0]
    scope = np.array(hasher([f"scope {s}" for s in scopes]), np.uint64)
    h = scope[owner[: len(w) - size + 1]]
    for k in range(size):
        h = mix(h * _M1 + w[k : len(w) - size + 1 + k])
    whole = owner[: len(w) - size + 1] == owner[size - 1 :]
    owner, h = owner[: len(w) - size + 1][whole], h[whole]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[first], h[first]


def _least(t: float, n: Column) -> Column:
    """Least overlap of a set of n with any partner."""
    return F.ceil(n * t - 1e-9)


def _class_rows(size: int):
    """(class, n, scope, id, text): the text only where the partition sees the class first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for b in batches:
            texts = b.column("text").to_pylist()
            owner, h = shingle_sets(hasher, b.column("scope").to_pylist(), texts, size)
            n = np.bincount(owner, minlength=len(texts))
            total = np.zeros(len(texts), np.uint64)
            np.add.at(total, owner, mix(h + _M1))
            other = np.zeros(len(texts), np.uint64)
            np.bitwise_xor.at(other, owner, mix(h ^ _M3))
            name = mix(mix(total) + other * _M1 + n.astype(np.uint64)).view(np.int64)
            keep = np.flatnonzero(n)
            for i in np.flatnonzero(n == 0):
                texts[i] = None
            for i in keep:
                if (c := int(name[i])) in seen:
                    texts[i] = None
                else:
                    seen.add(c)
            rows = pa.record_batch([pa.array(name), pa.array(n.astype(np.int32)), b.column("scope"), b.column("id"), pa.array(texts, pa.string())], names=["class", "n", "scope", "id", "text"])
            yield rows.take(pa.array(keep))

    return run


class Classes:
    """The texts of one run by class: ``rows`` (class, n, scope, id, text)."""

    def __init__(self, spark: SparkSession, texts: DataFrame, size: int):
        self.spark, self.size = spark, size
        self.scratch = s = Scratch(spark, "neardup")
        known = texts.filter("scope is not null and id is not null and text is not null").select("scope", "id", "text")
        self.rows = s.save(known.mapInArrow(_class_rows(size), "class bigint, n int, scope string, id string, text string"), "rows")
        self.members = self.rows.select("class", "scope", "id")
        self.texts = self.rows.filter("text is not null").select("class", "n", "scope", "text")


def _frequencies(c: Classes) -> np.ndarray:
    """How many classes have each shingle, by hash bucket; about eight shingles a bucket as far as MOST allows."""
    n = c.texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = 1 << min(max((int(n) // 8).bit_length(), LEAST), MOST)
    size, hasher = c.size, Hasher

    def count(b: pa.RecordBatch, total: np.ndarray) -> None:
        _, h = shingle_sets(hasher(), b.column("scope").to_pylist(), b.column("text").to_pylist(), size)
        total += np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)

    return np.minimum(summed(c.texts.select("scope", "text"), count, buckets), 2**31 - 1).astype(np.int32)


def prefixes(freq: np.ndarray, owner: np.ndarray, h: np.ndarray, n: np.ndarray, t: float) -> tuple[np.ndarray, ...]:
    """(owner, position, hash, frequency) of the first shingles of each set, rarest first."""
    f = freq[(h & np.uint64(len(freq) - 1)).astype(np.int64)]
    order = np.lexsort((h, f, owner))
    pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    least = np.ceil(n * t - 1e-9).astype(np.int64)
    keep = pos < np.repeat(np.minimum(n, n - least + np.minimum(MEETINGS, least)), n)
    picked = order[keep]
    return owner[keep], pos[keep], h[picked], f[picked]


def boundary(sizes: list[tuple[int, int, float]], t: float) -> int:
    """Largest light size: least total of subsets up to it and scanned entries above it.

    ``sizes`` holds (size, sets, scanned entries).  Sets that may share fewer than SUBSET shingles
    with a partner are never light.
    """
    best, at, total = 0.0, 0, 0.0
    for n, sets, scanned in sorted(sizes):
        least = ceil(n * t - 1e-9)
        if least < SUBSET:
            continue
        p = min(n, n - least + SUBSET)
        total += sets * p * (p - 1) / 2 * SUBSET_COST - scanned
        if total < best:
            best, at = total, n
    return at


def _costs(c: Classes, freq, t: float) -> list[tuple[int, int, float]]:
    """(size, sets, scanned entries) over all classes; one that several partitions saw counts in each, as it is entered."""
    size = c.size

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        noise = float(freq.value.mean())
        for b in batches:
            owner, h = shingle_sets(hasher, b.column("scope").to_pylist(), b.column("text").to_pylist(), size)
            n = np.bincount(owner, minlength=b.num_rows)
            o, _, _, f = prefixes(freq.value, owner, h, n, t)
            scanned = np.bincount(o, weights=np.maximum(f - noise, 1), minlength=b.num_rows)
            yield pa.record_batch([pa.array(n, pa.int32()), pa.array(scanned)], names=["n", "scanned"])

    costs = c.texts.select("scope", "text").mapInArrow(cost, "n int, scanned double")
    return [tuple(r) for r in costs.groupBy("n").agg(F.count("*"), F.sum("scanned")).collect()]


def _blocks(h: np.ndarray, cls: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, entry, side): a list longer than LIST is cut into blocks by class, and an entry goes to every pair of its block.

    Two entries of the same block meet under its own pair (side 0), two of different blocks under
    their pair alone, on sides 1 and 2.  So no key holds more than about two blocks.
    """
    k = np.maximum(np.ceil(length / LIST), 1).astype(np.int64)
    entry = np.repeat(np.arange(len(h)), k)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(k) - k, k)
    own = (mix(cls.view(np.uint64) * _M3) % k.astype(np.uint64)).astype(np.int64)[entry]
    many = k[entry] > 1
    pair = np.minimum(own, other).astype(np.uint64) * _M2 + np.maximum(own, other).astype(np.uint64)
    key = np.where(many, mix(h[entry] * _M1 + mix(pair + _M3)), h[entry])
    return key, entry, np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.int64)


def _entries(c: Classes, freq, t: float, light_to: int):
    """(h, class, at) of inverted lists and subsets; ``at`` packs size and position, SUBSET_AT for a subset."""
    size = c.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        noise = 2 * float(freq.value.mean())  # a bucket's other shingles
        for b in batches:
            owner, h = shingle_sets(hasher, b.column("scope").to_pylist(), b.column("text").to_pylist(), size)
            n = np.bincount(owner, minlength=b.num_rows)
            o, pos, ph, f = prefixes(freq.value, owner, h, n, t)
            name = b.column("class").to_numpy(zero_copy_only=False)
            one, two, side = _blocks(ph, name[o], f - noise)
            key, cls, at = [one], [name[o][two]], [(n[o][two] << 32) | (side << SIDE) | pos[two]]
            starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else []
            for s, e in zip(starts, [*starts[1:], len(o)], strict=True) if light_to else ():
                k = int(n[o[s]])
                least = ceil(k * t - 1e-9)
                if k <= light_to and least >= SUBSET:
                    p = ph[s:e][: k - least + SUBSET]
                    i, j = np.triu_indices(len(p), 1)
                    key.append(mix(p[i] * _M1 + p[j]))
                    cls.append(np.full(len(i), name[o[s]]))
                    at.append(np.full(len(i), (k << 32) | SUBSET_AT, np.int64))
            yield pa.record_batch([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(at).astype(np.int64))], names=["h", "class", "at"])

    return run


def similar_classes(c: Classes, threshold: float) -> DataFrame:
    """(a, b, n_a, n_b, common): pairs of classes at or above the threshold."""
    t, size = threshold, c.size
    freq = c.spark.sparkContext.broadcast(_frequencies(c))
    light_to = boundary(_costs(c, freq, t), t)
    # one exchange serves both sides of the join; a class seen by several partitions is entered once
    entries = c.texts.mapInArrow(_entries(c, freq, t, light_to), "h bigint, class bigint, at bigint").repartition("h").dropDuplicates()
    low = lambda side: F.col(f"at_{side}").bitwiseAND(F.lit(SUBSET_AT))
    part = lambda side: (F.shiftright(f"at_{side}", 32).cast("int"), low(side).bitwiseAND(F.lit((1 << SIDE) - 1)))
    block = lambda side: F.shiftright(low(side), SIDE)
    x = entries.select("h", F.col("class").alias("a"), F.col("at").alias("at_a"))
    y = entries.select("h", F.col("class").alias("b"), F.col("at").alias("at_b"))
    (n_a, pos_a), (n_b, pos_b) = part("a"), part("b")
    meet = lambda n: F.least(F.lit(MEETINGS), _least(t, n))
    k = F.least(meet(n_a), meet(n_b))
    need = F.ceil((n_a + n_b) * (t / (1 + t)) - 1e-9)
    ordered = (n_a < n_b) | ((n_a == n_b) & (F.col("a") < F.col("b")))
    lengths = n_a >= n_b * t - 1e-9
    # the smaller set need only enter as many as a partner of its own size or more leaves it
    entered = pos_a < n_a - F.ceil(n_a * (2 * t / (1 + t)) - 1e-9) + k
    room = k + F.least(n_a - pos_a, n_b - pos_b) - 1 >= need
    light = lambda n: (n <= light_to) & (_least(t, n) >= SUBSET)
    subset = (low("a") == SUBSET_AT) & (low("b") == SUBSET_AT)
    meets = ((block("a") == 0) & (block("b") == 0)) | ((block("a") == 1) & (block("b") == 2)) | ((block("a") == 2) & (block("b") == 1))
    scan = meets & entered & room & ~(light(n_a) & light(n_b))
    met = x.join(y, "h").filter(ordered & lengths & (subset | scan)).select("a", "b", n_a.alias("n_a"), n_b.alias("n_b"), F.when(subset, F.lit(MEETINGS)).otherwise(F.lit(1)).alias("m"))
    cands = met.groupBy("a", "b").agg(F.sum("m").alias("m"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b")).filter(F.col("m") >= F.least(F.lit(MEETINGS), _least(t, F.col("n_a")), _least(t, F.col("n_b")))).drop("m")

    texts = c.texts.select("class", "text").groupBy("class").agg(F.min("text").alias("text"))
    both = cands.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set] = {}  # a class is in many pairs

        def runs(name: int, text: str) -> set:
            got = known.get(name)
            if got is None:
                if len(known) > 5_000:
                    known.clear()
                w = words_of(text)
                got = known[name] = set(zip(*[w[i:] for i in range(size)], strict=False))
            return got

        for b in batches:
            sides = zip(*[b.column(x).to_pylist() for x in ("a", "text_a", "b", "text_b")], strict=True)
            common = np.fromiter((len(runs(a, p) & runs(o, q)) for a, p, o, q in sides), np.int64, b.num_rows)
            yield pa.record_batch([*[b.column(x) for x in ("a", "b", "n_a", "n_b")], pa.array(common)], names=["a", "b", "n_a", "n_b", "common"])

    checked = both.mapInArrow(verify, "a bigint, b bigint, n_a int, n_b int, common bigint")
    return checked.filter(F.col("common") >= (F.col("n_a") + F.col("n_b") - F.col("common")) * t - 1e-9)


def similar_pairs(spark: SparkSession, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """(scope, id_a, id_b), smaller id first, of all texts of a scope at or above the threshold.

    ``texts`` holds (scope, id, text), one row per id; other columns are ignored.  Similarity is
    the share of the union of both sets of ``size``-word runs that they have in common.  Texts that
    are null or shorter than one run have no set and no pair.  An empty table gives no rows.
    """
    c = Classes(spark, texts, size)
    pairs = similar_classes(c, threshold).select("a", "b")
    ma, mb = c.members.select(F.col("class").alias("a"), "scope", F.col("id").alias("x")), c.members.select(F.col("class").alias("b"), F.col("id").alias("y"))
    apart = pairs.join(ma, "a").join(mb, "b").select("scope", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    ca, cb = c.members.select("class", "scope", F.col("id").alias("id_a")), c.members.select("class", F.col("id").alias("id_b"))
    same = ca.join(cb, "class").filter("id_a < id_b").select("scope", "id_a", "id_b")
    return apart.unionByName(same)


def similar_groups(spark: SparkSession, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """(scope, id, class_id, n_links, group_id), one row per text with a set.

    ``class_id`` is the smallest id with the same set, ``n_links`` the number of other classes that
    are near-duplicates of it, ``group_id`` the smallest id linked directly or indirectly.
    Copies are not expanded into pairs.
    """
    c = Classes(spark, texts, size)
    names = c.members.groupBy("class", "scope").agg(F.min("id").alias("class_id"))
    pairs = c.scratch.save(similar_classes(c, threshold).select("a", "b"), "pairs")
    ids = pairs.join(names.select(F.col("class").alias("a"), F.col("scope").alias("agent_id"), F.col("class_id").alias("ia")), "a").join(names.select(F.col("class").alias("b"), F.col("class_id").alias("ib")), "b")
    links = c.scratch.save(ids.select("agent_id", F.col("ia").alias("a"), F.col("ib").alias("b")), "links")
    groups = connected_groups(spark, links).select(F.col("agent_id").alias("scope"), F.col("memory_id").alias("class_id"), "group_id")
    n_links = links.select("agent_id", F.explode(F.array("a", "b")).alias("class_id")).groupBy(F.col("agent_id").alias("scope"), "class_id").agg(F.count("*").alias("n_links"))
    rows = c.members.join(names, ["class", "scope"]).select("scope", "id", "class_id")
    return rows.join(n_links, ["scope", "class_id"], "left").join(groups, ["scope", "class_id"], "left").select("scope", "id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))


def memory_texts(memories: DataFrame) -> DataFrame:
    """(scope, id, text) of current memories, the agent being the scope."""
    return current_memories(memories, {"text": F.col("text")}).select(F.col("agent_id").alias("scope"), F.col("memory_id").alias("id"), "text")
