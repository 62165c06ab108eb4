"""Evaluation passages inside training text: BM25 retrieval with block-max WAND, then exact overlap.

The held-out items are indexed; every training passage is a query.  An item leaks into a document
when both have ``run`` consecutive words in common, so the retrieval threshold of an item is the
least BM25 score that any of its own runs can give a passage that contains it.  No leaking item
scores below, and impacts divided by that threshold make the bound 1 for all items.

Only words of the index score, and a shared run holds no other word: a document's passages are its
stretches of index words of at least that length, cut with an overlap of a run.  The document at a
time search keeps the lists sorted by item and skips blocks whose best impacts can't reach 1.
Retrieved items are verified on their exact runs.

Items come in blocks of bounded size.  The index of a block is built once, as flat arrays of about
thirty bytes a word, and broadcast; many items mean more passes over the documents and never a
larger broadcast.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: BM25 parameters, postings per block, words in a passage, and bytes of item text in one index.
K1, B, BLOCK, PASSAGE, INDEX_BYTES = 1.2, 0.75, 16, 64, 16 << 20

_HIDDEN = re.compile("[\xad\u200b\ufeff]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[^\S\n]*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def plain_words(text: str) -> list[str]:
    """Lower-cased words without soft hyphens, zero-width spaces and hyphenation at line ends."""
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "-" in text and "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ItemIndex:
    """Inverted lists of the items' words with impacts normalised to each item's threshold.

    All lists are flat arrays, so that an index of a block of items is built once, sent as it is and
    read in place by all tasks of a worker.
    """

    def __init__(self, items: list[tuple[int, str]], run: int):
        self.run = run
        self.ids: list[int] = []
        self.terms: dict[str, int] = {}
        coded, sizes = array("i"), []
        for i, t in items:
            w = plain_words(t or "")
            if len(w) >= run:
                self.ids.append(i)
                sizes.append(len(w))
                coded.extend([self.terms.setdefault(x, len(self.terms)) for x in w])
        words, n = np.frombuffer(coded, np.int32).astype(np.int64) if coded else np.zeros(0, np.int64), np.array(sizes, np.int64)
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(n)), n)
        v = max(1, len(self.terms))
        pairs, which, tf = np.unique(owner * v + words, return_inverse=True, return_counts=True)
        item, term = pairs // v, pairs % v
        df = np.bincount(term, minlength=v)
        norm = K1 * (1 - B + B * n / max(1.0, n.mean() if len(n) else 1.0))
        impact = np.log(1 + (len(n) - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + norm[item])
        starts = self._starts(ends, n)
        bound = self._bounds(impact[which], which, owner, starts)
        order = np.lexsort((item, term))
        self.off = array("q", np.r_[0, np.cumsum(df)].tolist())
        self.items = array("i", item[order].astype(np.int32).tobytes())
        score = (impact / bound[item])[order] if len(item) else np.zeros(0)
        self.impacts = array("d", score.tobytes())
        place = np.arange(len(order)) - np.repeat(np.cumsum(df) - df, df)
        heads = np.flatnonzero(place % BLOCK == 0)
        self.block = array("q", np.r_[0, np.cumsum(-(-df // BLOCK))].tolist())
        self.ends = array("i", item[order][np.r_[heads[1:], len(order)] - 1].astype(np.int32).tobytes()) if len(order) else array("i")
        self.tops = array("d", np.maximum.reduceat(score, heads).tobytes()) if len(order) else array("d")
        self.best = array("d", np.maximum.reduceat(score, np.flatnonzero(place == 0)).tobytes()) if len(order) else array("d")
        self._runs(words.astype(np.int32), starts, owner)

    def _starts(self, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Positions at which a whole run begins."""
        return np.flatnonzero(np.arange(int(n.sum())) + self.run <= np.repeat(ends, n))

    def _bounds(self, impact: np.ndarray, which: np.ndarray, owner: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Least sum of the impacts of a run's distinct words, per item."""
        order = np.argsort(which, kind="stable")
        before = np.full(len(which), -1, np.int64)
        again = which[order][1:] == which[order][:-1]
        before[order[1:][again]] = order[:-1][again]
        total = np.zeros(len(starts))
        for k in range(self.run):  # a word counts where it occurs first within the run
            total += np.where(before[starts + k] < starts, impact[starts + k], 0.0)
        out = np.full(len(self.ids), np.inf)
        np.minimum.at(out, owner[starts], total)
        return out

    def _hashes(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        h = np.full(len(starts), self.salt, np.uint64)
        for k in range(self.run):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[starts + k].astype(np.uint64))
        return h

    def _runs(self, words: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> None:
        """Distinct runs by hash (without a collision among them), and the runs of each item."""
        self.words, self.salt = words, np.uint64(0)
        while True:
            h = self._hashes(words, starts)
            self.hashes, first, ids = np.unique(h, return_index=True, return_inverse=True)
            self.at = starts[first] if len(starts) else starts
            if all((words[self.at[ids] + k] == words[starts + k]).all() for k in range(self.run)):
                break
            self.salt += np.uint64(1)
        pairs = np.unique(owner[starts] * max(1, len(self.hashes)) + ids)
        own = pairs // max(1, len(self.hashes))
        self.run_ids = pairs % max(1, len(self.hashes))
        self.run_off = np.r_[0, np.cumsum(np.bincount(own, minlength=len(self.ids)))]

    def passages(self, text: str) -> Iterator[list[int]]:
        """Stretches of index words at least a run long, cut at PASSAGE words with an overlap."""
        get, run, at = self.terms.get, self.run, []
        for t in map(get, plain_words(text)):
            if t is not None:
                at.append(t)
                continue
            if len(at) >= run:
                yield from self._cut(at)
            if at:
                at = []
        if len(at) >= run:
            yield from self._cut(at)

    def _cut(self, words: list[int]) -> Iterator[list[int]]:
        step = PASSAGE - self.run + 1
        for i in range(0, max(1, len(words) - self.run + 1), step):
            yield words[i : i + PASSAGE]

    def search(self, passage: list[int], bound: float = 1 - 1e-9) -> list[int]:
        """Items that score at least ``bound``: block-max WAND over the passage's lists."""
        best, items, off = self.best, self.items, self.off
        terms = set(passage)
        if sum([best[t] for t in terms]) < bound:
            return []
        cursors = [[items[off[t]], off[t], t] for t in terms]  # item, place in the list, word
        found = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                total += best[t]
                if total >= bound:
                    pivot = i
                    break
            if pivot < 0:
                break
            d = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == d:
                pivot += 1
            block, last = 0.0, None
            for _, _, t in cursors[: pivot + 1]:
                k = bisect_left(self.ends, d, self.block[t], self.block[t + 1])
                if k < self.block[t + 1]:
                    block += self.tops[k]
                    last = self.ends[k] if last is None else min(last, self.ends[k])
            if block < bound:  # nothing in these blocks: go past the first that ends, or to the next list
                to = (d if last is None else last) + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                self._advance(cursors, pivot, max(to, d + 1))
            elif cursors[0][0] == d:
                if sum([self.impacts[p] for _, p, _ in cursors[: pivot + 1]]) >= bound:
                    found.append(d)
                self._advance(cursors, pivot, d + 1)
            else:
                self._advance(cursors, pivot, d)
        return found

    def _advance(self, cursors: list, upto: int, to: int) -> None:
        for c in cursors[: upto + 1]:
            end = self.off[c[2] + 1]
            c[1] = bisect_left(self.items, to, c[1], end)
            c[0] = self.items[c[1]] if c[1] < end else -1
        cursors[:] = [c for c in cursors if c[0] >= 0]

    def _known(self, passage: list[int]) -> set[int]:
        """The distinct runs of the index that a passage holds."""
        w = np.asarray(passage, np.int32)
        starts = np.arange(len(w) - self.run + 1)
        k = np.minimum(np.searchsorted(self.hashes, h := self._hashes(w, starts)), len(self.hashes) - 1)
        ok = self.hashes[k] == h
        for i in range(self.run) if ok.any() else ():
            ok &= self.words[self.at[k] + i] == w[starts + i]
        return set(k[ok].tolist())

    def leaks(self, text: str) -> dict[int, int]:
        """Leaked items of a text, with the number of their runs found in it."""
        out: dict[int, set] = {}
        for p in self.passages(text):
            if hits := self.search(p):
                here = self._known(p)
                for d in hits if here else ():
                    if common := here.intersection(self.run_ids[self.run_off[d] : self.run_off[d + 1]].tolist()):
                        out.setdefault(d, set()).update(common)
        return {d: len(s) for d, s in out.items()}

    def n_runs(self, d: int) -> int:
        return int(self.run_off[d + 1] - self.run_off[d])


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most INDEX_BYTES of text (or one item), read as a stream."""
    rows, size = [], 0
    for r in items.filter("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].encode())
        if rows and size + n > INDEX_BYTES:
            yield rows
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += n
    if rows:
        yield rows


def leaked(spark: SparkSession, documents: DataFrame, items: DataFrame, run: int = 10) -> DataFrame:
    """(doc_id, item_id, n_runs, share): documents that have ``run`` consecutive words of an item.

    ``n_runs`` is the number of the item's distinct runs found, ``share`` their part of all its runs
    (1: the whole item, question and answer).  Null and empty texts and items shorter than a run
    give no rows; repeated rows of a document are one; other columns are ignored.
    """
    schema = "doc_id bigint, item_id bigint, n_runs bigint, share double"
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    parts = []
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(ItemIndex(block, run))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                out = [(d, index.ids[i], n, n / index.n_runs(i)) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for i, n in index.leaks(t).items()]
                if out:
                    yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["doc_id", "item_id", "n_runs", "share"])

        parts.append(docs.mapInArrow(find, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    # The same document may come in several rows, and an item's id under several texts.
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.max("n_runs").alias("n_runs"), F.max("share").alias("share"))
