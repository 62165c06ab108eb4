"""Subject areas of documents, by interpolated n-gram language models per subject and language.

A model is trained for each subject within each language from hand-labelled documents, against a
background model of that language: bigrams interpolated with unigrams and the background.  A
sentence's per-token cross-entropy under each subject is compared with that under the background;
it deals with the best subject if the gain reaches a calibrated bound.  A document's subjects are
those of at least a given share of its sentences.

Only the subject models rest on a sample: at most ``MAX_LABELLED`` labelled documents (and
``MAX_CHARS`` characters of them), drawn by hash, which also give the vocabulary.  Everything else is
counted over all documents: the languages, the words by which a document's language is told, the
background's words and bigrams, and the spread of gains that scales the bound.  Documents are
encoded once into a table of word numbers; all passes read that.

Labels are of documents and partly wrong, so training re-estimates which sentences of a labelled
document deal with its subjects (a few rounds of expectation and maximisation, with a preference
for the labels).  A quarter of the labelled documents is held out to choose the bound at which the
subjects found agree best with the labels, several subjects a document included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_id
from ..session import Scratch
from .mixing import language
from .sums import summed

#: Labelled documents used for training, and characters of them (at least one document is).
MAX_LABELLED, MAX_CHARS = 12_000, 40_000_000
#: Least occurrences of a bigram in the training documents that is modelled by itself.
LEAST_BIGRAM = 3
#: Share of the documents that must carry a language's tag.
LANGUAGE_SHARE = 0.02
#: Weights of the bigram and unigram models; the rest is the background's.
W2, W1 = 0.25, 0.25
#: Tokens of the background that smooth a subject's counts, rounds, and log preference for a label.
SMOOTH, ROUNDS, PREFER = 60.0, 5, 0.7
#: Share of its sentences that a document's subject must have, and the subject that yields to others.
SHARE, LAST_RESORT = 0.2, "smalltalk"
#: Bins of the histogram of gains and their width; the last takes what lies above.
BINS, WIDTH = 4000, 0.002
#: Every how many labelled documents one is held out, and the bounds tried, as parts of the valley of gains.
HOLD, TRIED = 4, tuple(x / 40 for x in range(2, 41))
#: Tokens scored at a time.
SLICE = 1 << 18

_TOKEN = re.compile(r"[^\W\d_]+|[.!?…](?=\s)|\n")
_ENDS = frozenset(".!?…\n")
UNKNOWN, END = -1, -2


def new_vocabulary() -> dict[str, int]:
    """Word ids; the marks that end a sentence are among them, and no words."""
    return dict.fromkeys(_ENDS, END)


def n_words(vocabulary: dict[str, int]) -> int:
    """Ids in use, with one for unknown words."""
    return len(vocabulary) - len(_ENDS) + 1


def encode(text: str, vocabulary: dict[str, int], grow: bool = False) -> np.ndarray:
    """Word ids with END after each sentence; a line end ends a sentence too."""
    toks = _TOKEN.findall(text.lower())
    if grow:
        out = [vocabulary.setdefault(t, len(vocabulary) - len(_ENDS)) for t in toks]
    else:
        get = vocabulary.get
        out = [get(t, UNKNOWN) for t in toks]
    out.append(END)
    return np.array(out, np.int32)


def _flat(batch: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, document, sentence) of all words of a batch; unknown words are the last id."""
    ids = np.concatenate(batch) if batch else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(batch)), [len(d) for d in batch])
    end = ids == END
    sent = np.cumsum(end) - end
    keep = ~end
    ids = ids[keep].astype(np.int64)
    return np.where(ids < 0, words - 1, ids), doc[keep], sent[keep]


def _sums(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, sum) of each run of equal groups."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return first, np.add.reduceat(x, first)


def _language_of(tongue: np.ndarray, ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The language of each document: the one whose words it is made of, since tags may be wrong."""
    out = np.zeros(n, np.int64)
    if len(ids):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[first]] = np.stack([np.add.reduceat(t[ids], first) for t in tongue]).argmax(0)
    return out


def tongue_counts(batch: list[np.ndarray], tags: list[str], languages: list[str], words: int, total: np.ndarray) -> None:
    """Add the words of documents to (language by tag, word) counts."""
    at = {g: i for i, g in enumerate(languages)}
    known = [(d, at[t]) for d, t in zip(batch, tags, strict=True) if t in at]
    ids, doc, _ = _flat([d for d, _ in known], words)
    total += np.bincount(np.array([g for _, g in known], np.int64)[doc] * words + ids, minlength=len(total))


def tongues(counts: np.ndarray, languages: list[str]) -> np.ndarray:
    """Log probability of each word in each language; one the labelled documents don't have tells nothing."""
    c = counts.reshape(len(languages), -1) + 0.5
    out = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)
    out[:, -1] = out.min() if out.shape[1] > 1 else 0.0
    return out


def background_counts(batch: list[np.ndarray], tongue: np.ndarray, keys: np.ndarray, total: np.ndarray) -> None:
    """Add the words, the words followed by another, and the known bigrams of each language."""
    words, size = tongue.shape[1], tongue.size
    ids, doc, sent = _flat(batch, words)
    at = _language_of(tongue, ids, doc, len(batch))[doc] * words + ids
    total[:size] += np.bincount(at, minlength=size)
    inside = np.flatnonzero(sent[1:] == sent[:-1])
    total[size : 2 * size] += np.bincount(at[inside], minlength=size)
    if len(keys):
        pair = at[inside] * words + ids[inside + 1]
        k = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        total[2 * size :] += np.bincount(k[keys[k] == pair], minlength=len(keys))


@dataclass
class Model:
    """Log ratios of subject to background, per language and word or bigram."""

    subjects: list[str]
    vocabulary: dict[str, int] = field(repr=False)
    tongue: np.ndarray = field(repr=False)  # (languages, words + 1): log probability of a word
    uni: np.ndarray = field(repr=False)  # (subjects, languages * (words + 1))
    keys: np.ndarray = field(repr=False)  # sorted bigram keys
    bi: np.ndarray = field(repr=False)  # (subjects, bigrams)
    bound: float = 0.0

    def sentences(self, batch: list[np.ndarray], lang: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all sentences with a word: document, best subject, and its gain per token.

        ``lang`` gives the documents' languages; where it is negative or None, their words tell it.
        """
        words = self.tongue.shape[1]
        ids, doc, sent = _flat(batch, words)
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        own = _language_of(self.tongue, ids, doc, len(batch))
        lang = own if lang is None else np.where(lang < 0, own, lang)
        at = lang[doc] * words + ids
        inside = np.flatnonzero(sent[1:] == sent[:-1])
        where = k = np.zeros(0, np.int64)
        if len(self.keys):
            pair = at[inside] * words + ids[inside + 1]
            k = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = self.keys[k] == pair
            where, k = inside[hit] + 1, k[hit]
        first = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]])
        n = np.diff(np.r_[first, len(ids)])
        best, most = np.zeros(len(first), np.int64), np.full(len(first), -np.inf)
        for x in range(len(self.subjects)):
            gain = self.uni[x][at]
            gain[where] = self.bi[x][k]
            total = np.add.reduceat(gain, first) / n
            better = total > most
            best[better], most[better] = x, total[better]
        return doc[first], best, most

    def pieces(self, batch: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """(documents, their numbers in the batch, their languages) of about SLICE tokens each.

        A longer document comes in pieces cut at sentence ends, all in the language of the whole; that
        of others is -1 (not told yet).
        """
        now, which, size = [], [], 0
        lone = lambda d: _language_of(self.tongue, *_flat([d], self.tongue.shape[1])[:2], 1)[0]
        langs: list[int] = []
        for i, d in enumerate(batch):
            parts, g = [d], -1
            if len(d) > SLICE:
                g = lone(d)
                ends = np.flatnonzero(d == END) + 1
                cuts = np.unique(ends[np.minimum(np.searchsorted(ends, np.arange(SLICE, len(d), SLICE)), len(ends) - 1)])
                parts = [p for p in np.split(d, cuts) if len(p)]
            for p in parts:
                if now and size + len(p) > SLICE:
                    yield now, np.array(which), np.array(langs)
                    now, which, langs, size = [], [], [], 0
                now.append(p)
                which.append(i)
                langs.append(g)
                size += len(p)
        if now:
            yield now, np.array(which), np.array(langs)

    def scored(self, batch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``sentences`` of documents of any length."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for docs, which, langs in self.pieces(batch):
            doc, best, gain = self.sentences(docs, langs)
            out.append((which[doc], best, gain))
        doc, best, gain = (np.concatenate(x) for x in zip(*out, strict=True))
        return doc, best, gain

    def shares(self, n: int, doc: np.ndarray, best: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """(documents x subjects) shares of the sentences of ``n`` documents."""
        hits = np.zeros((n, len(self.subjects)))
        ok = (gain >= self.bound) & (gain > 0)
        np.add.at(hits, (doc[ok], best[ok]), 1)
        return hits / np.maximum(np.bincount(doc, minlength=n), 1)[:, None]

    def accepted(self, n: int, doc: np.ndarray, best: np.ndarray, gain: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
        """(documents x subjects) whether a document deals with a subject, and the shares."""
        part = self.shares(n, doc, best, gain)
        ok = part >= share - 1e-9
        last = next((i for i, s in enumerate(self.subjects) if s.strip().lower() == LAST_RESORT), -1)
        if last >= 0:
            ok[ok.sum(1) > 1, last] = False
        return ok, part


def histogram(gain: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip(gain / WIDTH, 0, BINS - 1).astype(np.int64), minlength=BINS)


@dataclass
class Sample:
    """Labelled documents: encoded texts, language tags, and labels (documents x subjects)."""

    docs: list[np.ndarray]
    tags: list[str]
    labels: np.ndarray
    vocabulary: dict[str, int]

    @classmethod
    def of(cls, rows: list[tuple[str, str, list[str]]], subjects: list[str]) -> Sample:
        vocabulary = new_vocabulary()
        docs = [encode(t, vocabulary, True) for t, _, _ in rows]
        index = {x: i for i, x in enumerate(subjects)}
        labels = np.zeros((len(rows), len(subjects)), np.float32)
        for i, (_, _, ls) in enumerate(rows):
            for x in ls:
                if x in index:
                    labels[i, index[x]] = 1
        return cls(docs, [g for _, g, _ in rows], labels, vocabulary)

    def part(self, held: bool) -> Sample:
        at = [i for i in range(len(self.docs)) if (i % HOLD == HOLD - 1) == held]
        return Sample([self.docs[i] for i in at], [self.tags[i] for i in at], self.labels[at], self.vocabulary)

    def bigrams(self, tongue: np.ndarray) -> np.ndarray:
        """Sorted keys of the bigrams seen often enough."""
        words = tongue.shape[1]
        ids, doc, sent = _flat(self.docs, words)
        if not len(ids):
            return np.zeros(0, np.int64)
        at = _language_of(tongue, ids, doc, len(self.docs))[doc] * words + ids
        inside = np.flatnonzero(sent[1:] == sent[:-1])
        keys, n = np.unique(at[inside] * words + ids[inside + 1], return_counts=True)
        return keys[n >= LEAST_BIGRAM]


def _ratios(counts: np.ndarray, background: np.ndarray, w: float) -> np.ndarray:
    """log((w p_s + (1 - w) p_b) / p_b) of each word of a language under a subject."""
    p = (counts + SMOOTH * background) / (counts.sum() + SMOOTH)
    return np.log(w * p / background + 1 - w).astype(np.float32)


def fit(s: Sample, subjects: list[str], tongue: np.ndarray, keys: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Subject models of labelled documents against the corpus counts of ``background_counts``."""
    n_lang, words = tongue.shape
    size, k = tongue.size, len(subjects)
    m = Model(subjects, s.vocabulary, tongue, np.zeros((k, size), np.float32), np.zeros(0, np.int64), np.zeros((k, 0), np.float32))
    ids, doc, sent = _flat(s.docs, words)
    if not len(ids) or not k:
        return m
    lang = _language_of(tongue, ids, doc, len(s.docs))
    at = lang[doc] * words + ids
    background = counts[:size].reshape(n_lang, words) + 0.05
    background = background / background.sum(1, keepdims=True)
    first = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]])
    n = np.diff(np.r_[first, len(ids)])
    of_sent, row = doc[first], np.repeat(np.arange(len(first)), n)
    soft = (s.labels / np.maximum(s.labels.sum(1, keepdims=True), 1))[of_sent]
    cap = _support(at, doc, lang, s.labels, size, words)
    for _ in range(rounds):
        gain = np.zeros((len(first), k), np.float32)
        for x in range(k):
            mine = np.flatnonzero(np.repeat(soft[:, x] > 0, n))
            c = np.bincount(at[mine], weights=soft[row[mine], x], minlength=size).reshape(n_lang, words)
            for g in range(n_lang):
                m.uni[x, g * words : (g + 1) * words] = _ratios(c[g], background[g], W1 + W2)
            np.minimum(m.uni[x], cap[x], out=m.uni[x])
            gain[:, x] = np.add.reduceat(m.uni[x][at], first)
        best = (gain + PREFER * s.labels[of_sent]).argmax(1)
        soft = np.zeros_like(soft)
        ok = gain[np.arange(len(best)), best] > np.log(1 + 3 * (W1 + W2))  # as much as one word that is four times as likely
        soft[ok, best[ok]] = 1
    if len(keys):
        _bigrams(m, at, ids, sent, row, soft, background, keys, counts)
    return m


def _support(at: np.ndarray, doc: np.ndarray, lang: np.ndarray, labels: np.ndarray, size: int, words: int) -> np.ndarray:
    """The most that a word's log ratio may be, by the labels of the documents that hold it.

    Phrases found under every label would else drift to some subject as sentences are reassigned.
    Two standard deviations below the observed number of a label's documents count.
    """
    pairs = np.unique(doc.astype(np.int64) * size + at)
    d, w = pairs // size, pairs % size
    seen = np.bincount(w, minlength=size)
    n_lang = np.bincount(lang, minlength=size // words)
    out = np.zeros((labels.shape[1], size), np.float32)
    for x in range(labels.shape[1]):
        got = np.bincount(w, weights=labels[d, x], minlength=size)
        of = np.bincount(lang, weights=labels[:, x], minlength=len(n_lang))
        expected = seen * np.repeat(of / np.maximum(n_lang, 1), words)
        low = (got - 2 * np.sqrt(np.maximum(expected, 1e-9))) / np.maximum(expected, 1e-9)
        out[x] = np.log(1 + (W1 + W2) * (np.clip(low, 1, 1e6) - 1))
    return out


def _bigrams(m: Model, at: np.ndarray, ids: np.ndarray, sent: np.ndarray, row: np.ndarray, soft: np.ndarray, background: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
    """Ratios of the modelled bigrams, interpolated with their last word's."""
    words, size = m.tongue.shape[1], m.tongue.size
    inside = np.flatnonzero(sent[1:] == sent[:-1])
    pair = at[inside] * words + ids[inside + 1]
    k = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    hit = keys[k] == pair
    head, word = keys // words, keys % words
    lang = head // words
    p1 = background[lang, word]
    p2 = np.maximum(counts[2 * size :], 1) / np.maximum(counts[size : 2 * size][head], 1)
    base = W2 * p2 + (1 - W2) * p1
    m.keys, m.bi = keys, np.zeros((len(m.subjects), len(keys)), np.float32)
    for x in range(len(m.subjects)):
        mine = soft[row[inside], x]
        on = np.flatnonzero(mine)
        c2 = np.bincount(k[on][hit[on]], weights=mine[on][hit[on]], minlength=len(keys))
        c1 = np.bincount(at[inside[on]], weights=mine[on], minlength=size)[head]
        s2 = (c2 + SMOOTH / 10 * p2) / (c1 + SMOOTH / 10)
        s1 = ((np.exp(m.uni[x][lang * words + word]) - 1 + (W1 + W2)) / (W1 + W2)) * p1
        m.bi[x] = np.clip(np.log((W2 * s2 + W1 * s1 + (1 - W1 - W2) * p1) / base), -3, 3)


def valley(h: np.ndarray) -> float:
    """The gain between sentences with a subject and without: least within-class variance (Otsu) up to the 99th percentile."""
    if not h.any():
        return 0.0
    top = int(np.searchsorted(np.cumsum(h), 0.99 * h.sum())) + 1
    h = np.r_[h[: top - 1], h[top - 1 :].sum()]
    mid = (np.arange(top) + 0.5) * WIDTH
    w0, s0 = np.cumsum(h), np.cumsum(h * mid)
    w1, s1 = w0[-1] - w0, s0[-1] - s0
    between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / np.maximum(w0, 1) - s1 / np.maximum(w1, 1)) ** 2, 0)
    return float((int(between.argmax()) + 1) * WIDTH)


def calibrated(m: Model, held: Sample, scale: float) -> float:
    """The bound, as a part of ``scale``, at which the subjects of held-out documents agree best with their labels.

    Agreement is F1 over pairs of document and subject.  Of a plateau (within a thousandth of the
    best) the middle is taken; without held-out labels a quarter.
    """
    want = held.labels > 0
    if not want.any() or scale <= 0:
        return scale / 4
    scores, sentences = [], m.scored(held.docs)
    for part in TRIED:
        m.bound = part * scale
        ok, _ = m.accepted(len(held.docs), *sentences)
        scores.append(2 * (ok & want).sum() / max(1, ok.sum() + want.sum()))
    good = [p for p, f in zip(TRIED, scores, strict=True) if f >= max(scores) - 0.001]
    return good[len(good) // 2] * scale


def train(rows: list[tuple[str, str, list[str]]], subjects: list[str], rounds: int = ROUNDS) -> Model:
    """Fit on (text, language tag, labels) with the labelled documents themselves as the corpus."""
    s = Sample.of(rows, subjects)
    words = n_words(s.vocabulary)
    langs = frequent(dict(zip(*np.unique(s.tags, return_counts=True), strict=True)) if s.tags else {})
    total = np.zeros(len(langs) * words, np.int64)
    tongue_counts(s.docs, s.tags, langs, words, total)
    tongue = tongues(total, langs)
    keys = s.bigrams(tongue)
    counts = np.zeros(2 * tongue.size + len(keys), np.int64)
    background_counts(s.docs, tongue, keys, counts)
    m = fit(s, subjects, tongue, keys, counts, rounds)
    m.bound = calibrated(fit(s.part(False), subjects, tongue, keys, counts, rounds), s.part(True), valley(histogram(m.scored(s.docs)[2])))
    return m


def frequent(tags: dict[str, int]) -> list[str]:
    """Languages: tags that enough of the documents carry."""
    n = sum(tags.values())
    return sorted(g for g, c in tags.items() if g != "und" and c >= max(1, LANGUAGE_SHARE * n)) or ["und"]


def labelled(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, chars: int = MAX_CHARS) -> list[tuple[str, str, list[str]]]:
    """At most ``limit`` labelled documents with text and ``chars`` characters, in the order of a hash, to the driver."""
    by_doc = labels.filter("doc_id is not null").select("doc_id", norm_id(F.col("subject")).alias("subject")).filter("subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    drawn = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.select("doc_id", "text", language(F.col("lang")).alias("lang")).filter("text is not null").join(F.broadcast(drawn), "doc_id")  # at most ``limit`` small rows
    out, size = [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "lang", "subjects").toLocalIterator():
        size += len(r["text"])
        if out and size > chars:
            break
        out.append((r["text"], r["lang"], sorted(r["subjects"])))
    return out


def _ids(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in b.column("ids").to_pylist()]


def encoded(scratch: Scratch, documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, tag, ids): all documents with text as word numbers, written once."""
    sent = scratch.spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode(t, sent.value).tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("tag"), pa.array(ids, pa.binary())], names=["doc_id", "tag", "ids"])

    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", language(F.col("lang")).alias("tag"), "text")
    return scratch.save(docs.mapInArrow(run, "doc_id bigint, tag string, ids binary"), "encoded")


def scored(scratch: Scratch, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, best, gain): of each document of ``encoded`` the best subject of every sentence and its gain, written once."""
    sent = scratch.spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, best, gain = sent.value.scored(_ids(b))
            cuts = np.cumsum(np.bincount(doc, minlength=b.num_rows))[:-1]
            part = lambda x, kind: pa.array([y.tobytes() for y in np.split(x.astype(kind), cuts)], pa.binary())
            yield pa.record_batch([b.column("doc_id"), part(best, np.uint16), part(gain, np.float32)], names=["doc_id", "best", "gain"])

    return scratch.save(docs.mapInArrow(run, "doc_id bigint, best binary, gain binary"), "scored")


def _gains(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("gain").to_pylist()), np.float32)


def classify(rows: DataFrame, model: Model, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share): the subjects of each document of ``scored``.

    ``LAST_RESORT`` only stands where there is no other subject.  Null and empty texts and those
    without a word have none; repeated rows of a document are one.
    """
    small = Model(model.subjects, {}, *[np.zeros((0, 0))] * 4, bound=model.bound)  # the decision needs no words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [np.frombuffer(x, np.uint16) for x in b.column("best").to_pylist()]
            doc = np.repeat(np.arange(len(best)), [len(x) for x in best])
            ok, part = small.accepted(len(best), doc, np.concatenate([np.zeros(0, np.uint16), *best]).astype(np.int64), _gains(b), share)
            d, s = np.nonzero(ok)
            yield pa.record_batch({"doc_id": b.column("doc_id").take(pa.array(d)), "subject": pa.array(np.asarray(small.subjects, object)[s], pa.string()), "share": pa.array(part[d, s])})

    return rows.mapInArrow(run, "doc_id bigint, subject string, share double").groupBy("doc_id", "subject").agg(F.max("share").alias("share"))


def trained(scratch: Scratch, docs: DataFrame, sample: Sample, subjects: list[str]) -> tuple[Model, DataFrame]:
    """The model of a sample against all encoded documents, and the documents scored by it."""
    sc = docs.sparkSession.sparkContext
    words = n_words(sample.vocabulary)
    langs = frequent({r[0]: r[1] for r in docs.groupBy("tag").agg(F.count("*")).collect()})  # language tags have at most three letters

    def tell(b: pa.RecordBatch, total: np.ndarray) -> None:
        tongue_counts(_ids(b), b.column("tag").to_pylist(), langs, words, total)

    tongue = tongues(summed(docs.select("tag", "ids"), tell, len(langs) * words), langs)
    keys = sample.bigrams(tongue)
    shared = sc.broadcast((tongue, keys))

    def back(b: pa.RecordBatch, total: np.ndarray) -> None:
        background_counts(_ids(b), *shared.value, total)

    def spread(b: pa.RecordBatch, total: np.ndarray) -> None:
        total += histogram(_gains(b))

    counts = summed(docs.select("ids"), back, 2 * tongue.size + len(keys))
    model = fit(sample, subjects, tongue, keys, counts)
    rows = scored(scratch, docs, model)
    scratch.drop(docs)
    model.bound = calibrated(fit(sample.part(False), subjects, tongue, keys, counts), sample.part(True), valley(summed(rows.select("gain"), spread, BINS)))
    return model, rows


def subject_areas(spark: SparkSession, documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """Train on the labelled documents and classify all; subjects are spelled as in ``subjects``."""
    spelled = {r[0]: r[1] for r in subjects.filter("subject is not null").groupBy(norm_id(F.col("subject")).alias("k")).agg(F.min("subject")).filter("k is not null").collect()}
    names = sorted(spelled)
    sample, scratch = Sample.of(labelled(documents, labels), names), Scratch(spark, "subjects")
    model, rows = trained(scratch, encoded(scratch, documents, sample.vocabulary), sample, names)
    model.subjects = [spelled[n] for n in names]
    return classify(rows, model)


def composition(areas: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, n_documents, n_chars) of a corpus; a document of several subjects counts equally for each.

    Documents without a subject are the row of a null subject.
    """
    sizes = documents.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    several = areas.groupBy("doc_id").agg(F.count("*").alias("k"), F.collect_set("subject").alias("s"))
    rows = sizes.join(several, "doc_id", "left").select("chars", F.coalesce("k", F.lit(1)).alias("k"), F.explode_outer("s").alias("subject"))
    return rows.groupBy("subject").agg(F.round(F.sum(1 / F.col("k")), 6).alias("n_documents"), F.round(F.sum(F.col("chars") / F.col("k")), 3).alias("n_chars"))
