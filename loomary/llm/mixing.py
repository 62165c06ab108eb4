"""Mixing sources to target weights, by hierarchical token budgets and seeded epochs.

The leaves of a tree (by default domain, then language, then source) hold the documents.  A source's
target weight is spread over its leaves by the tokens they have and propagates up, so that every
node's weight is the sum of its leaves'.  Budgets come down by weight; what a node can't supply (its
tokens times its permitted repeats) goes to its siblings first, and only what a whole family can't
supply goes to its ancestor's siblings.  Without a total, the largest one is taken at which all
sources that have documents meet their shares; then nothing is short.  A larger total runs short of
small sources and shares them out.

A leaf with a budget of e whole epochs and a rest takes every document e times and, of the next
epoch's seeded order, the longest prefix that fits the rest.  What these prefixes leave unspent (less
than a document a leaf) is pooled within each source and given to its largest leaf.

The order is that of a hash, so a prefix is found by adding up tokens per slice of the hash range (a
fixed number of slices a leaf), again within the slice in which the budget ends, and sorting only
the documents of one slice of a slice.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from math import floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import code, norm_id
from ..session import Scratch
from .tokenizers import VOCABULARY, count_tokens

#: Levels of the tree from the top; each is a column of the sized documents, one is the source.
LEVELS = ("domain", "lang", "source")
#: Bits of a document's place that name its slice, and its slice within that.
PLACE, SLICE, SUB = 63, 12, 24
#: Domain of sources that none is given for.
NO_DOMAIN = "all"


@dataclass
class Node:
    """A node of the budget tree: its weight among siblings, and the tokens it can supply."""

    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0

    def add(self, path: Iterable[str], weight: float, capacity: float) -> None:
        """A leaf at a path; its weight and capacity count for all nodes on the way."""
        self.weight += weight
        self.capacity += capacity
        head, *rest = [*path, None]
        if head is not None:
            self.children.setdefault(head, Node()).add(rest[:-1], weight, capacity)

    def spend(self, budget: float) -> None:
        """Divide a budget among the children by weight, shortages going to siblings with room."""
        self.budget = min(budget, self.capacity)
        open_, left = {k: c for k, c in self.children.items() if c.capacity > 0 and c.weight > 0}, self.budget
        shares = dict.fromkeys(open_, 0.0)
        while open_ and left > 1e-9:
            total = sum(c.weight for c in open_.values())
            full = [k for k, c in open_.items() if left * c.weight / total >= c.capacity]
            if not full:
                shares |= {k: left * c.weight / total for k, c in open_.items()}
                break
            for k in full:
                shares[k] = open_[k].capacity
                left -= open_.pop(k).capacity
        for k, b in shares.items():
            self.children[k].spend(b)

    def leaves(self, path: tuple = ()) -> Iterable[tuple[tuple, Node]]:
        if not self.children:
            yield path, self
        for k, c in self.children.items():
            yield from c.leaves((*path, k))


def budgets(leaves: dict[tuple, int], source_at: int, targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[tuple, tuple[int, int]]:
    """(tokens to take, most that can be taken) by path of the tree.

    ``leaves`` holds the tokens there are, once each; ``targets`` a source's share and most repeats;
    ``source_at`` is the place of the source in a path.
    """
    has: dict[str, int] = {}
    for path, n in leaves.items():
        has[path[source_at]] = has.get(path[source_at], 0) + n
    able = {s: (w, max(0, r or 0)) for s, (w, r) in targets.items() if w and w > 0 and has.get(s) and r and r > 0}
    root = Node()
    for path, n in sorted(leaves.items()):
        if path[source_at] in able:
            w, r = able[path[source_at]]
            root.add(path, w * n / has[path[source_at]], float(n) * r)
    if total is None:  # the most at which every source meets its share
        weight = sum(w for w, _ in able.values())
        total = min((has[s] * r * weight / w for s, (w, r) in able.items()), default=0.0)
    root.spend(total)
    # whole tokens; the division of a budget may leave it a rounding error short of what a leaf holds
    return {path: (floor(leaf.budget * (1 + 1e-12) + 1e-6), int(leaf.capacity)) for path, leaf in root.leaves() if path}


def language(c):
    """The main language tag; unknown and missing ones are ``und``."""
    tag = F.regexp_extract(norm_id(c), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag).otherwise("und")


def sized_documents(spark: SparkSession, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, domains: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens) of documents of the targets' sources that have any token.

    ``domains`` names the domain of a source.
    """
    wanted = targets.select(code(F.col("source")).alias("source")).filter("source is not null").distinct()
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", code(F.col("source")).alias("source"), language(F.col("lang")).alias("lang"), "text")
    sized = count_tokens(spark, docs.join(wanted, "source", "left_semi"), vocabulary=vocabulary).filter("n_tokens > 0")
    one = sized.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source", "lang")).alias("d")).select("doc_id", "d.source", "d.lang", "d.n_tokens")
    domain: Column = F.lit(NO_DOMAIN)
    for s, d in sorted((domains or {}).items()):
        domain = F.when(F.col("source") == s, d).otherwise(domain)
    return one.withColumn("domain", domain).select("doc_id", "domain", "lang", "source", "n_tokens")


def _placed(sized: DataFrame, levels: tuple[str, ...], plan: dict[tuple, tuple[int, int]], seed: int) -> DataFrame:
    """Documents with their leaf's whole epochs and rest, and their place in the next epoch's order."""
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in levels], T.StructField("epochs", T.LongType()), T.StructField("rest", T.LongType())])
    rows = sized.sparkSession.createDataFrame([(*k, *v) for k, v in plan.items()], schema)
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epochs", "doc_id"), 64 - PLACE)
    return sized.join(F.broadcast(rows), list(levels)).withColumn("place", place)


def _ends(rows: DataFrame, leaf: list[str]) -> DataFrame:
    """(*leaf, base, cut, spent): of each leaf all places below ``base`` and up to ``cut`` are taken; null base: all."""

    def first_over(slices: DataFrame, start: Column) -> DataFrame:
        w = Window.partitionBy(*leaf).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
        upto = slices.withColumn("upto", start + F.sum("t").over(w))
        return upto.filter("upto > rest").groupBy(*leaf, "rest").agg(F.min("slice").alias("last"), F.min_by(F.col("upto") - F.col("t"), "slice").alias("before"))

    top, sub = F.shiftright("place", PLACE - SLICE), F.shiftright("place", PLACE - SUB)
    one = rows.groupBy(*leaf, "rest", top.alias("slice")).agg(F.sum("n_tokens").alias("t"))
    in_one = first_over(one, F.lit(0))
    inside = rows.join(F.broadcast(in_one.drop("rest")), leaf).filter(top == F.col("last"))
    two = inside.groupBy(*leaf, "rest", "before", sub.alias("slice")).agg(F.sum("n_tokens").alias("t"))
    in_two = first_over(two, F.col("before"))
    ending = inside.drop("last", "before").join(F.broadcast(in_two.drop("rest")), leaf).filter(sub == F.col("last"))
    w = Window.partitionBy(*leaf).orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = ending.withColumn("upto", F.col("before") + F.sum("n_tokens").over(w)).filter("upto <= rest")
    cut = fits.groupBy(*leaf).agg(F.max(F.struct("place", "doc_id")).alias("cut"), F.max("upto").alias("upto"))
    base = in_two.select(*leaf, F.shiftleft("last", PLACE - SUB).alias("base"), "before").join(cut, leaf, "left")
    return base.select(*leaf, "base", "cut", F.coalesce("upto", "before").alias("spent"))


def mix(
    spark: SparkSession, documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, vocabulary: str = VOCABULARY,
    domains: dict[str, str] | None = None, levels: tuple[str, ...] = LEVELS, corpora: float | None = None,
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, repeats): the selection, each document with its number of uses.

    ``total`` is the wanted number of tokens, or ``corpora`` as a multiple of the tokens there are.
    Sources are compared without case, outer blanks, and hyphens for underscores.  Sources without
    documents leave their share to the others; documents of sources without a target, of null
    source or without text are not used.  Repeated rows of a document are one.

    The driver reads the targets and one sum per leaf: at most the targets' sources times the
    language tags (two or three letters), whatever the documents hold.
    """
    scratch = Scratch(spark, "mix")
    sized = scratch.save(sized_documents(spark, documents, targets, vocabulary, domains), "sized")
    leaf = list(levels)
    want = {r[0]: (r[1], r[2]) for r in targets.select(code(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).filter("source is not null").collect()}
    tokens = {tuple(r)[:-1]: r[-1] for r in sized.groupBy(*leaf).agg(F.sum("n_tokens")).collect()}
    at = levels.index("source")
    wanted = budgets(tokens, at, want, total if corpora is None else corpora * sum(tokens.values()))
    take = {k: b for k, (b, _) in wanted.items()}
    plan = lambda: {k: divmod(b, tokens[k]) for k, b in take.items()}
    spent = {tuple(r)[:-1]: r[-1] for r in _ends(_placed(sized, levels, plan(), seed), leaf).select(*leaf, "spent").collect()}
    left: dict[str, int] = {}
    for k, (_, rest) in plan().items():
        left[k[at]] = left.get(k[at], 0) + rest - spent.get(k, rest)
    for s, rest in left.items():
        k = max((k for k in take if k[at] == s), key=lambda k: (take[k], k))
        own = plan()[k][1]
        take[k] = min(wanted[k][1], take[k] + rest - (own - spent.get(k, own)))
    rows = _placed(sized, levels, plan(), seed)
    ends = _ends(rows, leaf).select(*leaf, "base", "cut", F.lit(True).alias("ends"))
    placed = rows.join(F.broadcast(ends), leaf, "left")
    here = F.struct("place", "doc_id")
    more = F.when(F.col("ends").isNull(), F.col("rest") > 0).otherwise((F.col("place") < F.col("base")) | F.coalesce(here <= F.col("cut"), F.lit(False)))
    return placed.select("doc_id", "domain", "lang", "source", "n_tokens", (F.col("epochs") + more.cast("bigint")).alias("repeats")).filter("repeats > 0")


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_documents, n_tokens, most_used, actual_share) of every target."""
    got = selection.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_used"))
    all_ = got.agg(F.sum("n_tokens").alias("_all"))
    rows = targets.select(code(F.col("source")).alias("source"), "target_share", "max_repeats").join(got, "source", "left").join(F.broadcast(all_))
    return rows.select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "n_tokens", "most_used")], F.coalesce(F.try_divide("n_tokens", "_all"), F.lit(0.0)).alias("actual_share"))
