"""Facts of two extractors made one: fuzzy one-to-one matching and order-dependent merging, article by article."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from operator import concat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.proxy import Model
from ..plans.registry import query
from .prune import ROUNDING, by_article
from .relational import GRAM

THRESHOLD = 0.75


def similarity(a: str, b: str) -> float:
    """1 for equal names whatever the case, else the share of characters in common runs."""
    return 1.0 if a.lower() == b.lower() else SequenceMatcher(None, a.lower(), b.lower()).ratio()


def _place(df: DataFrame) -> Column:
    """The facts' own order, where they have one."""
    return (F.col("position") if "position" in df.columns else F.lit(0)).cast("long").alias("position")


class Partners:
    """The names of one side, by what a good partner must share with them.

    Two strings of together n characters whose ratio reaches t have at least t * n / 2 characters in common runs,
    with at most (1 - t) * n characters outside to separate them, so they share n * (3 t / 2 - 1) - 1 neighbouring
    pairs of characters or more.  Names that share enough pairs are compared, in order of an upper bound of the
    ratio, while it can reach the best so far; where the bound on pairs says nothing, all of fitting length are.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.names: list[str] = []
        self.low: list[str] = []
        self.used: list[bool] = []
        self.equal: dict[str, list[int]] = {}
        self.pairs: dict[str, list[tuple[int, int]]] = {}
        self.by_length: dict[int, list[int]] = {}

    def add(self, name: str | None) -> None:
        j, low = len(self.names), (name or "").lower()
        self.names.append(name)
        self.low.append(low)
        self.used.append(False)
        self.equal.setdefault(low, []).append(j)
        self.by_length.setdefault(len(low), []).append(j)
        for pair, n in Counter(map(concat, low, low[1:])).items():
            self.pairs.setdefault(pair, []).append((j, n))

    def candidates(self, low: str) -> Iterator[int]:
        """Unused names that may reach the threshold."""
        t, n = self.threshold, len(low)
        shared: Counter = Counter()
        for pair, here in Counter(map(concat, low, low[1:])).items():
            for j, there in self.pairs.get(pair, ()):
                if not self.used[j]:
                    shared[j] += min(here, there)
        for length, members in self.by_length.items():
            total = n + length
            if 2 * min(n, length) < t * total - ROUNDING:
                continue
            if total * (1.5 * t - 1) - 1 <= 0:  # so few characters that they may share no pair
                yield from (j for j in members if not self.used[j])
        for j, common in shared.items():
            total = n + len(self.low[j])
            least = total * (1.5 * t - 1) - 1
            if least > 0 and common >= least - ROUNDING and 2 * min(n, total - n) >= t * total - ROUNDING:
                yield j

    def best(self, name: str | None) -> tuple[str, float] | None:
        """The most similar unused name (of equally good ones the first) and its similarity; it is used from then on."""
        low = (name or "").lower()
        top = next(((1.0, -j) for j in self.equal.get(low, ()) if not self.used[j]), None)
        if top is None:
            of = SequenceMatcher(None, low, "")
            bounded = []
            for j in self.candidates(low):
                of.set_seq2(self.low[j])
                bounded.append((of.quick_ratio(), -j))
            for bound, j in sorted(bounded, reverse=True):
                if bound < max(self.threshold, top[0] if top else 0.0):
                    break
                found = (similarity(low, self.low[-j]), j)
                if found[0] >= self.threshold and (top is None or found > top):
                    top = found
        if top is None:
            return None
        j = -top[1]
        self.used[j] = True
        return self.names[j], top[0]


def matched(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(article_id, a, b, similarity) over (article_id, name[, position]): names taken in order of position, then name,
    each with its best unused partner; of equally good ones the first.  An article's right names are held in its task."""
    side = lambda df, k: df.select("article_id", F.lit(k).alias("side"), _place(df), "name")

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        theirs = Partners(threshold)
        for side_, _, name in rows:
            if side_ == 0:
                theirs.add(name)
                continue
            found = theirs.best(name)
            yield (name, *found) if found else (name, None, None)
        yield from ((None, b, None) for b, used in zip(theirs.names, theirs.used, strict=True) if not used)

    return by_article(side(left, 1).unionByName(side(right, 0)), ["side", "position", "name"], work, "a string, b string, similarity double")


@query("j09_fuzzy_match")
def j09(m: Model) -> DataFrame:
    named = m.table("lineitem").join(m.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    named = named.groupBy(F.col("l_orderkey").alias("article_id"), F.col("p_name").alias("name"), "l_returnflag").agg(F.min("l_linenumber").alias("position"))
    return matched(named.where("l_returnflag = 'A'").drop("l_returnflag"), named.where("l_returnflag <> 'A'").drop("l_returnflag"))


#: What a fact may carry besides name, type and confidence.
EXTRAS = {"description": "string", "sources": "array<string>", "wikidata_id": "string"}


class Kept:
    """The names kept so far of one type: finds the first that holds a name or is held by it without a look at the others.

    Held ones are looked up by the name's own pieces, of the lengths that kept names have; holding ones are on the
    list of each piece of the name, of which the shortest is gone through in order.
    """

    def __init__(self):
        self.rows: list[list] = []
        self.names: list[str] = []
        self.first: dict[str, int] = {}
        self.lengths: set[int] = set()
        self.lists: dict[str, list[int]] = {}

    @staticmethod
    def pieces(name: str, size: int) -> set[str]:
        return {name[at : at + size] for at in range(len(name) - size + 1)}

    def add(self, low: str, row: list) -> None:
        k = len(self.rows)
        self.rows.append(row)
        self.names.append(low)
        self.first.setdefault(low, k)
        self.lengths.add(len(low))
        for size in range(1, GRAM + 1):
            for piece in self.pieces(low, size):
                self.lists.setdefault(piece, []).append(k)

    def find(self, low: str) -> list | None:
        if not low:
            return self.rows[0] if self.rows else None
        found = [self.first[piece] for n in self.lengths if n <= len(low) for piece in self.pieces(low, n) if piece in self.first]
        first = min(found, default=None)
        lists = [self.lists.get(piece, ()) for piece in self.pieces(low, min(GRAM, len(low)))]
        for k in min(lists, key=len):
            if first is not None and k >= first:
                break
            if low in self.names[k]:
                first = k
                break
        return None if first is None else self.rows[first]


def merged_names(facts: DataFrame) -> DataFrame:
    """Facts of an article folded, in order of position, into the first of their type that holds their name or is held by it.

    The stored name stays the first seen; confidence is the highest and brings its description, sources are
    joined, an identifier once known stays.  ``merged`` counts the facts.  Columns that the facts lack are null.
    """

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        kept: dict[str, Kept] = {}
        order: list[list] = []
        for _, name, kind, confidence, description, sources, known in rows:
            low = (name or "").lower()
            of_kind = kept.setdefault(kind, Kept())
            k = of_kind.find(low)
            if k is None:
                order.append([name, kind, confidence, description, sources, known, 1])
                of_kind.add(low, order[-1])
                continue
            if (confidence or 0) > (k[2] or 0):
                k[2], k[3] = confidence, description
            k[4] = sorted({*(k[4] or ()), *(sources or ())}) if k[4] or sources else k[4]
            k[5] = k[5] or known
            k[6] += 1
        yield from map(tuple, order)

    extra = [(F.col(c) if c in facts.columns else F.lit(None)).cast(t).alias(c) for c, t in EXTRAS.items()]
    kind = (F.col("type") if "type" in facts.columns else F.lit(None)).cast("string").alias("type")
    given = facts.select("article_id", _place(facts), "name", kind, F.col("confidence").cast("double").alias("confidence"), *extra)
    schema = "name string, type string, confidence double, " + ", ".join(f"{c} {t}" for c, t in EXTRAS.items()) + ", merged int"
    return by_article(given, ["position", F.desc("confidence"), "name"], work, schema)


@query("g16_merged_facts")
def g16(m: Model) -> DataFrame:
    named = m.table("lineitem").join(m.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    return merged_names(
        named.select(
            F.col("l_orderkey").alias("article_id"),
            F.col("l_linenumber").alias("position"),
            F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"),
            F.col("l_linestatus").alias("type"),
            (F.col("l_quantity") / 50.0).alias("confidence"),
            F.array("l_returnflag").alias("sources"),
            F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("Q"), "l_partkey")).alias("wikidata_id"),
        )
    )


def capitalised_spans(texts: DataFrame) -> DataFrame:
    """An offline stand-in for entity recognition: runs of capitalised words inside sentences."""
    found = F.regexp_extract_all("content", F.lit(r"(?<=[a-z,] )(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"), F.lit(1))
    return texts.select("id", F.explode(F.array_distinct(found)).alias("entity"))


@query("g13_capitalised_spans")
def g13(m: Model) -> DataFrame:
    return capitalised_spans(m.texts)
