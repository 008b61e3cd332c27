"""Spelling variants: words at edit distance one, found by a trie self-join with active-node sets, and the forms that they vary.

The vocabulary is partitioned by prefixes.  A pair of words whose longer one has m code points (the other m or
m - 1) either agrees in the first m // 2 code points, or differs there and agrees in the last m - m // 2.  So each
word goes to four partitions: for m its own length and one more, once by its first half and once, read backwards,
by its last half.  In a partition the rest of the words is a trie.  Going down it, every node carries its active
nodes, those whose path is at distance one of its own; a child's set follows from its parent's, and terminal nodes
among the active ones are near words.  Pairs of the backward partitions count only where the first halves differ,
so that no pair is met twice.  A task holds one partition's trie at a time.  Partitions of more than BLOCK words
are dealt to blocks, each two of which meet in a task.  Rows grow with the words: what leaves a task is one row for
each word of a partition (near words and the best of them), never a pair.

Forms point to words of at least RATIO times the count, so chains of forms end after 19 steps at most (counts are
64 bits); roots are found by doubling steps.

Cases: null and empty texts hold no words; a null doc_id counts as an empty one where words are damaged; repeated
rows count each; ties go to the smallest word in code-point order; words of any length are whole, those longer than
LONG_WORD code points are compared within their partition by slices instead of a trie (the same pairs, memory in
proportion to the words).  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, pieces, release, spread_join

#: Fewest code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: How many times a word's count its form has at least.
RATIO = 10
#: Words of a block; a task holds two blocks at most.
BLOCK = 8192
LONG_WORD = 64
LETTERS = "A-Za-zÀ-ÿ"
#: One of so many occurrences' hashes asks for a deletion in ``slipped``.
SLIPS = 31


def slipped(doc_id: Column, run: Column) -> Column:
    """``run`` less one code point, where the hash of document and run says so: misspellings as typists leave them, and reproducible."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % SLIPS == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, slips: bool = False, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the maximal runs of letters of whole texts, A-Z lower-cased, that are long and frequent enough."""
    # A shorter run can't become longer, so the pattern leaves it out; a run of enough letters is matched whole.
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    lower = runs.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), ascii_lower(F.col("run"))).otherwise(F.col("run")).alias("run"))
    words = lower.select(slipped(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= least_length) if slips else lower.select(F.col("run").alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def is_near(v: str, w: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point; by slices, for very long words."""
    if abs(len(v) - len(w)) > 1 or v == w:
        return False
    low, high = 0, min(len(v), len(w))
    while low < high:  # the length of the common beginning
        mid = (low + high + 1) // 2
        low, high = (mid, high) if v.startswith(w[:mid]) else (low, mid - 1)
    return v[low + (len(v) >= len(w)) :] == w[low + (len(w) >= len(v)) :]


class Node:
    """A node of the trie: children by code point, and the number of the word that ends here."""

    __slots__ = ("children", "word")

    def __init__(self):
        self.children: dict[str, Node] = {}
        self.word = -1


def trie_near(rests: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(word, its near words) by number, over distinct ``rests``: the self-join, down the trie with active-node sets."""
    root = Node()
    for k, rest in enumerate(rests):
        node = root
        for c in rest:
            child = node.children.get(c)
            if child is None:
                child = node.children[c] = Node()
            node = child
        node.word = k
    # Of the root the active nodes are its children: one inserted code point.
    stack = [(root, set(root.children.values()))]
    while stack:
        node, active = stack.pop()
        if node.word >= 0:
            near = [a.word for a in active if a.word >= 0]
            if near:
                yield node.word, near
        for c, child in node.children.items():
            # Distance one was there above, or is reached by replacing c, by one code point more or by leaving out c.
            nodes = {a.children[c] for a in active if c in a.children}
            nodes.update(node.children.values(), child.children.values())
            nodes.add(node)
            nodes.discard(child)
            stack.append((child, nodes))


class Unit:
    """The words of a partition, or of two of its blocks, that meet in a task."""

    def __init__(self, backward: bool, m: int, first: int, second: int):
        self.backward, self.m, self.cross = backward, m, first != second
        self.words: list[str] = []
        self.counts: list[int] = []
        self.blocks: list[int] = []

    def near(self) -> Iterator[tuple[str, int, int, str]]:
        """(word, near words, the largest count among them, the first word of that count) of the words that have any."""
        words, counts, m, half = self.words, self.counts, self.m, self.m // 2
        if len(words) < 2 or max(map(len, words)) < m:
            return
        if m > LONG_WORD:
            found = ((i, [j for j, w in enumerate(words) if is_near(v, w)]) for i, v in enumerate(words))
        else:
            found = trie_near([w[: half - m][::-1] if self.backward else w[half:] for w in words])
        for i, near in found:
            word, n, best = words[i], 0, None
            for j in near:
                other = words[j]
                if len(word) < m and len(other) < m:
                    continue  # met where m is their length
                if self.cross and self.blocks[i] == self.blocks[j]:
                    continue
                if self.backward and word[:half] == other[:half]:
                    continue
                n += 1
                if best is None or (-counts[j], other) < best:
                    best = (-counts[j], other)
            if best:
                yield word, n, -best[0], best[1]


NEAR = "word string, n_near long, best_n long, best string"


#: Rows of a batch that leaves a task: units are small, and a batch costs memory of its own.
OUT_ROWS = 4096


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs units one after the other over rows sorted by them."""
    at, unit, held = None, None, []

    def out() -> pa.RecordBatch:
        columns = zip(zip(*held, strict=True), ("string", "int64", "int64", "string"), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["word", "n_near", "best_n", "best"])

    for batch in batches:
        for part in pieces(batch, OUT_ROWS):
            rows = zip(*[c.to_pylist() for c in part.columns], strict=True)
            for key, group in groupby(rows, key=lambda r: r[:5]):
                if key != at:
                    held += unit.near() if unit else ()
                    if len(held) >= OUT_ROWS:
                        yield out()
                        held = []
                    at, unit = key, Unit(key[0], key[1], key[3], key[4])
                for r in group:
                    unit.blocks.append(r[5])
                    unit.words.append(r[6])
                    unit.counts.append(r[7])
    held += unit.near() if unit else ()
    if held:
        yield out()


def partitions(words: DataFrame) -> DataFrame:
    """backward, m, half, word and n: each word in the four partitions where its near words can be."""
    length = F.char_length("word")
    placed = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"))
    p = F.floor(F.col("m") / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(False).alias("backward"), F.substring(F.col("word"), F.lit(1), p).alias("half")),
        F.struct(F.lit(True).alias("backward"), F.substring(F.col("word"), p - F.col("m"), F.col("m")).alias("half")),
    )
    return placed.select("m", F.explode(sides).alias("side"), "word", "n").select("side.backward", "m", "side.half", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best (the near word of largest count) of the words (word, n; unique) that have near words."""
    key = ["backward", "m", "half"]
    placed = partitions(words)
    crowded = materialize(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > BLOCK), "crowded")
    if crowded.first():
        dealt = spread_join(placed, crowded, key, "held", ["held"])
    else:
        dealt = placed.withColumn("held", F.lit(None).cast("long"))
    blocks = F.greatest(F.ceil(F.coalesce("held", F.lit(0)) / BLOCK), F.lit(1)).cast("int")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "word"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    units = dealt.select(*key, F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "word", "n")
    met = units.repartition(*key, "a", "b").sortWithinPartitions(*key, "a", "b").mapInArrow(_near, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("rank"), "best")).alias("top")
    found = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("top.rank")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last of each chain of forms, by doubling steps."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        then = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(steps.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        moved = after.where("moved").limit(1).count()
        release(steps)
        if not moved:
            return after.drop("moved")
        written, steps = after, after.drop("moved")
        steps.written_to = written.written_to


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of a vocabulary (word, n; unique).

    A word's form is its near word of largest count (ties: the smallest), if that is ``ratio`` times its own or more.
    """
    words = materialize(words.select("word", "n"), "words")
    found = words.join(near_words(words), "word", "left")
    formed = F.col("best_n") >= ratio * F.col("n")
    named = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    named = materialize(named, "named")
    release(words)
    last = roots(named.where("form is not null"))
    return named.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
