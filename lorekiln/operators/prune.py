"""Keeping the edges that matter: percentiles, top-k of either end, fallbacks, degree caps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scores import SIZES, size_class
from ..plans.proxy import Model, over
from ..plans.registry import query
from ..plans.shared import materialize, release
from .relational import entity_pairs


def edges_of(m: Model) -> DataFrame:
    """The model's edges: an article's pairs, scored by mean confidence."""
    return entity_pairs(m.facts).select("article_id", F.col("entity_a").alias("source"), F.col("entity_b").alias("target"), F.round((F.col("confidence_a") + F.col("confidence_b")) / 2, 6).alias("score"))


_EDGES = "edges AS (SELECT a.article_id, a.entity AS source, b.entity AS target, round((a.confidence + b.confidence) / 2, 6) AS score FROM facts a JOIN facts b ON a.article_id = b.article_id AND a.entity < b.entity)"


def top_k_edges(edges: DataFrame, k: int = 10, min_nodes: int = 10) -> DataFrame:
    """Edges among the k strongest of either endpoint, in graphs of more than ``min_nodes`` nodes; smaller graphs stay whole.

    Ties in score go by raw_count, then confidence, where the edges have those columns, then by name.  One
    shuffle puts articles together; ranks, counts and the choice between both ends need no other.
    """
    strongest = [F.desc(c) for c in ("score", "raw_count", "confidence") if c in edges.columns]
    ends = edges.repartition("article_id").select("*", F.explode(F.array("source", "target")).alias("node"))
    rank = F.row_number().over(Window.partitionBy("article_id", "node").orderBy(*strongest, "source", "target"))
    nodes = ends.groupBy("article_id", "node").agg(F.lit(1).alias("one")).groupBy("article_id").agg(F.count("one").alias("nodes"))
    ranked = ends.withColumn("rank", rank).join(nodes, "article_id").where((F.col("rank") <= k) | (F.col("nodes") <= min_nodes))
    return ranked.select(*edges.columns).distinct()


@query("w02_top_k_edges", over("facts", "SELECT DISTINCT article_id, source, target, score FROM (SELECT e.*, n.nodes, row_number() OVER (PARTITION BY e.article_id, node ORDER BY score DESC, source, target) AS k FROM (SELECT *, unnest([source, target]) AS node FROM edges) e JOIN (SELECT article_id, count(*) AS nodes FROM facts GROUP BY 1) n ON n.article_id = e.article_id) WHERE k <= 2 OR nodes <= 4", _EDGES))
def w02(m: Model) -> DataFrame:
    return top_k_edges(edges_of(m), 2, 4)


#: An interpolated cut may differ from the score that it equals by rounding.
ROUNDING = 1e-9


#: Bins that an article's scores are counted in at a time, and scores that are few enough to be sorted.
BINS, FEW = 1024, 4096


def exact_cuts(edges: DataFrame, share: float, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(article_id, cut): the linearly interpolated percentile of an article's scores, without holding them in one place.

    The scores that stand at the two ranks around the percentile are found by narrowing: scores are counted in bins
    between the least and the largest, the bin of the rank is kept, and so on until few or equal ones are left,
    which are ranked.  What a task holds of an article is its bins.  Articles all narrow in the same rounds.
    """
    place = (F.col("n") - 1) * share
    known = edges.where("score IS NOT NULL").groupBy("article_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    known = known.withColumns({"at": place - F.floor(place), "rank": F.explode(F.array_distinct(F.array(F.floor(place), F.least(F.floor(place) + 1, F.col("n") - 1))))})
    # (article_id, rank, skip, size, low, high): the rank's score is the (rank - skip)-th of the ``size`` from low to high.
    open_ = materialize(known.select("article_id", "rank", "at", F.lit(0).cast("long").alias("skip"), F.col("n").alias("size"), "low", "high"), "ranks")
    bin_ = F.least(F.floor((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    wide = (F.col("size") > few) & (F.col("high") > F.col("low"))
    scores = edges.select("article_id", "score")
    while open_.where(wide).limit(1).count():
        inside = scores.join(open_.where(wide), "article_id").where("score BETWEEN low AND high")
        counted = inside.groupBy("article_id", "rank", "at", "skip", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("size"), F.min("score").alias("low"), F.max("score").alias("high"))
        before = F.sum("size").over(Window.partitionBy("article_id", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        placed = counted.withColumn("skip", F.col("skip") + F.coalesce(before, F.lit(0)))
        narrow = placed.where("rank >= skip AND rank < skip + size").drop("bin")
        after = materialize(open_.where(~wide).unionByName(narrow), "ranks")
        release(open_)
        open_ = after
    equal = open_.where("low = high").select("article_id", "rank", "at", F.col("low").alias("score"))
    order = F.row_number().over(Window.partitionBy("article_id", "rank").orderBy("score")) - 1
    rest = scores.join(open_.where("low < high"), "article_id").where("score BETWEEN low AND high").withColumn("k", order).where("k = rank - skip")
    found = rest.select("article_id", "rank", "at", "score").unionByName(equal)
    low, high = F.min_by("score", "rank"), F.max_by("score", "rank")
    return found.groupBy("article_id").agg((low + (high - low) * F.first("at")).alias("cut"))


#: Edges of an article from which its percentile is found by narrowing, and its degree cap in rounds.
LARGE = 1 << 20


def percentile_edges(edges: DataFrame, share: float, large: int = LARGE) -> DataFrame:
    """Edges at or above a percentile of their article's scores, linearly interpolated; large articles' scores are never held in one place."""
    sizes = edges.groupBy("article_id").agg(F.count(F.lit(1)).alias("edges"))
    big = materialize(sizes.where(F.col("edges") > large).select("article_id"), "large")
    if big.first() is None:
        cut = edges.groupBy("article_id").agg(F.percentile("score", F.lit(share)).alias("cut"))
    else:
        small = edges.join(big, "article_id", "left_anti").groupBy("article_id").agg(F.percentile("score", F.lit(share)).alias("cut"))
        cut = small.unionByName(exact_cuts(edges.join(big, "article_id", "left_semi"), share))
    return edges.join(cut, "article_id").where(F.col("score") >= F.col("cut") - ROUNDING).drop("cut")


@query("w04_percentile_edges", over("facts", "SELECT e.article_id, source, target FROM edges e JOIN (SELECT article_id, quantile_cont(score, 0.7) AS cut FROM edges GROUP BY 1) c ON c.article_id = e.article_id WHERE score >= cut - 1e-9", _EDGES))
def w04(m: Model) -> DataFrame:
    return percentile_edges(edges_of(m), 0.7).select("article_id", "source", "target")


def with_fallback(edges: DataFrame, min_score: float, keep: int = 3) -> DataFrame:
    """Edges of sufficient score; of an article without any the ``keep`` best."""
    rank = F.row_number().over(Window.partitionBy("article_id").orderBy(F.desc("score"), "source", "target"))
    best = edges.groupBy("article_id").agg(F.max("score").alias("best"))
    ranked = edges.join(best, "article_id").withColumn("rank", rank)
    return ranked.where((F.col("score") >= min_score) | ((F.col("best") < min_score) & (F.col("rank") <= keep))).select(*edges.columns)


@query("w05_fallback_edges", over("facts", "SELECT article_id, source, target, score FROM (SELECT *, max(score) OVER (PARTITION BY article_id) AS best, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, source, target) AS k FROM edges) WHERE score >= 0.8 OR (best < 0.8 AND k <= 3)", _EDGES))
def w05(m: Model) -> DataFrame:
    return with_fallback(edges_of(m), 0.8)


#: Rows of an output batch of ``by_article``.
BATCH = 4096


def by_article(rows: DataFrame, order: list[str | Column], work: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``work`` on the stream of each article's rows in ``order``, tuples without article_id, giving rows for ``schema`` after article_id.

    One shuffle brings articles together, sorted; a task streams through them and holds what ``work`` holds.
    """
    columns = [c for c in rows.columns if c != "article_id"]
    sorted_ = rows.select("article_id", *columns).repartition("article_id").sortWithinPartitions("article_id", *order)
    fields = T.StructType.fromDDL(f"article_id {dict(rows.dtypes)['article_id']}, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(fields)

        def stream() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, BATCH):
                    yield from zip(*[c.to_pylist() for c in b.slice(at, BATCH).columns], strict=True)

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

        out: list[tuple] = []
        for article, group in groupby(stream(), key=lambda r: r[0]):
            for r in work(row[1:] for row in group):
                out.append((article, *r))
                if len(out) >= BATCH:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    return sorted_.mapInArrow(run, fields)


def _by_strength(edges: DataFrame, cap: int | str) -> DataFrame:
    """Edges with their strength (score times confidence, where there is such a column) and their cap (a number, or the column that holds it)."""
    confidence = F.col("confidence") if "confidence" in edges.columns else F.lit(1.0)
    limit = F.col(cap) if isinstance(cap, str) else F.lit(cap)
    return edges.select("article_id", "source", "target", "score", (F.col("score") * confidence).alias("strength"), limit.cast("int").alias("limit"))


def degree_cap(edges: DataFrame, cap: int | str) -> DataFrame:
    """Edges in order of strength, then names, each kept only while both its ends are below the cap (a number, or the
    column that holds it): the order decides, so degrees are all a task holds.  An article is one task's stream; see
    ``degree_cap_in_rounds`` for articles that are too large for that."""

    def cut(graph: Iterator[tuple]) -> Iterator[tuple]:
        degree: dict[str, int] = {}
        for source, target, score, _, most in graph:
            if degree.get(source, 0) < most and degree.get(target, 0) < most:
                degree[source] = degree.get(source, 0) + 1
                degree[target] = degree.get(target, 0) + 1
                yield source, target, score

    return by_article(_by_strength(edges, cap), [F.desc("strength"), "source", "target"], cut, "source string, target string, score double")


#: Rounds after which the edges that are still open are streamed: each round settles all that no open edge can change.
ROUNDS = 12


def degree_cap_in_rounds(edges: DataFrame, cap: int, rounds: int = ROUNDS, large: int = 0) -> DataFrame:
    """What ``degree_cap`` keeps, found by many tasks for each article of more than ``large`` edges; smaller ones are
    streamed whole, by one shuffle, where rounds would shuffle each edge many times.

    An open edge that is among the first of the open ones at both its ends, as many as each end has places left, is
    kept whatever becomes of the others: in the order of the stream both ends are still below the cap when its turn
    comes.  Ends without places left drop their other edges.  The strongest open edge always qualifies, so rounds end;
    what a long chain of dependent edges leaves after ``rounds`` of them is streamed, with the places left.
    Edges from a node to itself take two places, as in the stream.
    """
    if large:
        sizes = edges.groupBy("article_id").agg(F.count(F.lit(1)).alias("edges"))
        big = materialize(sizes.where(F.col("edges") > large).select("article_id"), "large")
        if big.first() is None:
            return degree_cap(edges, cap)
        small = degree_cap(edges.join(big, "article_id", "left_anti"), cap)
        return small.unionByName(degree_cap_in_rounds(edges.join(big, "article_id", "left_semi"), cap, rounds))
    numbered = _by_strength(edges, cap).withColumn("edge", F.monotonically_increasing_id())
    open_ = materialize(numbered.withColumns({"s_left": F.lit(cap), "t_left": F.lit(cap)}), "open")
    order = [F.desc("strength"), "source", "target", "edge"]
    kept: list[DataFrame] = []
    for _ in range(rounds):
        ends = open_.select("*", F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("s_left").alias("left")), F.struct(F.col("target").alias("node"), F.col("t_left").alias("left")))).alias("end"))
        # An edge from a node to itself stands twice in its node's order.
        ranked = ends.withColumn("rank", F.row_number().over(Window.partitionBy("article_id", "end.node").orderBy(*order))).where(F.col("rank") <= cap)
        # Few rows for each node hold all that is known of the kept edges: the open ones needn't be looked through for them.
        first = ranked.where("rank <= end.left").groupBy("article_id", "edge").agg(F.count(F.lit(1)).alias("sides"), *[F.first(c).alias(c) for c in ("source", "target", "score")])
        keep = materialize(first.where("sides = 2").drop("sides"), "kept")
        if keep.first() is None:
            release(keep)
            break
        kept.append(keep)
        taken = keep.select("article_id", "edge", F.explode(F.array("source", "target")).alias("node")).groupBy("article_id", "node").agg(F.count(F.lit(1)).alias("taken"), F.collect_set("edge").alias("settled"))
        rest = open_
        for end, left in (("source", "s_left"), ("target", "t_left")):
            rest = rest.join(taken.withColumnRenamed("node", end), ["article_id", end], "left").withColumn(left, F.col(left) - F.coalesce("taken", F.lit(0)))
            rest = rest.where(f"{left} > 0 AND NOT coalesce(array_contains(settled, edge), false)").drop("taken", "settled")
        after = materialize(rest.select(*open_.columns), "open")
        release(open_)
        open_ = after

    def stream(graph: Iterator[tuple]) -> Iterator[tuple]:
        left: dict[str, int] = {}
        for source, target, score, *_, s_left, t_left in graph:
            if left.setdefault(source, s_left) > 0 and left.setdefault(target, t_left) > 0:
                left[source] -= 1
                left[target] -= 1
                yield source, target, score

    last = by_article(open_, order, stream, "source string, target string, score double")
    return reduce(DataFrame.unionByName, [k.select("article_id", "source", "target", "score") for k in kept], last)


@query("w03_degree_cap")
def w03(m: Model) -> DataFrame:
    return degree_cap(edges_of(m), 2)


@query("w03b_degree_cap_rounds")
def w03b(m: Model) -> DataFrame:
    return degree_cap_in_rounds(edges_of(m), 2, large=LARGE)


@query("w04b_exact_percentile", over("facts", "SELECT l_part AS article_id, round(quantile_cont(score, 0.7), 6) AS cut FROM (SELECT article_id % 3 AS l_part, score FROM edges) GROUP BY 1", _EDGES))
def w04b(m: Model) -> DataFrame:
    # Three large articles, made of all others.
    cuts = exact_cuts(edges_of(m).withColumn("article_id", F.col("article_id") % 3), 0.7, 16, 8)
    return cuts.select("article_id", F.round("cut", 6).alias("cut"))


def adaptive_edges(edges: DataFrame, config: tuple[float, int, int] | None = None) -> DataFrame:
    """Edges filtered by the article's size class: least score, percentile of what is left, degree cap; ``config``
    (least score, degree cap, percentile) holds for all sizes.  An article without an edge of that score keeps its three best."""
    ends = edges.select("article_id", F.explode(F.array("source", "target")).alias("node"), "score").groupBy("article_id", "node").agg(F.max("score").alias("best"))
    sizes = ends.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"), F.max("best").alias("best"))
    n = F.col("n")
    given = dict(zip((2, 3, 4), config, strict=True)) if config else {}
    rule = lambda field: F.lit(given[field]) if config else size_class(n, field)
    shares = sorted({given[4]} if config else {x[4] for x in SIZES})
    place = F.array_position(F.array(*[F.lit(p) for p in shares]), rule(4)).cast("int") - 1
    known = edges.join(sizes.withColumns({"least": rule(2), "cap": rule(3), "place": place}).drop("n"), "article_id")
    # An article either has passing edges or keeps its best, so one pass finds both; the best have no cap.
    passing = F.col("score") >= F.col("least")
    article = Window.partitionBy("article_id")
    cuts = F.percentile("score", F.array(*[F.lit(p / 100) for p in shares])).over(article)
    rank = F.row_number().over(article.orderBy(F.desc("score"), "source", "target"))
    found = known.where(passing | (F.col("best") < F.col("least"))).withColumns({"cuts": cuts, "rank": rank})
    kept = found.where(F.when(passing, F.col("score") >= F.get("cuts", F.col("place")) - ROUNDING).otherwise(F.col("rank") <= 3))
    return degree_cap(kept.select(*edges.columns, F.when(passing, F.col("cap")).otherwise(F.lit(6)).alias("cap")), "cap")


@query("g14b_adaptive_edges")
def g14b(m: Model) -> DataFrame:
    return adaptive_edges(edges_of(m))
