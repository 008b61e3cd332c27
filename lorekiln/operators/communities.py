"""Communities of the whole corpus network: modularity raised by rounds of parallel moves and contraction, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.proxy import Model
from ..plans.registry import query
from ..plans.shared import materialize, release
from .graph import both_ways
from .relations import pair_support

#: Rounds of moves on one level, and levels of contraction; each level ends earlier where nothing moves or gains.
ROUNDS, LEVELS = 16, 8
LEAST_GAIN = 1e-6


def _held(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    after = materialize(df, "communities")
    if before is not None:
        release(before)
    return after


def modularity(links: DataFrame, member: DataFrame, total: float, resolution: float = 1.0) -> float:
    """Of a partition (node, community) of symmetric ``links`` (source, target, w) of that total weight."""
    named = links.join(member.select(F.col("node").alias("source"), F.col("community").alias("a")), "source").join(member.select(F.col("node").alias("target"), F.col("community").alias("b")), "target")
    by = named.groupBy(F.col("a").alias("community")).agg(F.sum("w").alias("strength"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    return by.agg(F.sum(F.col("inside") / total - resolution * F.pow(F.col("strength") / total, F.lit(2)))).first()[0] or 0.0


def _round(links: DataFrame, member: DataFrame, total: float, nodes: int, resolution: float, awake: Column) -> DataFrame:
    """(node, k, community, moved) after one round: each awake node goes to the neighbouring community of largest gain.

    Gains are rounded to what sums in another order can't change; ties keep the community, then take the smallest.
    """
    volume = member.groupBy("community").agg(F.sum("k").alias("volume"))
    ends = member.join(volume, "community").select(F.col("node").alias("target"), F.col("community").alias("to"), "volume")
    # Only the links of awake nodes are looked at.  They are shuffled twice: to their targets' communities and back to their nodes.
    near = links.where("source <> target").withColumnRenamed("source", "node").where(awake).join(ends, "target").select("node", "to", "w", "volume")
    own = member.where(awake).join(volume, "community").select("node", F.col("community").alias("to"), F.lit(0.0).alias("w"), "volume")
    offers = near.unionByName(own).repartition("node").groupBy("node", "to").agg(F.sum("w").alias("w"), F.max("volume").alias("volume"))
    known = offers.join(member, "node")
    home = F.col("to") == F.col("community")
    rest = F.col("volume") - F.when(home, F.col("k")).otherwise(0.0)
    gain = F.round((F.col("w") - resolution * F.col("k") * rest / total) * nodes / total, 9)
    # The largest gain, at home first among equals, then the smallest community: min of (-gain, away, name).
    best = F.min(F.struct((-gain).alias("loss"), (~home).cast("int").alias("away"), "to")).alias("best")
    chosen = known.groupBy("node").agg(best, F.first("k").alias("k"), F.first("community").alias("community"))
    goes = F.col("best.away") == 1
    asleep = member.where(~awake).select("node", "k", "community", F.lit(False).alias("moved"))
    return chosen.select("node", "k", F.when(goes, F.col("best.to")).otherwise(F.col("community")).alias("community"), goes.alias("moved")).unionByName(asleep)


def _moves(links: DataFrame, member: DataFrame, total: float, resolution: float, rounds: int, seed: int) -> DataFrame:
    """(node, k, community) after rounds of moves from (node, k, community), until nobody wants to move in two running."""
    nodes, still = member.count(), 0
    for turn in range(rounds):
        awake = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn // 2), "node"), F.lit(2)) == turn % 2  # every node once in two rounds
        moved = _held(_round(links, member, total, nodes, resolution, awake))
        still = 0 if moved.where("moved").limit(1).count() else still + 1
        release(member)
        member = moved
        if still == 2:
            break
    return member


def corpus_communities(edges: DataFrame, resolution: float = 1.0, rounds: int = ROUNDS, levels: int = LEVELS) -> DataFrame:
    """(node, community) of undirected weighted ``edges`` (source, target, score): a community is named by its smallest node.

    On a level nodes start alone.  In a round the half of them that a hash of node and round wakes move at once, so that
    two neighbours seldom swap.  Communities become the nodes of the next level, with the weights between them summed,
    as long as modularity gains; at last single nodes move once more between the communities found, which mends what
    moves at the same time did to each other.  The result doesn't depend on the order of rows.  Every step is a join or
    an aggregate by node or community; no task holds the graph.  Edges from a node to itself count twice, as both their
    ends; weights that aren't positive are left out.
    """
    base = links = _held(both_ways(edges.where("score > 0")).groupBy("source", "target").agg(F.sum("score").alias("w")))
    total = base.agg(F.sum("w")).first()[0]
    if not total:
        return base.select(F.col("source").alias("node"), F.col("source").alias("community"))
    strengths = _held(base.groupBy(F.col("source").alias("node")).agg(F.sum("w").alias("k")))
    found = _held(strengths.select("node", F.col("node").alias("community")))
    best = modularity(base, found, total, resolution)
    for level in range(levels):
        strength = strengths if level == 0 else links.groupBy(F.col("source").alias("node")).agg(F.sum("w").alias("k"))
        member = _moves(links, _held(strength.withColumn("community", F.col("node"))), total, resolution, rounds, level)
        after = modularity(links, member, total, resolution)
        if after < best + LEAST_GAIN:
            break
        best = after
        # The next level's nodes carry the name of their smallest member.
        names = member.groupBy("community").agg(F.min("node").alias("name"))
        named = _held(member.join(names, "community").select("node", F.col("name").alias("community")))
        found = _held(found.select("node", F.col("community").alias("_at")).join(named.select(F.col("node").alias("_at"), "community"), "_at").select("node", "community"), found)
        side = lambda c: named.select(F.col("node").alias(c), F.col("community").alias(f"{c}_c"))  # noqa: E731, B023
        links = _held(links.join(side("source"), "source").join(side("target"), "target").groupBy(F.col("source_c").alias("source"), F.col("target_c").alias("target")).agg(F.sum("w").alias("w")), links if level else None)
    mended = _moves(base, _held(found.join(strengths, "node").select("node", "k", "community")), total, resolution, rounds, levels)
    if modularity(base, mended, total, resolution) > best:
        found = mended.select("node", "community")
    smallest = found.groupBy("community").agg(F.min("node").alias("name"))
    return found.join(smallest, "community").select("node", F.col("name").alias("community"))


def corpus_network(m: Model) -> DataFrame:
    """Pairs of entities with the articles that they share as weight."""
    pairs = pair_support(m.facts)
    return pairs.select(F.col("entity_a").alias("source"), F.col("entity_b").alias("target"), F.col("articles").cast("double").alias("score"))


@query("g06b_corpus_communities")
def g06b(m: Model) -> DataFrame:
    return corpus_communities(corpus_network(m))
