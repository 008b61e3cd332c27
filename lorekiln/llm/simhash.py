"""Near-duplicate detection: SimHash fingerprints, linked at a few differing bits through pivot distance tables.

Equal fingerprints are one class and its smallest doc_id stands for it.  For every class the Hamming distances to
PIVOTS reference fingerprints are computed once, its row of the pivot table.  By the triangle inequality no
distance to a pivot differs by more than the distance of two fingerprints, so a pair whose largest coordinate
difference exceeds the threshold is discarded without a look at the fingerprints; survivors are verified.

Pairs are never formed over all classes.  With one block of bits more than bits may differ, two fingerprints that
link agree in some block: a class meets those that share a block with it, and of these, sorted by their distance
to the first pivot, only those within the threshold of its own coordinate.  A block's value that more than CROWD
classes share is cut again by the same argument, into blocks of the bits left; what is crowded still is dealt to
groups, each two of which meet in a task.  So pairs exist in a task alone, a slice at a time, and only links that
join components leave it, at most one for each row.

Cases: a text with fewer words than a shingle is one shingle; without words, or null, its fingerprint is zero,
linked like any other.  Rows that repeat a doc_id are one node with the links of all their texts; a null doc_id is
a component by itself (component_id null).  Equal rows get equal results.  A very long text is held as its words,
its hashes a slice at a time.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, materialize, release, spread_join
from .minhash import components

SHINGLE_WORDS = 5
#: Bits by which linked fingerprints may differ.
DISTANCE = 3
SEED = 42
#: Reference fingerprints of the table: 24 discard all but one in 10^8 of unrelated pairs.
PIVOTS = [xxhash.xxh64_intdigest(f"pivot {k}".encode(), SEED) for k in range(24)]
#: Classes of one block's value that meet in one task; beyond it the value is cut further.
CROWD = 4096
#: Pairs and shingles looked at in one slice.
SLICE = 1 << 20
SHINGLES = 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """The 64 bits that are set in over half of the text's shingle hashes, as a signed number."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not tokens:
        return 0
    joined, size = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES):
        hashes = np.array([of(joined[a:b], SEED) for a, b in zip(starts[at : at + SHINGLES], ends[at : at + SHINGLES], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of every document."""

    def make() -> Callable[..., list[list]]:
        return lambda ids, texts: [ids, [fingerprint(t, words) for t in texts]]

    return map_columns(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint long")


def pivot_table(fingerprint: Column) -> Column:
    """The Hamming distances to all pivots."""
    signed = [p - (1 << 64) if p >> 63 else p for p in PIVOTS]
    return F.array(*[F.bit_count(fingerprint.bitwiseXOR(F.lit(p).cast("long"))).cast("byte") for p in signed])


def cut(bits: Column, width: int, parts: int) -> list[tuple[Column, Column]]:
    """The lowest ``width`` bits in blocks, as near equal as can be: each block's value, and the bits that it leaves, closed up."""
    out = []
    for k in range(parts):
        low, high = width * k // parts, width * (k + 1) // parts
        value = F.shiftrightunsigned(bits, low).bitwiseAND((1 << (high - low)) - 1)
        above = F.shiftleft(F.shiftrightunsigned(bits, high), low) if high < 64 else F.lit(0).cast("long")
        out.append((value, above.bitwiseAND((1 << width - high + low) - 1).bitwiseOR(bits.bitwiseAND((1 << low) - 1))))
    return out


def units(classes: DataFrame, distance: int) -> DataFrame:
    """(key, a, b, side, d, x, fingerprint, pivots): the classes by shared blocks, d their distance to the first pivot.

    ``key``, a and b say what meets in a task; where a and b differ, only rows of different ``side`` do.
    """
    parts = max(4, distance + 1)  # blocks of 16 bits at most: their values, 2^18 at most, can be broadcast
    columns = ["x", "fingerprint", "pivots"]
    blocks = [F.struct((value + (k << 16)).alias("key"), rest.alias("rest")) for k, (value, rest) in enumerate(cut(F.col("fingerprint"), 64, parts))]
    placed = classes.select(*columns, F.explode(F.array(*blocks)).alias("block")).select(*columns, "block.key", "block.rest")
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    known = placed.join(F.broadcast(sizes), "key")
    loose = known.where(F.col("held") <= CROWD).select("key", F.lit(0).alias("part"), F.lit(0).cast("long").alias("value"), *columns)
    # The bits left of crowded values are cut into as many blocks again, since all bits that differ are among them.
    left = max(64 - 64 * (k + 1) // parts + 64 * k // parts for k in range(parts))
    inner = [F.struct(F.lit(k + 1).alias("part"), value.alias("value")) for k, (value, _) in enumerate(cut(F.col("rest"), left, parts))]
    crowded = known.where(F.col("held") > CROWD).select("key", *columns, F.explode(F.array(*inner)).alias("in")).select("key", "in.part", "in.value", *columns)
    unit = ["key", "part", "value"]
    full = materialize(crowded.groupBy(*unit).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > CROWD), "full")
    if full.first():
        groups = F.ceil(F.coalesce("held", F.lit(1)) / CROWD).cast("int")
        dealt = spread_join(crowded, full, unit, "held", ["held"]).withColumn("side", F.pmod(F.xxhash64(F.lit("side"), "fingerprint"), groups).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), groups - 1))).drop("held")
    else:
        dealt = crowded.withColumns({"side": F.lit(0), "other": F.lit(0)})
    both = loose.withColumns({"side": F.lit(0), "other": F.lit(0)}).unionByName(dealt)
    first = F.get("pivots", F.lit(0)).alias("d")
    return both.select(*unit, F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", first, *columns)


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (of each row its component's smallest row) after the links (i, j)."""
    while True:
        p, q = label[i], label[j]
        apart = p != q
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while not np.array_equal(label, after := label[label]):
            label = after


def close(d: np.ndarray, unit: np.ndarray, side: np.ndarray | None, table: np.ndarray, prints: np.ndarray, distance: int) -> np.ndarray:
    """Labels of rows sorted by (unit, d), joined where rows of one unit (and, if given, of different sides) link.

    Coordinates of different units are put further apart than the threshold, so that one sorted search serves all units.
    """
    n = len(d)
    place = unit * (65 + distance) + d
    last = np.searchsorted(place, place + distance, "right")
    label, counts = np.arange(n), last - np.arange(1, n + 1)
    total = np.concatenate(([0], np.cumsum(counts)))
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(total, total[start] + SLICE, "right")) - 1)
        lengths = counts[start:end]
        i = np.repeat(np.arange(start, end), lengths)
        j = np.arange(len(i)) - np.repeat(total[start:end] - total[start], lengths) + i + 1
        start = end
        if side is not None:
            apart = side[i] != side[j]
            i, j = i[apart], j[apart]
        # Pairs whose largest coordinate difference exceeds the threshold go, a few coordinates at a time.
        for k in range(1, table.shape[1], 4):
            if not len(i):
                break
            alive = (np.abs(table[i, k : k + 4] - table[j, k : k + 4]) <= distance).all(axis=1)
            i, j = i[alive], j[alive]
        same = np.bitwise_count(prints[i] ^ prints[j]) <= distance
        label = joined(label, i[same], j[same])
    return label


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between classes (x, fingerprint, pivots) that join all classes within ``distance``, a forest of each batch of rows."""
    kind = dict(classes.dtypes)["x"]
    order = ["key", "part", "value", "a", "b"]
    ordered = units(classes, distance).repartition(*order).sortWithinPartitions(*order, "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def forest(rows: pa.RecordBatch, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b, side, d, prints = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "side", "d", "fingerprint"))
            pivots = rows.column("pivots")
            table = pivots.flatten().to_numpy().reshape(rows.num_rows, -1)
            # Within a group all meet; groups of an unequal pair meet across.
            label = close(d.astype(np.int64), unit, np.where(a == b, np.arange(len(a)), -1 - side) if (a != b).any() else None, table, prints.astype(np.uint64), distance)
            child = np.flatnonzero(label != np.arange(len(label)))
            if len(child):
                xs = rows.column("x")
                yield pa.RecordBatch.from_arrays([xs.take(pa.array(label[child])), xs.take(pa.array(child))], ["a", "b"])

        for batch in batches:
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            if not rows.num_rows:
                continue
            keys = [rows.column(c).to_numpy(zero_copy_only=False) for c in order]
            fresh = np.concatenate(([0], np.any([k[1:] != k[:-1] for k in keys], axis=0).astype(np.int64)))
            unit = np.cumsum(fresh)
            begin = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
            held = rows.slice(begin)
            if begin:
                yield from forest(rows.slice(0, begin), unit[:begin])
        if held is not None:
            yield from forest(held, np.zeros(held.num_rows, np.int64))

    return ordered.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row; component_id is the smallest doc_id reachable."""
    if not 0 <= distance <= 7:
        raise ValueError("distance: 0 to 7 bits")
    own = materialize(fingerprints(docs, words), "own")
    grouped = own.groupBy("fingerprint").agg(F.min("doc_id").alias("x"), F.count(F.lit(1)).alias("n"))
    classes = materialize(grouped.select("fingerprint", "x", "n", pivot_table(F.col("fingerprint")).alias("pivots")), "classes")
    met = materialize(links(classes.where("x is not null").select("x", "fingerprint", "pivots"), distance), "links")
    # Rows of one doc_id with several fingerprints: their classes are linked through the doc_id.
    several = own.where("doc_id is not null").groupBy("doc_id").agg(F.min("fingerprint").alias("lo"), F.max("fingerprint").alias("hi")).where("lo <> hi")
    ends = own.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", "fingerprint").distinct()
    through = ends.join(classes.select("fingerprint", "x"), "fingerprint").select(F.col("doc_id").alias("a"), F.col("x").alias("b"))
    roots = components(met.unionByName(through))
    named = classes.join(roots.withColumnRenamed("node", "x"), "x", "left").select("fingerprint", F.coalesce("root", "x").alias("component_id"), "n")
    named = materialize(named, "named")
    release(met, classes)
    found = spread_join(own, named, ["fingerprint"], "n", ["component_id"])
    return found.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
