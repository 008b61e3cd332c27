"""Near-duplicate detection: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Equal shingle sets are one class and their smallest doc_id stands for it.  Signatures of the classes are
cut into bands; classes that share a bucket of a band are candidates.  A pair is compared signature batch
by signature batch, and dropped once the posterior probability that its similarity reaches the threshold
falls below ``miss``; survivors are confirmed on their full shingle sets.

Candidates are met in two passes, neither of which writes pairs of a crowded bucket as rows.  The first
pairs each class with the hub of each of its buckets, the class that meets most others over all buckets
(of a group of copies, mostly their original): a few pairs a class.  Links give components.  Buckets whose
classes then still lie in several components are open.  In the second pass the classes of an open bucket
come together in one task, which compares all their candidates across components; a pair that shares
several buckets is met in that of the first band.  A crowded bucket is dealt to blocks, the hub's
component and the rest apart, and every two blocks meet in a task, but for blocks of that component among
themselves.  Signatures alone go first; the classes that have a survivor come again with their shingle
sets, and what comes back are links that join components, at most one a class.  So each pair that shares a
bucket was compared or lies in one component anyway.  A class goes to a task for each of its open buckets,
32 at most, and in a crowded one for each of its blocks: rows grow with the classes, not with their pairs.

A pair at the threshold shares no band with probability (1 - 0.8^6)^32 = 6e-5, and is pruned with
probability ``miss`` at most.  Shingles are compared as 64-bit hashes: unequal ones of two texts of a
thousand words are taken for equal with a probability of about 1e-13.

Cases: a text with fewer words than a shingle is one shingle; without words, or null, its set is empty
and links with nothing.  Rows that repeat a doc_id are one node with the links of all their texts; a null
doc_id is a component by itself (component_id null, kept).  Equal rows get equal results each.  A very
long text is held as its set of hashes, eight bytes a word; blocks are bounded by shingles as well as by
rows.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, materialize, pieces, release, spread_join

SHINGLE_WORDS = 5
#: Least similarity in hundredths.
THRESHOLD = 80
#: A power of two bands, and the values of each.
BANDS, ROWS = 32, 6
BATCH = 32
MISS = 1e-5
#: Classes of a block of the second pass, and shingles; both bound what a task holds.
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 1 << 22
#: Classes that one copy of a hub is sent to in the first pass.
CHUNK = 256
#: Links that one task joins by union-find.
LINK_BLOCK = 400_000
WORDS_HELD = 400_000
SEED = 20240229


class WordHashes(dict):
    """64-bit hashes of words, held for the frequent ones' sake and emptied when too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_FACTORS = np.random.default_rng(SEED).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h += w[k : k + n] * _FACTORS[k % 64]
        if k % 64 == 63:
            h ^= h >> np.uint64(29)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.unique(h)


class Signer:
    """MinHash signatures of ``n`` values, the low 16 bits of each minimum."""

    def __init__(self, n: int, step: int = 512):
        rng = np.random.default_rng(SEED + 1)
        self.a = (rng.integers(0, 2**31, (n, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 2**32, (n, 1), dtype=np.uint32)
        self.buffer, self.step, self.n = np.empty((n, step), np.uint32), step, n

    def sign(self, shingles: np.ndarray) -> bytes:
        x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        low = np.full(self.n, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), self.step):
            part = x[i : i + self.step]
            h = self.buffer[:, : len(part)]
            np.multiply(self.a, part, out=h)
            np.add(h, self.b, out=h)
            np.minimum(low, h.min(axis=1), out=low)
        low *= np.uint32(0x9E3779B1)
        return (low >> np.uint32(16)).astype("<u2").tobytes()


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest of ``n`` matches with P(similarity >= threshold | matches) >= miss, under a uniform prior.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, threshold) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, tie (a hash of the text), n_shingles, sid (a hash of the set; null if empty) and sig of every document."""

    def make() -> Callable[..., list[list]]:
        hashes, signer = WordHashes(), Signer(BANDS * ROWS)

        def run(ids: list, ties: list, texts: list) -> list[list]:
            sets = [shingle_set(t, words, hashes) for t in texts]
            sids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return [ids, ties, [len(s) for s in sets], sids, [signer.sign(s) if len(s) else None for s in sets]]

        return run

    kind = dict(docs.dtypes)["doc_id"]
    return map_columns(docs.select("doc_id", F.xxhash64("text").alias("tie"), "text"), make, f"doc_id {kind}, tie long, n_shingles long, sid binary, sig binary")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """x, sig and the sorted shingle hashes, as bytes, of rows (x, sig, text)."""

    def make() -> Callable[..., list[list]]:
        hashes = WordHashes()
        return lambda xs, sigs, texts: [xs, sigs, [shingle_set(t, words, hashes).astype("<u8").tobytes() for t in texts]]

    return map_columns(texts.select("x", "sig", "text"), make, f"x {dict(texts.dtypes)['x']}, sig binary, shingles binary")


def reachable(a: Column, b: Column, threshold: int) -> Column:
    """Whether sets of so many shingles can be as similar as the threshold asks."""
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


class Pruner:
    """Which pairs of signatures no batch rules out."""

    def __init__(self, threshold: int, miss: float):
        self.least = [least_matches(n, threshold / 100, miss) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def __call__(self, x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs left of (x[i], y[j]) and their matches."""
        matches = np.zeros(len(i), np.int64)
        for k, need in enumerate(self.least):
            at = slice(k * BATCH, (k + 1) * BATCH)
            matches += (x[i, at] == y[j, at]).sum(axis=1)
            alive = matches >= need
            if not alive.all():
                i, j, matches = i[alive], j[alive], matches[alive]
        return i, j, matches


def _signed(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), -1)


def _links(a: list, b: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])


def similar(p: np.ndarray, q: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both > 0 and 100 * both >= threshold * (len(p) + len(q) - both)


def hub_links(pairs: DataFrame, sets: DataFrame, threshold: int, miss: float) -> DataFrame:
    """The pairs (a, b) of a hub and a class that link, or where ``sets`` has signatures alone, that no batch rules out.

    A hub goes before its classes in a partition sorted by hub, so that one hub is held at a time; hubs
    of many classes are repeated, one for each chunk of them.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    members = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.col("b").alias("x"), F.lit(1).alias("side"))
    hubs = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("x"), F.lit(0).alias("side"))
    whole = "shingles" in sets.columns
    needed = members.unionByName(hubs).join(sets, "x").select("a", "chunk", "side", "x", "sig", *["shingles"] * whole)
    ordered = needed.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "side")
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prune, at, held = Pruner(threshold, miss), None, []
        for batch in batches:
            for part in pieces(batch):
                a, chunk, side, xs, sigs, *rest = (c.to_pylist() for c in part.columns)
                shingles = rest[0] if whole else [None] * len(a)
                # Signatures of the hubs that are met here, and for each class of a hub one pair of places.
                known = [h[0] for h in held]
                here, i, j, other = list(range(len(held))), [], [], [h[1] for h in held]
                for r, unit in enumerate(zip(a, chunk, strict=True)):
                    if unit != at:
                        at, held, here = unit, [], []
                    if side[r] == 0:
                        here.append(len(known))
                        known.append(sigs[r])
                        other.append(shingles[r])
                        held.append((sigs[r], shingles[r]))
                    else:
                        i += here
                        j += [r] * len(here)
                if not i:
                    continue
                i, j, _ = prune(_signed(known), np.array(i), _signed(sigs), np.array(j))
                found: tuple[list, list] = ([], [])
                for h, r in zip(i.tolist(), j.tolist(), strict=True):
                    if not whole or similar(np.frombuffer(other[h], "<u8"), np.frombuffer(shingles[r], "<u8"), threshold):
                        found[0].append(a[r])
                        found[1].append(xs[r])
                if found[0]:
                    yield _links(*found, part.schema.field("x").type)

    return ordered.mapInArrow(run, f"a {kind}, b {kind}")


class Part:
    """Some classes of a block: components, sizes, signatures, a key for each band, and where they are there sets."""

    def __init__(self, xs: list, roots: list, sizes: list, sigs: list[bytes], shingles: list[bytes] | None):
        self.xs, self.roots, self.sizes, self.sigs = xs, roots, np.array(sizes), _signed(sigs)
        self.sets = shingles and [np.frombuffer(s, "<u8") for s in shingles]
        # 96 bits of a band as one 64-bit key: a chance agreement only means one more candidate.
        words = np.ascontiguousarray(self.sigs).view("<u4").reshape(len(sigs), BANDS, ROWS // 2).astype(np.uint64)
        self.bands = ((words[:, :, 0] * _FACTORS[0] + words[:, :, 1]) * _FACTORS[1] + words[:, :, 2]) * _FACTORS[2]
        self.hit = np.zeros(len(xs), bool)


class Meeting:
    """A bucket's block with another, or with itself, in a task: marks the classes with a survivor, or finds the links that join components."""

    def __init__(self, band: int, threshold: int, prune: Pruner):
        self.band, self.threshold, self.prune = band, threshold, prune
        self.parts: dict[int, list[Part]] = {}
        self.parent: dict = {}
        self.found: tuple[list, list] = ([], [])

    def root(self, x):
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def add(self, side: int, part: Part) -> None:
        """Side 0 waits for side 1; side 2 meets itself."""
        for other in self.parts.get(2 if side == 2 else 0, []) if side else []:
            self.compare(other, part, False)
        if side == 2:
            self.compare(part, part, True)
        self.parts.setdefault(side, []).append(part)

    def compare(self, p: Part, q: Part, same: bool) -> None:
        code: dict = {}
        mine, theirs = ([code.setdefault(self.root(r), len(code)) for r in part.roots] for part in (p, q))
        open_ = np.array(mine)[:, None] != np.array(theirs)[None, :]
        if same:
            open_ &= np.tri(len(mine), k=-1, dtype=bool).T
        least, most = np.minimum(p.sizes[:, None], q.sizes), np.maximum(p.sizes[:, None], q.sizes)
        open_ &= 100 * least >= self.threshold * most
        for k in range(self.band):  # met in the bucket of an earlier band
            if not open_.any():
                return
            open_ &= p.bands[:, k, None] != q.bands[None, :, k]
        i, j = np.nonzero(open_)
        i, j, matches = self.prune(p.sigs, i, q.sigs, j)
        if not len(i):
            return
        p.hit[i], q.hit[j] = True, True
        if p.sets:
            self.verify(p, q, i, j, matches)

    def verify(self, p: Part, q: Part, i: np.ndarray, j: np.ndarray, matches: np.ndarray) -> None:
        """Confirm survivors on full sets, likeliest first within a row, leaving out those joined meanwhile."""
        rows, others = np.unique(i), np.unique(j)
        sets = [p.sets[r] for r in rows] + [q.sets[r] for r in others]
        values, places = np.unique(np.concatenate(sets), return_inverse=True)
        cut = np.split(places, np.cumsum([len(s) for s in sets])[:-1])
        own = dict(zip(rows.tolist(), cut[: len(rows)], strict=True))
        their = dict(zip(others.tolist(), cut[len(rows) :], strict=True))
        mark = np.zeros(len(values), bool)
        order = np.lexsort((-matches, i))
        for r, group in groupby(zip(i[order].tolist(), j[order].tolist(), strict=True), key=lambda x: x[0]):
            mark[own[r]] = True
            for _, s in group:
                a, b = self.root(p.roots[r]), self.root(q.roots[s])
                if a == b:
                    continue
                both = int(np.count_nonzero(mark[their[s]]))
                if both and 100 * both >= self.threshold * (len(own[r]) + len(their[s]) - both):
                    self.parent[max(a, b)] = min(a, b)
                    self.found[0].append(a)
                    self.found[1].append(b)
            mark[own[r]] = False


def meetings(open_: DataFrame) -> DataFrame:
    """(key, a, b, side, band, x, root, size): the classes of open buckets, a row for each two blocks of their bucket that meet in a task."""
    inner = (F.col("root") == F.col("top.root")).alias("inner")
    known = open_.select("key", "band", "x", "root", "size", inner)
    count = lambda c: (F.greatest(F.ceil(F.count_if(c) / BLOCK_ROWS), F.ceil(F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)) / BLOCK_SHINGLES))).cast("int")
    sizes = known.groupBy("key").agg(count(F.lit(True)).alias("all"), count(F.col("inner")).alias("c_in"), count(~F.col("inner")).alias("c_out"))
    draw = lambda n: F.pmod(F.xxhash64(F.lit("block"), "x"), n).cast("int")
    whole = F.col("all") <= 1
    block = F.when(whole, 0).when(F.col("inner"), draw(F.col("c_in"))).otherwise(F.col("c_in") + draw(F.col("c_out")))
    # Blocks of the hub's component need not meet each other.
    first = F.when(F.col("inner"), F.col("c_in")).otherwise(0)
    others = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(first, F.col("c_in") + F.col("c_out") - 1))
    each = known.join(sizes, "key").withColumn("p", block).withColumn("q", F.explode(others))
    side = F.when(F.col("p") == F.col("q"), 2).when(F.col("p") < F.col("q"), 0).otherwise(1)
    return each.select("key", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), side.alias("side"), "band", "x", "root", "size")


def _met(rows: DataFrame, n: int, threshold: int, miss: float, links: bool) -> DataFrame:
    """Runs the meetings of ``rows`` (with sig, and for links shingles): the rows that have a survivor, without sig, or the links (a, b)."""
    columns = ["key", "a", "b", "side", "band", "x", "root", "size"]
    # Little data and much work: tasks by the number of rows, not by bytes.
    tasks = max(1, min(n // 256, max(rows.sparkSession.sparkContext.defaultParallelism, n // 50_000)))
    ordered = rows.select(*columns, "sig", *["shingles"] * links).repartition(tasks, "key", "a", "b").sortWithinPartitions("key", "a", "b", "side")
    kinds = dict(rows.dtypes)
    schema = f"a {kinds['root']}, b {kinds['root']}" if links else ", ".join(f"{c} {kinds[c]}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prune, at, meeting, types = Pruner(threshold, miss), None, None, None

        def over() -> Iterator[pa.RecordBatch]:
            if meeting is None:
                return
            if links and meeting.found[0]:
                yield _links(*meeting.found, types.field("root").type)
            for side, parts in meeting.parts.items() if not links else []:
                for p in parts:
                    if p.hit.any():
                        rest = [(*at, side, meeting.band, p.xs[r], p.roots[r], int(p.sizes[r])) for r in np.flatnonzero(p.hit).tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, types.field(name).type) for name, c in zip(columns, zip(*rest, strict=True), strict=True)], columns)

        for batch in batches:
            types = batch.schema
            for part in pieces(batch):
                key, a, b, side, band, xs, roots, sizes, sigs, *sets = (c.to_pylist() for c in part.columns)
                for unit, group in groupby(range(len(key)), key=lambda r: (key[r], a[r], b[r], side[r])):
                    span = list(group)
                    span = slice(span[0], span[-1] + 1)
                    if unit[:3] != at:
                        yield from over()
                        at, meeting = unit[:3], Meeting(band[span.start], threshold, prune)
                    meeting.add(unit[3], Part(xs[span], roots[span], sizes[span], sigs[span], sets[0][span] if sets else None))
        yield from over()

    return ordered.mapInArrow(run, schema)


def open_links(open_: DataFrame, sets: DataFrame, threshold: int, miss: float) -> DataFrame:
    """Links (a, b) between components, from all candidates across components of the open buckets."""
    met = materialize(meetings(open_), "meetings")
    survivors = materialize(_met(met.join(sets.select("x", "sig"), "x"), met.count(), threshold, miss, False), "survivors")
    links = materialize(_met(survivors.join(sets, "x"), survivors.count(), threshold, miss, True), "links")
    release(met, survivors)
    return links


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a block as stars around the smallest node of each of the block's components."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of undirected links (a, b) but the roots: root is the component's smallest node.

    Blocks of at most LINK_BLOCK links are brought to stars by union-find; where there are several blocks,
    large-star and small-star steps alternate over the blocks' stars until they are stars overall.
    """
    links = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "links")
    blocks = max(1, -(-links.count() // LINK_BLOCK))
    links = materialize(links.coalesce(blocks).mapInArrow(_forest, links.schema), "links")
    while blocks > 1:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.*").where("u <> v").distinct(), "links")
        if after.count() == links.count() and not after.join(links, ["u", "v"], "left_anti").limit(1).count():
            break
        links = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def open_buckets(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, band, x, size, root, top) of the buckets whose classes lie in several components; top: the hub as (rank, x, root)."""
    named = buckets.join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    top = F.min(F.struct((-F.col("meets")).alias("rank"), "x", "root")).alias("top")
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), top).where("lo <> hi").select("key", "top")
    return named.join(mixed, "key").select("key", "band", "x", "size", "root", "top")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs, words), "signatures")
    first = F.min(F.struct("doc_id", "tie")).alias("first")
    own = materialize(signed.select("doc_id", "n_shingles", "sid"), "own")
    classes = signed.where("sid is not null and doc_id is not null").groupBy("sid").agg(first, F.min("sig").alias("sig"), F.min("n_shingles").alias("size"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.select("sid", F.col("first.doc_id").alias("x"), "first.tie", "sig", "size", "n"), "classes")
    named = materialize(classes.select("sid", "x", "n"), "named")
    release(signed)
    # Rows of one doc_id with several texts: their classes are linked through the doc_id.
    usable = own.where("sid is not null and doc_id is not null")
    several = usable.groupBy("doc_id").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi")
    texts_of = usable.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", "sid").distinct()
    repeats = texts_of.join(named, "sid").select(F.col("doc_id").alias("a"), F.col("x").alias("b"))

    # A bucket's key ends in its band's number.
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS)).bitwiseAND(-BANDS).bitwiseOR(k) for k in range(BANDS)])
    banded = classes.select(F.explode(keys).alias("key"), "x")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(banded.join(shared, "key"), "met")
    sizes = classes.groupBy("x").agg(F.max("size").alias("size"))
    meets = met.groupBy("x").agg(F.sum(F.col("n") - 1).alias("meets")).join(sizes, "x")
    band = F.col("key").bitwiseAND(BANDS - 1).cast("int").alias("band")
    buckets = materialize(met.join(meets, "x").select("key", band, "x", "size", "meets"), "buckets")
    release(met)
    # Only texts that share a bucket can be asked for: the collection is read and shuffled once.
    asked = classes.join(buckets.select("x").distinct(), "x", "left_semi").select(F.col("x").alias("doc_id"), "tie", "x", "sig")
    texts = docs.withColumn("tie", F.xxhash64("text")).join(asked, ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie", "sig"])
    sets = materialize(shingle_sets(texts, words), "sets")
    release(classes)

    hub = F.min(F.struct((-F.col("meets")).alias("rank"), "x", "size")).alias("hub")
    pairs = buckets.join(buckets.groupBy("key").agg(hub), "key").where(F.col("x") != F.col("hub.x")).where(reachable(F.col("size"), F.col("hub.size"), threshold))
    pairs = materialize(pairs.select(F.col("hub.x").alias("a"), F.col("x").alias("b")).distinct(), "pairs")
    alive = materialize(hub_links(pairs, sets.select("x", "sig"), threshold, miss).distinct(), "alive")
    release(pairs)
    roots = components(hub_links(alive, sets, threshold, miss).unionByName(repeats))
    open_ = materialize(open_buckets(buckets, roots), "open")
    release(alive, buckets)
    links = open_links(open_, sets, threshold, miss)
    joined = components(links)
    release(open_, sets, links)
    # Components are named for the classes; documents, of which most may share one text or have none, come last and are dealt out.
    rooted = named.join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    last = rooted.join(joined.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
    last = materialize(last.select("sid", F.coalesce("last", "root").alias("component_id"), "n"), "last")
    release(named)
    found = spread_join(own, last, ["sid"], "n", ["component_id"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id; rows without doc_id all stay.

    A doc_id is one document: of rows that repeat it one stays, whether their texts are alike or not.  Rows travel as one struct, so that no column of theirs can clash with the operator's own.
    """
    found = near_duplicates(docs, words, threshold)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    packed = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("tie"))
    one = packed.join(kept, "doc_id").withColumn("place", place).where("place = 1")
    return one.unionByName(packed.where("doc_id is null").withColumn("place", F.lit(1))).select("row.*")
