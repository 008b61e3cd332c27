"""Mixing sources to target weights, by DataFrame functions alone.

The words of a source form one stream, cut into blocks of fixed length.  Targets follow weights under
a cap of three epochs, the excess going to the other sources; each source gets a whole number of slots for
its target.  For every output shard the count of each source is drawn: a source's slots are thrown at the
shards independently, a multinomial draw in which the totals of the sources stay as planned, and given
its size a shard's counts follow the sources' shares.  Running sums of the counts give each shard a range
of each source's slot numbers; a number's epoch and rank in it are mapped through one pseudorandom
permutation of the block indices per source and epoch (swap-or-not rounds), and joined with the blocks by
index.  A shard's slots are permuted likewise, so that its sources are mixed.

Cases: null or white texts have no words and are never taken; null sources form one source, last in
order; an empty table gives no rows.  Rows that repeat a document are documents of their own, ties in any
order among equal ones; rows of null ids are spread like others.  A very long text is many blocks.  Extra
columns do no harm, whatever their names; they pass through ``mixed_documents``.  Indices are 64-bit and
nothing multiplies them: a source may have 2^62 blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK_WORDS = 128
MAX_EPOCHS = 3
SHARD_SLOTS = 4096
#: Slots that a task permutes, where there are many.
SLOTS_EACH = 500_000
#: Rows of a bucket on average, and the fewest buckets of a source: a bucket's rows are ranked in one task.
BUCKET_ROWS = 20_000
BUCKETS = 1024
BIN = 4096
ROUNDS = 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Each row's size, bucket and rank by id in (source, bucket), with the words that lie before it there."""
    buckets = max(BUCKETS, docs.count() // BUCKET_ROWS)
    w = Window.partitionBy("source", "bucket").orderBy("doc_id", "tie")
    rows = docs.select(
        *keep,
        "doc_id",
        "source",
        n_words(F.col("text")).alias("size"),
        F.xxhash64("text").alias("tie"),
        F.pmod(F.xxhash64(F.lit("bucket"), "doc_id", "text"), F.lit(buckets)).alias("bucket"),
    )
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"idx": F.row_number().over(w), "inner": F.coalesce(F.sum("size").over(before), F.lit(0))}).drop("tie")


def targets(by_source: DataFrame) -> DataFrame:
    """(source, source_size) -> rank, weight, cap and target: min(cap, level * weight), where the level makes the targets sum to all words.

    With sources sorted by cap / weight, the level is the largest of those got by capping a prefix.
    """
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumns(
        {"weight": ((F.col("rank") - 1) % 3 + 1).cast("double"), "cap": (F.col("source_size") * MAX_EPOCHS).cast("double")}
    )
    w = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(w.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", level)
    return levelled.withColumn("target", F.least(F.col("cap"), F.max("level").over(every) * F.col("weight"))).drop("level", "cap")


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The image of index ``x`` under a permutation of [0, n) that ``key`` picks: swap-or-not rounds.

    In a round x and its partner (a secret offset less x) change places or not by a bit that both share.
    """

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        coin = F.xxhash64(key, r, F.greatest(at, other)).bitwiseAND(1) == 1
        return F.when(coin, other).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r).cast("long") for r in range(ROUNDS)]), x, swap)


class Mix:
    """The plan of a mix; ``sized`` and ``sources`` are written to the shared folder, being used several times."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 11, keep: list[str] | None = None):
        self.spark, self.block, self.seed = docs.sparkSession, block_words, seed
        sized = materialize(sized_rows(docs, keep or []), "sized")
        parts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("source", "bucket", "words", F.coalesce(F.sum("words").over(w), F.lit(0)).alias("outer"))
        sources = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
        blocks = F.ceil(F.col("source_size") / self.block)
        quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long")
        sources = sources.withColumns({"blocks": blocks, "quota": quota})
        first = F.coalesce(F.sum("quota").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.sources = materialize(sources.withColumn("first", first), "sources")
        self.n_slots = self.sources.agg(F.sum("quota")).first()[0] or 0
        known = self.sources.select("source", "rank", "source_size", "target").alias("k")
        starts = parts.alias("q").join(known, F.col("q.source").eqNullSafe(F.col("k.source")))
        starts = starts.select("q.source", "bucket", "outer", "rank", "source_size", "target").alias("p")
        on = F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.bucket") == F.col("p.bucket"))
        self.rows = sized.alias("s").join(starts, on).select(
            "s.*", "rank", "source_size", "target", (F.col("outer") + F.col("inner")).alias("start")
        )

    def counts(self) -> DataFrame:
        """rank, shard, count: how many slots of each source every output shard draws."""
        n = self.n_slots
        # Slots p belong to sources by intervals, found through bins of equal width: no source's interval meets in one task.
        last = (F.col("first") + F.col("quota") - 1) / BIN
        bins = self.sources.where("quota > 0").select("rank", "first", "quota", F.explode(F.sequence(F.floor(F.col("first") / BIN), F.floor(last))).alias("bin"))
        throws = self.spark.range(n).select(F.col("id").alias("p"), F.floor(F.col("id") / BIN).alias("bin"))
        thrown = throws.join(bins, "bin").where("p >= first and p < first + quota")
        shard = F.pmod(F.xxhash64(F.lit(self.seed), F.lit("shard"), "p"), F.lit(max(1, -(-n // SHARD_SLOTS))))
        return thrown.groupBy("rank", shard.alias("shard")).agg(F.count(F.lit(1)).alias("count"))

    def slots(self) -> DataFrame:
        """shard, slot, source rank, epoch and block of every output slot."""
        # The numbers of a source's slots before a shard: sums over bins of shards, then within a bin.
        counts = self.counts().withColumn("bin", F.floor(F.col("shard") / BIN))
        before = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = counts.groupBy("rank", "bin").agg(F.sum("count").alias("count")).select("rank", "bin", before(Window.partitionBy("rank").orderBy("bin")).alias("outer"))
        placed = counts.withColumn("inner", before(Window.partitionBy("rank", "bin").orderBy("shard"))).join(bins, ["rank", "bin"])
        shard = Window.partitionBy("shard")
        placed = placed.withColumns({"base": before(shard.orderBy("rank")), "size": F.sum("count").over(shard), "start": F.col("outer") + F.col("inner")})
        known = self.sources.select("rank", "blocks")
        # Small rows and much work behind them: tasks by the number of slots, not by bytes.
        tasks = max(self.spark.sparkContext.defaultParallelism, self.n_slots // SLOTS_EACH)
        each = placed.repartition(tasks, "rank", "shard").join(known, "rank").select("rank", "shard", "blocks", "start", "base", "size", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("k"))
        t = F.col("start") + F.col("k")
        epoch = F.floor(t / F.col("blocks"))
        block = permuted(t % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(self.seed), F.lit("blocks"), "rank", epoch))
        slot = permuted(F.col("base") + F.col("k"), F.col("size"), F.xxhash64(F.lit(self.seed), F.lit("slots"), "shard"))
        return each.select("rank", epoch.cast("int").alias("epoch"), block.alias("block"), "shard", slot.alias("slot"))

    def segments(self) -> DataFrame:
        """The rows cut at block borders: block (null without words) and the words of the row in it, from its word ``at`` on."""
        end = F.col("start") + F.col("size")
        blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / self.block), F.floor((end - 1) / self.block)))
        cut = self.rows.withColumn("block", F.explode_outer(blocks))
        left, right = F.greatest("start", F.col("block") * self.block), F.least(end, (F.col("block") + 1) * self.block)
        return cut.withColumns({"words": F.coalesce(right - left, F.lit(0)), "at": left - F.col("start")})


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words of the row that the mix takes, repeats counted."""
    mix = Mix(docs, block_words, seed)
    uses = mix.slots().groupBy("rank", "block").agg(F.count(F.lit(1)).alias("uses"))
    return (
        mix.segments()
        .join(uses, ["rank", "block"], "left")
        .groupBy("rank", "bucket", "idx")
        .agg(
            *[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")],
            F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken"),
        )
        .drop("rank", "bucket", "idx")
    )


def output_shards(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """The mix as shards: shard, slot (gapless from 0), source, epoch, block and text, the block's words joined by single spaces."""
    words = F.coalesce(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))
    mix = Mix(docs.select("doc_id", "source", "text", words.alias("words")), block_words, seed, keep=["words"])
    end, low = F.col("start") + F.col("size"), lambda b: F.greatest(F.col("start"), b * block_words)
    high = lambda b: F.least(end, (b + 1) * block_words)
    numbers = F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))
    part = lambda b: F.slice("words", (low(b) - F.col("start") + 1).cast("int"), (high(b) - low(b)).cast("int"))
    cut = mix.rows.where("size > 0").select("rank", "source", F.explode(F.transform(numbers, lambda b: F.struct(b.alias("block"), low(b).alias("at"), part(b).alias("part")))).alias("e"))
    blocks = cut.groupBy("rank", "source", "e.block").agg(F.array_sort(F.collect_list(F.struct("e.at", "e.part"))).alias("parts"))
    text = F.array_join(F.flatten(F.transform("parts", lambda x: x["part"])), " ")
    return mix.slots().join(blocks, ["rank", "block"]).select("shard", "slot", "source", "epoch", "block", text.alias("text"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each epoch that takes words of a document.

    Where an epoch takes every word the text stays as it is; else it is the taken words, joined by single spaces.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "source")]
    rows = docs.withColumn("_all", F.struct(*[F.col(f"`{c}`") for c in rest])).select("_all", "doc_id", "source", "text")
    mix = Mix(rows, block_words, seed, keep=["_all"])
    used = mix.slots().groupBy("rank", "block").agg(F.collect_set("epoch").alias("epochs"))
    cut = mix.segments().where("size > 0").drop("_all").join(used, ["rank", "block"], "left")
    lists = cut.groupBy("rank", "bucket", "idx").agg(
        F.array_sort(F.collect_list(F.struct("at", F.col("words").cast("int").alias("words"), F.coalesce("epochs", F.array().cast("array<int>")).alias("epochs")))).alias("cuts")
    )
    whole = mix.rows.select("rank", "bucket", "idx", "_all", "doc_id", "source").join(lists, ["rank", "bucket", "idx"])
    each = whole.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))))
    some = each.where(F.exists("cuts", lambda c: F.array_contains(c["epochs"], F.col("epoch"))))
    every = F.forall("cuts", lambda c: F.array_contains(c["epochs"], F.col("epoch")))
    mask = F.flatten(F.transform("cuts", lambda c: F.array_repeat(F.array_contains(c["epochs"], F.col("epoch")), c["words"])))
    words = F.regexp_extract_all("_all.text", F.lit(f"({WORD})"), F.lit(1))
    pairs = F.filter(F.zip_with(words, mask, lambda w, m: F.struct(w.alias("w"), m.alias("m"))), lambda x: x["m"])
    text = F.when(every, F.col("_all.text")).otherwise(F.array_join(F.transform(pairs, lambda x: x["w"]), " "))
    values = {c: F.col(f"_all.`{c}`") for c in rest} | {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": text}
    return some.select(*[values[c].alias(c) for c in docs.columns])
