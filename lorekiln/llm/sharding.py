"""Two-pass external shuffle of a collection into shards.

Pass one scatters records over memory-sized buckets by seeded hashes; pass two shuffles each bucket
with Fisher-Yates and writes it.  The law is ``key``: jump consistent hashing of doc_id and the shard
count picks the shard, so that one more shard takes rows only into itself.  Buckets subdivide shards,
and a record's bucket depends on its id and its text, so that equal texts or a hot source do not meet.

Each shard has as many buckets as its own bytes ask for, and the exchange as many partitions as there are
buckets.  Rows equal in id and text that exceed a quarter of a bucket together are scattered by their place
in the input, since no hash tells them apart.

Cases: null text is kept as null, of size 8 and with the crc32 of no bytes; all rows of a null doc_id are
in one shard, as the law asks, but in different buckets; equal rows take slots in no defined order among
themselves.  A text longer than a bucket makes that bucket as large as itself.  An empty table gives no
shard at all.  Extra columns are not written, whatever their names.
"""

from __future__ import annotations

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 24
BUCKET_BYTES = 16 << 20


def jump_hash(key: int, shards: int) -> int:
    """Lamping and Veach's jump consistent hash of an unsigned 64-bit key."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _shards_of(n: int, seed: int):
    @F.pandas_udf("shard int, grown_shard int")
    def shards(key: pd.Series) -> pd.DataFrame:
        keys = [k & 0xFFFFFFFFFFFFFFFF for k in key]
        return pd.DataFrame({"shard": [jump_hash(k, n) for k in keys], "grown_shard": [jump_hash(k, n + 1) for k in keys]}).astype("int32")

    return shards(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _fisher_yates(seed: int):
    def shuffle(group: pa.Table) -> pa.Table:
        group = group.sort_by("order")
        rng = random.Random(f"{seed}/{group['shard'][0]}/{group['bucket'][0]}")
        at = list(range(len(group)))
        for i in range(len(at) - 1, 0, -1):
            j = rng.randrange(i + 1)
            at[i], at[j] = at[j], at[i]
        return group.drop_columns("order").take(at).append_column("pos", pa.array(range(len(at)), pa.int64()))

    return shuffle


def _repeated(docs: DataFrame, bytes_: int) -> DataFrame | None:
    """(id, tie, copies) of the rows equal in id and text that are more than ``bytes_`` together; copies: in how many parts."""
    groups = docs.groupBy(F.col("doc_id").alias("id"), F.xxhash64("text").alias("same")).agg(F.sum(record_size(F.col("text"))).alias("size"), F.count(F.lit(1)).alias("n"))
    large = groups.where((F.col("n") > 1) & (F.col("size") > bytes_)).select("id", "same", F.ceil(F.col("size") / bytes_).cast("int").alias("parts"))
    return large if large.limit(1).count() else None


def shard(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = 7) -> DataFrame:
    """The shuffled shards as written: doc_id, text, shard, slot, grown_shard; a file holds whole buckets."""
    docs = docs.select("doc_id", "text")
    sized = docs.select(_shards_of(shards, seed)["shard"].alias("shard"), record_size(F.col("text")).alias("size"))
    bytes_of = {r["shard"]: r["bytes"] for r in sized.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}  # a row a shard
    buckets = {k: -(-n // bucket_bytes) for k, n in bytes_of.items()}
    rows = docs.withColumn("order", F.xxhash64(F.lit(seed + 1), "doc_id", "text")).withColumn("spread", F.col("order"))
    repeated = _repeated(docs, bucket_bytes // 4)
    if repeated is not None:
        on = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("same"))
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))
        rows = rows.join(repeated, on, "left").withColumn("spread", F.when(F.col("parts").isNull(), F.col("order")).otherwise(F.xxhash64("order", part)))
    many = F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv]) if buckets else F.lit(None).cast("map<int,int>")
    rows = rows.select("doc_id", "text", "order", "spread", _shards_of(shards, seed).alias("to")).select("doc_id", "text", "to.*", "order", "spread")
    rows = rows.withColumn("bucket", F.pmod("spread", many[F.col("shard")]).cast("int")).drop("spread")
    kind = dict(docs.dtypes)["doc_id"]
    dealt = rows.repartition(max(1, sum(buckets.values())), "shard", "bucket")
    done = dealt.groupBy("shard", "bucket").applyInArrow(_fisher_yates(seed), f"doc_id {kind}, text string, shard int, grown_shard int, bucket int, pos long")
    written = materialize(done, "shards")
    sizes = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return written.join(starts, ["shard", "bucket"]).select(
        "doc_id", "text", "shard", (F.col("start") + F.col("pos")).alias("slot"), "grown_shard"
    )
