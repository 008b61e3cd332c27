"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shared import materialize, release, shared_dir

__all__ = ["materialize", "release", "shared_dir"]

#: The white space that the contracts name, as characters.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of whole texts that a Python worker turns into Python objects at a time.  Spark itself bounds an Arrow batch
#: to spark.sql.execution.arrow.maxBytesPerBatch (64 MB), so no operator changes the session's settings.
TEXT_ROWS = 256


def pieces(batch: pa.RecordBatch, rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in slices of so many rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


#: A key that holds this share of the counted rows or more is joined by broadcast: there are at most so many such keys.
HEAVY = 4096


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, values: list[str]) -> DataFrame:
    """``rows`` with ``values`` of their key, null where ``keys`` (written tables, unique by ``on``) has none.

    Keys whose ``count`` is a 4096th of all counts are broadcast, 4096 rows at most; the others are shuffled,
    so that no task gets more of one key than that share.  Rows that found a heavy key, and rows with a null
    in their key, are dealt out at random in that shuffle.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    named = [F.col(c).alias(f"_on{k}") for k, c in enumerate(on)]
    found = F.struct(*[F.col(c) for c in values])
    heavy = keys.where(F.col(count) * HEAVY >= total).select(*named, found.alias("_heavy"))
    light = keys.where(F.col(count) * HEAVY < total).select(F.xxhash64(*on).alias("_to"), *named, found.alias("_light"))
    same = lambda: [F.col(c) == F.col(f"_on{k}") for k, c in enumerate(on)]
    first = rows.join(F.broadcast(heavy), same(), "left").drop(*[f"_on{k}" for k in range(len(on))])
    alone = F.col("_heavy").isNotNull()
    for c in on:
        alone = alone | F.col(c).isNull()
    dealt = first.withColumn("_by", F.when(alone, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(*on)))
    both = dealt.join(light, [F.col("_by") == F.col("_to"), F.col("_heavy").isNull(), *same()], "left")
    return both.select(*rows.columns, *[F.coalesce(f"_heavy.{c}", f"_light.{c}").alias(c) for c in values])


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``df`` beside the whole row as struct ``row``: an operator's own names then clash with none of the input's."""
    return df.select(*[F.col(c) for c in columns], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone, as the contracts ask."""
    return F.translate(col, UPPER, UPPER.lower())


def fold(text: str, extra: str = "") -> Column:
    """128 bits of a text as two independently seeded 64-bit hashes in a struct."""
    return F.struct(F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.lit(f"second{extra}"), F.col(text)).alias("b"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4: rows never learned from (null ids: never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def map_columns(df: DataFrame, make: Callable[[], Callable[..., list[list]]], schema: T.StructType | str, rows: int = TEXT_ROWS) -> DataFrame:
    """``df`` through Python: ``make()`` gives, once in a partition, a function from column lists of up to ``rows`` rows to column lists.

    Unlike pandas, lists keep nulls apart from NaN and 64-bit integers whole.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(fields)
        f = make()
        for b in batches:
            for part in pieces(b, rows):
                columns = f(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, fields)
