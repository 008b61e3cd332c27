"""Line-level deduplication of a document collection, by DataFrame functions alone.

Lines are exploded, normalised and hashed; distinct documents are counted for each hash; lines whose
hash reaches the threshold are dropped everywhere but in the largest doc_id that holds them; what is
left of a text is put together again by position.

A line that very many documents share is no hot key: such lines are joined by broadcast (4096 at most),
the others by a shuffle in which each holds a small share.

Cases: a null or empty text is one empty line, which is too short ever to be dropped.  Rows that
repeat a doc_id count as one document and each is reduced by itself; equal rows get equal results each.
Rows without doc_id are left whole and count for nothing.  A text that loses every line becomes empty.
An empty table gives no rows.  A very long text is split in the task that reads it; nothing of it is cut.
Columns besides doc_id and text pass through unread, whatever their names; columns named like the
operator's own results (n_lines, n_dropped) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, materialize, spread_join

MIN_CHARS = 20
MIN_DOCS = 3


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of the lines long enough to be dropped; row tells apart texts under one doc_id."""
    lines = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("row"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(
        "doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2")
    )


def repeated_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n, last_doc) of the keys found in at least ``min_docs`` documents.

    Keys are made distinct within a row first, so that a plain count, combined before the shuffle,
    counts documents; only where doc_ids repeat is a distinct count needed.
    """
    hashes = F.array_distinct(
        F.transform(
            F.filter(F.transform(split_lines(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars),
            lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2")),
        )
    )
    one = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.explode(hashes).alias("k"))
    one = one.select("doc_id", "k.h1", "k.h2")
    repeats = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").limit(1).count()
    documents = F.count_distinct("doc_id") if repeats else F.count("doc_id")
    return (
        one.groupBy("h1", "h2")
        .agg(documents.alias("n"), F.max("doc_id").alias("last_doc"))
        .where(F.col("n") >= min_docs)
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` reduced, and n_lines, n_dropped (longs) added."""
    own = ["n_lines", "n_dropped"]
    rest = [c for c in docs.columns if c not in ("text", *own)]
    repeated = materialize(repeated_keys(docs, min_chars, min_docs), "repeated")
    gone = (
        spread_join(_keyed_lines(docs, min_chars), repeated, ["h1", "h2"], "n", ["last_doc"])
        .where("doc_id <> last_doc")
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        .select(F.col("doc_id").alias("to_doc"), F.col("row").alias("to_row"), "gone")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")  # so that no name of the input clashes
    kept = docs.select("doc_id", "text", row).join(gone, (F.col("doc_id") == F.col("to_doc")) & (F.xxhash64("text") == F.col("to_row")), "left")
    # A mask from the gaps between dropped positions: linear in lines, whatever the number dropped.
    end = F.size(split_lines(F.col("text")))
    mask = F.flatten(
        F.zip_with(
            F.concat(F.array(F.lit(-1)), F.col("gone")),
            F.concat(F.col("gone"), F.array(end)),
            lambda p, q: F.concat(F.array_repeat(F.lit(True), q - p - 1), F.array(F.lit(False))),
        )
    )
    pairs = F.zip_with(split_lines(F.col("text")), mask, lambda line, keep: F.struct(line.alias("line"), keep.alias("keep")))
    left = F.array_join(F.transform(F.filter(pairs, lambda x: x["keep"]), lambda x: x["line"]), "\n")
    return kept.select(
        *[F.col(f"row.`{c}`").alias(c) for c in rest],
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(left).alias("text"),
        end.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
