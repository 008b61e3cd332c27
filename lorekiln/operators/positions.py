"""Places in long texts: sentences and paragraphs as rows, and which of them holds an offset, by one sorted sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _JVM_SENTENCE_END, _WHITE, occurrences, stripped
from ..plans.proxy import Model
from ..plans.registry import query

#: Characters of a stretch of text that one window of the sweep covers.
STRETCH = 1 << 16


def _placed(texts: DataFrame, key: str, pieces: Column, gap: int) -> DataFrame:
    """(key, _k, _piece, _at): a text's pieces as rows with their offsets, ``gap`` characters between them."""
    rows = texts.select(key, F.posexplode(pieces).alias("_k", "_piece"))
    before = F.sum(F.char_length("_piece") + gap).over(Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_at", F.coalesce(before, F.lit(0)))


def sentence_rows(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, index, start, end, text) of each sentence: a running sum over a text's parts, linear in their number.

    Offsets are those of the stripped sentence; empty ones are left out and not counted.  Keys must be unique.
    """
    parts = _placed(texts, key, F.split(column, _JVM_SENTENCE_END, -1), 1)
    left = F.char_length("_piece") - F.char_length(F.regexp_replace("_piece", rf"(?U)^{_WHITE}+", ""))
    found = parts.select(key, "_k", (F.col("_at") + left).alias("start"), stripped(F.col("_piece")).alias("text")).where("text <> ''")
    index = F.row_number().over(Window.partitionBy(key).orderBy("_k")) - 1
    return found.select(key, index.alias("index"), "start", (F.col("start") + F.char_length("text")).alias("end"), "text")


def paragraph_rows(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, index, start, end, text) of each paragraph, between blank lines; empty ones are left out but counted."""
    parts = _placed(texts, key, F.split(column, "\n\n", -1), 2).where("trim(_piece) <> ''")
    return parts.select(key, F.col("_k").alias("index"), F.col("_at").alias("start"), (F.col("_at") + F.char_length("_piece")).alias("end"), F.col("_piece").alias("text"))


def membership(offsets: DataFrame, intervals: DataFrame, key: str, stretch: int = STRETCH) -> DataFrame:
    """``offsets`` (key, place, whatever else) with ``index``: that of the interval (key, index, start, end) with start <= place < end, null if none.

    Intervals of a key must not overlap.  Starts and offsets are sorted together once, and each offset takes the
    last start before it: the work grows with both, not with their product.  Texts are cut into stretches, to each of
    which an interval goes that reaches into it, so that a long text's offsets are not one task's.
    """
    others = [c for c in offsets.columns if c != key]
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row")
    asked = offsets.select(F.col(key).alias("_key"), F.col("place").cast("long").alias("_at"), F.lit(None).cast("struct<index:int,end:bigint>").alias("_open"), row, F.lit(1).alias("_kind"))
    first, last = F.floor(F.col("start") / stretch), F.floor((F.col("end") - 1) / stretch)
    reach = intervals.where(F.col("end") > F.col("start")).select(F.col(key).alias("_key"), "index", "start", "end", F.explode(F.sequence(first, last)).alias("_part"))
    opened = F.struct(F.col("index").cast("int").alias("index"), F.col("end").cast("long").alias("end"))
    starts = reach.select("_key", F.greatest(F.col("start"), F.col("_part") * stretch).cast("long").alias("_at"), opened.alias("_open"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_kind"))
    both = starts.unionByName(asked).withColumn("_part", F.floor(F.col("_at") / stretch))
    sweep = Window.partitionBy("_key", "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("_in", F.last("_open", ignorenulls=True).over(sweep)).where("_kind = 1")
    index = F.when(F.col("_at") < F.col("_in.end"), F.col("_in.index")).alias("index")
    return swept.select(F.col("_key").alias(key), *[F.col(f"_row.`{c}`").alias(c) for c in others], index)


def mention_places(mentions: DataFrame, texts: DataFrame, key: str, column: str) -> DataFrame:
    """``mentions`` (key, place, whatever else) with sentence_index and paragraph_index of their text, null outside of both."""
    in_sentence = membership(mentions, sentence_rows(texts, key, column), key).withColumnRenamed("index", "sentence_index")
    return membership(in_sentence, paragraph_rows(texts, key, column), key).withColumnRenamed("index", "paragraph_index")


#: Every so many characters the sweep's query asks for the line.
STEP = 97


@query(
    "j13b_interval_sweep",
    f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
placed AS (SELECT doc_id, i, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start, length(line) AS n FROM lines),
asked AS (SELECT doc_id, unnest(range(0, length(text), {STEP})) AS place FROM documents),
last AS (SELECT a.doc_id, a.place, p.i, p.start, p.n FROM asked a ASOF LEFT JOIN (SELECT * FROM placed WHERE n > 0) p ON a.doc_id = p.doc_id AND a.place >= p.start)
SELECT doc_id, place, CASE WHEN place < start + n THEN CAST(i AS INTEGER) END AS line FROM last""",
)
def j13b(m: Model) -> DataFrame:
    docs = m.table("documents")
    lines = _placed(docs, "doc_id", F.split("text", "\n", -1), 1).select("doc_id", F.col("_k").alias("index"), F.col("_at").alias("start"), (F.col("_at") + F.char_length("_piece")).alias("end"))
    last = F.char_length("text") - 1
    asked = docs.where("text <> ''").select("doc_id", F.explode(F.sequence(F.lit(0), last, F.lit(STEP))).alias("place")).withColumn("place", F.col("place").cast("long"))
    return membership(asked, lines, "doc_id").select("doc_id", "place", F.col("index").alias("line"))


@query("j13c_mention_places")
def j13c(m: Model) -> DataFrame:
    docs = m.table("documents").where("doc_id IS NOT NULL")
    places = docs.select("doc_id", F.explode(occurrences(F.col("text"), F.lit(" the "))).alias("place"))
    return mention_places(places, docs, "doc_id", "text")
