"""Substring search over stored texts by an index of their pieces of three characters, written once and read by key."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.proxy import Model, over
from ..plans.registry import query
from ..plans.shared import shared_dir

#: Folders that the index is dealt to by piece: a search reads those of its term's pieces.
BUCKETS = 256
#: Of a term's pieces so many of the rarest are looked up; the texts that have them are verified.
LOOKED_UP = 3


def grams(text: Column) -> Column:
    """The distinct pieces of three code points of a lower-cased text, in time linear in its length."""
    letters = F.split(F.lower(text), "")
    rest = lambda k: F.slice(letters, k, F.greatest(F.size(letters), F.lit(1)))
    joined = lambda a, b: F.concat(a, b)
    pairs = F.zip_with(letters, rest(2), joined)
    return F.array_distinct(F.filter(F.zip_with(pairs, rest(3), joined), lambda g: g.isNotNull()))


#: Characters of texts whose postings are put together before they are sent on.
CHARACTERS = 1 << 21


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Where a slice of about CHARACTERS starts, and its texts; nulls are empty."""
    at, held, size = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= CHARACTERS:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def _holders(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The pieces of the texts (those of ``grams``, lower case given), where each one's texts begin, and the texts by number."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n = max(0, len(points) - 2)
    inside = text[:n] == text[2:]
    pieces, text = (points[:n] << np.uint64(42) | points[1 : n + 1] << np.uint64(21) | points[2:])[inside], text[:n][inside]
    order = np.argsort(pieces, kind="stable")  # a piece's texts stay in order
    pieces, text = pieces[order], text[order]
    new = np.append(True, pieces[1:] != pieces[:-1])[: len(pieces)]
    once = new | np.append(True, text[1:] != text[:-1])[: len(pieces)]
    pieces, text, first = pieces[once], text[once], np.flatnonzero(new[once])
    found, low = pieces[first], np.uint64((1 << 21) - 1)
    spelled = np.stack([found >> np.uint64(42), found >> np.uint64(21) & low, found & low], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [spelled[k : k + 3] for k in range(0, len(spelled), 3)], np.append(first, len(text)), text


def term_grams(term: str) -> list[str]:
    low = term.lower()
    return sorted({low[at : at + 3] for at in range(len(low) - 2)})


class TextIndex:
    """Postings (field, gram, keys), a row for some texts that hold the gram, and how many texts each gram has; both in folders by the hash of field and gram."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("field", "gram"), F.lit(self.buckets)).cast("int").alias("bucket")

    def write(self, texts: DataFrame, fields: list[str]) -> None:
        """Index the ``fields`` of ``texts``; null texts have no pieces, and keys needn't be unique."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for field, column in zip(fields, b.columns[1:], strict=True):
                    for at, some in _slices(column):
                        pieces, starts, text = _holders(some)
                        keys = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), b.column(0).take(pa.array(at + text)))
                        yield pa.RecordBatch.from_arrays([pa.array([field] * len(pieces), pa.string()), pa.array(pieces, pa.string()), keys], ["field", "gram", "keys"])

        lowered = texts.select(F.col(self.key), *[F.lower(F.col(f)) for f in fields])
        postings = lowered.mapInArrow(run, f"field string, gram string, keys array<{dict(texts.dtypes)[self.key]}>").withColumn("bucket", self._bucket())
        # Frequent pieces are dealt to several tasks, and so files, of their bucket.
        dealt = postings.repartition(F.col("bucket"), F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.lit(16)))
        dealt.sortWithinPartitions("bucket", "field", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        counted = self.spark.read.parquet(f"{self.path}/postings").groupBy("bucket", "field", "gram").agg(F.sum(F.size("keys")).alias("n"))
        counted.repartition("bucket").sortWithinPartitions("bucket", "field", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts")

    def _read(self, table: str, wanted: list[tuple[str, str]]) -> DataFrame:
        """The rows of some (field, gram): only their folders are listed by the scan, and in them the row groups that hold the grams."""
        keys = self.spark.createDataFrame(wanted, "field string, gram string").select("field", "gram", self._bucket())
        where = [(r["bucket"], r["field"], r["gram"]) for r in keys.collect()]  # as many as the term has pieces
        rows = self.spark.read.parquet(f"{self.path}/{table}").where(F.col("bucket").isin(sorted({w[0] for w in where})))
        return rows.where(F.col("gram").isin(sorted({w[2] for w in where})) & F.col("field").isin(sorted({w[1] for w in where})))

    def candidates(self, field: str, term: str) -> DataFrame | None:
        """(key) of the texts that have the term's rarest pieces; None for terms of less than three characters, which have none."""
        pieces = term_grams(term)
        if not pieces:
            return None
        known = self._read("counts", [(field, g) for g in pieces]).orderBy("n", "gram").select("gram").collect()
        if len(known) < len(pieces):
            return self._read("postings", [(field, pieces[0])]).select(F.explode("keys").alias("key")).limit(0)  # a piece that no text has
        rare = [r["gram"] for r in known[:LOOKED_UP]]
        found = self._read("postings", [(field, g) for g in rare]).select("gram", F.explode("keys").alias("key")).groupBy("key").agg(F.count_distinct("gram").alias("n"))
        return found.where(F.col("n") == len(rare)).select("key")

    def search(self, texts: DataFrame, terms: dict[str, str]) -> DataFrame:
        """The rows of ``texts`` of which some field holds its term, whatever the case: candidates by the index, verified on the text."""
        holds = {f: F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(t.lower())) for f, t in terms.items()}
        any_of = reduce(Column.__or__, holds.values())
        asked = {f: self.candidates(f, t) for f, t in terms.items()}
        if any(c is None for c in asked.values()):
            return texts.where(any_of)  # too short for the index: every text is looked at
        keys = reduce(DataFrame.unionByName, asked.values()).distinct()
        return texts.join(keys, texts[self.key] == keys["key"], "left_semi").where(any_of)


@query("f24b_indexed_search", over("texts", "SELECT id FROM texts WHERE contains(lower(coalesce(title, '')), 'ation') OR contains(lower(content), 'idiot')"))
def f24b(m: Model) -> DataFrame:
    index = TextIndex(m.spark, f"{shared_dir(m.spark)}/index", "id", 16)
    index.write(m.texts, ["title", "content"])
    return index.search(m.texts, {"title": "ation", "content": "Idiot"}).select("id")
