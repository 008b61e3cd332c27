"""Topics over time, their entities, and a topic model from counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import RegexTokenizer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import meaningful, topic_label
from ..plans.proxy import AS_OF, Model, over
from ..plans.registry import query
from ..plans.shared import materialize, release
from .aggregates import days_before, ts


def topic_trends(topics: DataFrame, article_topics: DataFrame, articles: DataFrame, as_of: str = AS_OF, span: int = 7) -> DataFrame:
    """Dates, articles of the last span and the one before, velocity in percent and direction.

    A pair (topic, article) occurs once, so plain conditional counts count distinct articles.
    """
    dated = article_topics.join(articles.select(F.col("id").alias("article_id"), "published_date"), "article_id").where(F.col("published_date") <= ts(as_of))
    last = F.col("published_date") >= days_before(as_of, span)
    before = ~last & (F.col("published_date") >= days_before(as_of, 2 * span))
    counts = dated.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("articles"), F.min("published_date").alias("first"), F.max("published_date").alias("latest"), F.count_if(last).alias("this_span"), F.count_if(before).alias("last_span")
    )
    velocity = F.when(F.col("last_span") > 0, (F.col("this_span") - F.col("last_span")) * 100.0 / F.col("last_span")).when(F.col("this_span") > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    scored = topics.select("topic_id", "topic_label").join(counts, "topic_id").withColumn("velocity", F.round(velocity, 2))
    return scored.withColumn("direction", F.when(F.col("velocity") > 15, "rising").when(F.col("velocity") < -15, "falling").otherwise("stable"))


_TREND = """c AS (SELECT topic_id, count(*) AS articles, min(published_date) AS first, max(published_date) AS latest, count(*) FILTER (WHERE published_date >= TIMESTAMP '2001-06-02') AS this_span, count(*) FILTER (WHERE published_date < TIMESTAMP '2001-06-02' AND published_date >= TIMESTAMP '2001-04-03') AS last_span
 FROM article_topics x JOIN articles a ON a.id = x.article_id WHERE published_date <= TIMESTAMP '2001-08-01' GROUP BY 1),
v AS (SELECT t.topic_id, topic_label, articles, first, latest, this_span, last_span, round(CASE WHEN last_span > 0 THEN (this_span - last_span) * CAST(100 AS DOUBLE) / last_span WHEN this_span > 0 THEN 100 ELSE 0 END, 2) AS velocity FROM topics t JOIN c ON c.topic_id = t.topic_id),
trend AS (SELECT *, CASE WHEN velocity > 15 THEN 'rising' WHEN velocity < -15 THEN 'falling' ELSE 'stable' END AS direction FROM v)"""


@query("a09_topic_trends", over("topics article_topics articles", "SELECT * FROM trend", _TREND))
def a09(m: Model) -> DataFrame:
    return topic_trends(m.topics, m.article_topics, m.articles, span=60)


@query("a10_trending", over("topics article_topics articles", "SELECT topic_id, topic_label, velocity FROM trend WHERE last_span > 0 ORDER BY velocity DESC, topic_id LIMIT 10", _TREND))
def a10(m: Model) -> DataFrame:
    return a09(m).where("last_span > 0").orderBy(F.desc("velocity"), "topic_id").limit(10).select("topic_id", "topic_label", "velocity")


def importance(articles: Column, direction: Column, velocity: Column, days: Column) -> Column:
    """Twice the articles up to 100, times the trend's factor, plus a bonus for recent coverage."""
    factor = F.when(direction == "rising", 1 + F.least(F.abs(velocity) / 100, F.lit(0.5))).when(direction == "falling", F.greatest(F.lit(0.7), 1 - F.abs(velocity) / 200)).otherwise(1.0)
    bonus = F.when(days < 1, 20).when(days < 3, 10).when(days < 7, 5).otherwise(0)
    return F.least(articles * 2, F.lit(100)) * factor + bonus


@query("o04_topic_importance", over("topics article_topics articles", "SELECT topic_id, round(least(this_span * 2, 100) * CASE direction WHEN 'rising' THEN 1 + least(abs(velocity) / 100, 0.5) WHEN 'falling' THEN greatest(0.7, 1 - abs(velocity) / 200) ELSE 1.0 END + CASE WHEN d < 1 THEN 20 WHEN d < 3 THEN 10 WHEN d < 7 THEN 5 ELSE 0 END, 4) AS importance FROM (SELECT *, date_diff('day', CAST(latest AS DATE), DATE '2001-08-01') AS d FROM trend)", _TREND))
def o04(m: Model) -> DataFrame:
    days = F.datediff(F.to_date(F.lit(AS_OF).cast("timestamp_ntz")), F.to_date("latest"))
    return a09(m).select("topic_id", F.round(importance(F.col("this_span"), F.col("direction"), F.col("velocity"), days), 4).alias("importance"))


def timeline(articles: DataFrame, grain: str) -> DataFrame:
    return articles.groupBy(F.date_trunc(grain, "published_date").cast("timestamp_ntz").alias("bucket")).agg(F.count_distinct("id").alias("articles"))


for _grain in ("day", "week", "month"):

    @query(f"a11_timeline_{_grain}", over("articles", f"SELECT date_trunc('{_grain}', published_date)::TIMESTAMP AS bucket, count(DISTINCT id) AS articles FROM articles GROUP BY 1"))
    def a11(m: Model, grain: str = _grain) -> DataFrame:
        return timeline(m.articles, grain)


def topic_entities(facts: DataFrame, article_topics: DataFrame, limit: int = 10) -> DataFrame:
    """The most mentioned entities of each topic."""
    counted = facts.join(article_topics.select("article_id", "topic_id"), "article_id").groupBy("topic_id", "entity").agg(F.count(F.lit(1)).alias("mentions"))
    # A rank with a limit: each task of the shuffle's map side sends no more than the best of a topic.
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("mentions"), "entity"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


@query("a12_topic_entities", over("facts article_topics", "SELECT topic_id, entity, mentions FROM (SELECT topic_id, entity, count(*) AS mentions, row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, entity) AS k FROM facts f JOIN article_topics x ON x.article_id = f.article_id GROUP BY 1, 2) WHERE k <= 10"))
def a12(m: Model) -> DataFrame:
    return topic_entities(m.facts, m.article_topics)


def ctfidf(words: DataFrame, class_column: str) -> DataFrame:
    """Class-based TF-IDF of (class, word, n): frequency in the class times ln(1 + mean class size / frequency overall)."""
    classes = words.groupBy(class_column).agg(F.sum("n").alias("size"))
    mean = classes.agg(F.avg("size").alias("mean"))
    total = words.groupBy("word").agg(F.sum("n").alias("all"))
    joined = words.join(classes, class_column).join(total, "word").crossJoin(F.broadcast(mean))
    return joined.withColumn("score", _class_score())


def _class_score() -> Column:
    return F.col("n") / F.col("size") * F.ln(1 + F.col("mean") / F.col("all"))


@query("g12_ctfidf", "WITH w AS (SELECT p_type AS topic, unnest(string_split(p_name, ' ')) AS word FROM part), n AS (SELECT topic, word, count(*) AS n FROM w GROUP BY 1, 2), s AS (SELECT topic, sum(n) AS size FROM n GROUP BY 1), a AS (SELECT word, sum(n) AS alln FROM n GROUP BY 1) SELECT topic, word, round(n / CAST(size AS DOUBLE) * ln(1 + (SELECT avg(size) FROM s) / alln), 6) AS score FROM n JOIN s USING (topic) JOIN a USING (word) WHERE n / CAST(size AS DOUBLE) * ln(1 + (SELECT avg(size) FROM s) / alln) >= 0.01")
def g12(m: Model) -> DataFrame:
    words = m.table("part").select(F.col("p_type").alias("topic"), F.explode(F.split("p_name", " ")).alias("word")).groupBy("topic", "word").agg(F.count(F.lit(1)).alias("n"))
    return ctfidf(words, "topic").where("score >= 0.01D").select("topic", "word", F.round("score", 6).alias("score"))


#: Dimensions that terms are hashed to: no term is left out for want of a place in a vocabulary.
TERM_BITS = 18
#: The topic of articles that belong to none: without terms, or of a topic with too few articles.
OUTLIER = -1


#: Words of texts whose terms are counted together before they are sent on, and terms of a task that puts counts together.
TOGETHER, BUCKET = 1 << 17, 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _terms(lengths: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place of its first word) of the words, pairs and triples of consecutive texts, of the words' 64-bit hashes."""
    text, at = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(words))
    hashes, texts, places = [_mix(words + np.uint64(1))], [text], [at]
    for n in (2, 3):
        longer = _mix(hashes[-1][: max(0, len(words) - n + 1)] ^ _mix(words[n - 1 :] + np.uint64(n)))
        hashes.append(longer)
    for n in (2, 3):
        inside = text[: max(0, len(words) - n + 1)] == text[n - 1 :]
        hashes[n - 1] = hashes[n - 1][inside]
        texts.append(text[: len(inside)][inside])
        places.append(at[: len(inside)][inside])
    return np.concatenate(hashes), np.concatenate(texts), np.concatenate(places)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with a column ``hashed``, of about TOGETHER words or one text: the rows, their lengths and their words' hashes."""
    for b in batches:
        ends = np.concatenate([[0], np.cumsum(b.column("hashed").value_lengths().to_numpy(zero_copy_only=False))])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER, "right")) - 1)
            rows = b.slice(at, to - at)
            yield rows, np.diff(ends[at : to + 1]), rows.column("hashed").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = to


#: A term of a block: its distance from the one before, its topic, whether several texts of the block hold it, its count.
_ENTRY = np.dtype([("step", "<u8"), ("topic", "<u2"), ("several", "u1"), ("n", "<u4")])


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's ``n``."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    return key[order][first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _blocks(hashed: DataFrame, topics: int, buckets: int) -> DataFrame:
    """(bucket, size, block) of (topic_id, hashed): what the terms of some texts count, by ranges of hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lengths, words in _chunks(batches):
            terms, text, _ = _terms(lengths, words)
            if not len(terms):
                continue
            order = np.argsort(terms, kind="stable")  # a term's texts stay in order
            terms, text = terms[order], text[order]
            new = np.append(True, terms[1:] != terms[:-1])
            first = np.flatnonzero(new)
            several = text[first] != text[np.append(first[1:], len(terms)) - 1]
            topic = rows.column("topic_id").to_numpy(zero_copy_only=False)[text].astype(np.int64)
            key, n = _summed((np.cumsum(new) - 1) * topics + topic, np.ones(len(terms), np.int64))
            run_, found = key // topics, terms[first]
            bucket = ((found[run_] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(key))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                entries = np.empty(b - a, _ENTRY)
                entries["step"] = np.diff(found[run_[a:b]], prepend=np.uint64(0))
                entries["topic"], entries["several"], entries["n"] = key[a:b] % topics, several[run_[a:b]], n[a:b]
                planes = entries.view(np.uint8).reshape(b - a, _ENTRY.itemsize).T.tobytes()  # equal bytes side by side
                out.append((int(bucket[a]), int(b - a), pa.compress(planes, "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "size", "block"])

    return hashed.mapInArrow(run, "bucket int, size int, block binary")


def _recurring(blocks: DataFrame, topics: int, keep: int) -> DataFrame:
    """Of the terms that several texts hold: (topic_id, null, n, null), a topic's occurrences in one bucket, and
    (topic_id, term, n, all) of those that can be among the topic's ``keep`` best by class-based TF-IDF.

    x * ln(1 + mean / x) grows with x whatever the mean, so a term that occurs more often in all, and of that at least
    as large a share in the topic, scores higher: a term with ``keep`` such others is left out.
    """

    def run(group: pa.Table) -> pa.Table:
        parts = []
        for size, block in zip(group["size"].to_pylist(), group["block"].to_pylist(), strict=True):
            planes = np.frombuffer(pa.decompress(block, size * _ENTRY.itemsize, "zstd", asbytes=True), np.uint8)
            parts.append(np.ascontiguousarray(planes.reshape(_ENTRY.itemsize, size).T).view(_ENTRY)[:, 0])
        terms = np.concatenate([np.cumsum(p["step"], dtype=np.uint64) for p in parts])
        block = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        entries = np.concatenate(parts)
        order = np.argsort(terms, kind="stable")
        terms, block, entries = terms[order], block[order], entries[order]
        new = np.append(True, terms[1:] != terms[:-1])
        first = np.flatnonzero(new)
        several = np.logical_or.reduceat(entries["several"] > 0, first) | (block[first] != block[np.append(first[1:], len(terms)) - 1])
        n = entries["n"].astype(np.int64)
        total = np.add.reduceat(n, first)
        key, n = _summed((np.cumsum(new) - 1) * topics + entries["topic"], n)
        known = several[key // topics]
        key, n = key[known], n[known]
        term, topic, total = terms[first][key // topics].view(np.int64), key % topics, total[key // topics]
        out: list[tuple] = []
        for t in np.unique(topic):
            mine = np.flatnonzero(topic == t)
            out.append((int(t), None, int(n[mine].sum()), None))
            mine = mine[np.argsort(-total[mine], kind="stable")]
            cuts = np.append(np.flatnonzero(np.diff(-total[mine], prepend=1)), len(mine))
            best = np.empty(0)  # the largest shares of the terms that occur more often
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                share = n[mine[a:b]] / total[mine[a:b]]
                some = mine[a:b][share > best[0]] if len(best) == keep else mine[a:b]
                out += [(int(t), int(term[i]), int(n[i]), int(total[i])) for i in some]
                best = np.sort(np.concatenate([best, share]))[-keep:]
                if len(best) == keep and best[0] == 1:
                    break
        return pa.table([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], ty) for ty in types], ["topic_id", "term", "n", "all"])

    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return blocks.groupBy("bucket").applyInArrow(run, "topic_id int, term long, n long, all long")


def _holders(hashed: DataFrame, wanted: list[int]) -> DataFrame:
    """(term, id): for some terms of (id, hashed) one of the texts that hold each."""
    sought = np.sort(np.array(wanted, np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lengths, words in _chunks(batches):
            terms, text, _ = _terms(lengths, words)
            hits = np.flatnonzero(np.isin(terms, sought))
            hits = hits[np.unique(terms[hits], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(terms[hits].view(np.int64)), rows.column("id").take(pa.array(text[hits]))], ["term", "id"])

    found = hashed.select("id", "hashed").mapInArrow(run, T.StructType([T.StructField("term", T.LongType()), T.StructField("id", hashed.schema["id"].dataType)]))
    return found.groupBy("term").agg(F.min("id").alias("id"))


def _spelled(hashed: DataFrame, wanted: list[int]) -> DataFrame:
    """(term, word) of some terms of (words, hashed)."""
    sought = np.sort(np.array(wanted, np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lengths, words in _chunks(batches):
            terms, _, place = _terms(lengths, words)
            order = np.where(np.arange(len(terms)) < len(words), 1, 0)
            order[len(words) :] = 2
            order[len(words) + int(np.maximum(lengths - 1, 0).sum()) :] = 3
            hits = np.flatnonzero(np.isin(terms, sought))
            hits = hits[np.unique(terms[hits], return_index=True)[1]]
            text = rows.column("words").flatten()
            spelled = [" ".join(text.slice(int(place[i]), int(order[i])).to_pylist()) for i in hits]
            yield pa.RecordBatch.from_arrays([pa.array(terms[hits].view(np.int64)), pa.array(spelled, pa.string())], ["term", "word"])

    return hashed.select("words", "hashed").mapInArrow(run, "term long, word string").distinct()


#: Rows and bytes of a batch of texts that goes to Python.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 22


def _read_again(held: DataFrame, spark: SparkSession) -> DataFrame:
    """What ``materialize`` wrote, read by another session."""
    back = spark.read.schema(held.schema).parquet(held.written_to)
    back.written_to = held.written_to
    return back


def _narrow(held: DataFrame) -> DataFrame:
    """What ``materialize`` wrote, read by a session of its own whose batches for Python are small: of Spark's own limit of
    64 MB there are several copies in an executor for each task.  The caller's session stays as it is."""
    spark = held.sparkSession
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return _read_again(held, own)


def _with_hashes(words: DataFrame) -> DataFrame:
    return words.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))


def _best_terms(hashed: DataFrame, topics: int, occurrences: int, keywords: int) -> DataFrame:
    """(topic_id, term, score) of (topic_id, hashed): each topic's best terms, and what ties with them, as hashes."""
    blocks = _blocks(hashed.select("topic_id", "hashed"), topics, max(1, -(-occurrences // BUCKET)))
    counted = materialize(_recurring(blocks, topics, keywords), "terms")
    classes = counted.where("term IS NULL").groupBy("topic_id").agg(F.sum("n").alias("size"))
    # One row for each topic, and one of all: safe to broadcast.
    scored = counted.where("term IS NOT NULL").join(F.broadcast(classes), "topic_id").crossJoin(F.broadcast(classes.agg(F.avg("size").alias("mean")))).withColumn("score", _class_score())
    strongest = Window.partitionBy("topic_id").orderBy(F.desc("score"))
    best = materialize(scored.withColumn("rank", F.rank().over(strongest)).where(F.col("rank") <= keywords).select("topic_id", "term", "score"), "best")
    release(counted)
    return best


def _listed(best: DataFrame, spelled: DataFrame, keywords: int) -> DataFrame:
    """(topic_id, keywords) of the best terms and their words."""
    ranked = best.join(spelled, "term").withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("score"), "word"))).where(F.col("rank") <= keywords)
    return ranked.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word")))["word"].alias("keywords"))


def _terms_of(best: DataFrame) -> list[int]:
    return [r["term"] for r in best.select("term").distinct().collect()]


def topic_keywords(words: DataFrame, topics: int, occurrences: int, keywords: int = 10) -> DataFrame:
    """(topic_id, keywords): of (topic_id, words) each topic's best words, pairs and triples by class-based TF-IDF among
    those that several texts hold; topics are numbers from 0 to ``topics``, ``occurrences`` those of all terms.

    Terms are counted by hashes of 64 bits; only the best, and what ties with them, are spelled out.
    """
    hashed = _with_hashes(words)
    best = _best_terms(hashed, topics, occurrences, keywords)
    return _listed(best, _spelled(hashed, _terms_of(best)), keywords)


def _counted(hashed: DataFrame) -> DataFrame:
    """(id, hashed, counts, terms) of (id, hashed): a text's terms counted in dimensions by hash, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lengths, words in _chunks(batches):
            terms, text, _ = _terms(lengths, words)
            key, n = _summed((text << TERM_BITS) | (terms >> np.uint64(64 - TERM_BITS)).astype(np.int64), np.ones(len(terms), np.int64))
            ends = pa.array(np.searchsorted(key, np.arange(len(lengths) + 1) << TERM_BITS).astype(np.int32))
            sparse = [pa.array(np.zeros(len(lengths), np.int8)), pa.array(np.full(len(lengths), 1 << TERM_BITS, np.int32))]
            sparse += [pa.ListArray.from_arrays(ends, pa.array((key & ((1 << TERM_BITS) - 1)).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.float64)))]
            counts = pa.StructArray.from_arrays(sparse, ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("hashed"), counts, pa.array(np.bincount(text, minlength=len(lengths)))], ["id", "hashed", "counts", "terms"])

    more = [T.StructField("counts", VectorUDT()), T.StructField("terms", T.LongType())]
    return hashed.mapInArrow(run, T.StructType([hashed.schema["id"], hashed.schema["hashed"], *more]))


#: Texts that are picked by name to spell terms; for more, all are looked through.
PICKED = 4096


def _words(texts: DataFrame) -> DataFrame:
    """(id, words) of (id, content)."""
    words = RegexTokenizer(inputCol="content", outputCol="words", pattern=r"[^\p{L}]+", minTokenLength=3).transform(texts.select("id", F.coalesce("content", F.lit("")).alias("content")))
    return words.withColumn("words", F.filter("words", meaningful)).drop("content")


#: Counts whose distances to all centres a task takes at once, and parts in which sums over the dimensions travel.
AT_ONCE, PARTS = 1 << 16, 16
#: Rows of candidates: each text's random number, what it is worth, and its counts.
_CANDIDATE = "luck double, indices binary, counts binary"


class _Rows:
    """Consecutive texts: the dimensions and counts of all, where each one's begin, and their TF-IDF scaled to length 1."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray | None):
        self.batch = batch
        indices, values = (batch.column("counts").field(k) for k in ("indices", "values"))
        self.dims, self.counts = indices.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
        self.lengths = indices.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        if weights is not None:
            x = self.counts * weights[self.dims]
            norm = np.sqrt(np.add.reduceat(x * x, self.starts))
            self.square = (norm > 0).astype(float)
            self.features = x / np.repeat(np.where(norm > 0, norm, 1.0), self.lengths)

    def distances(self, centres: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Squared ones of each text to the columns of ``centres``, single precision."""
        near, x = np.take(centres, self.dims, axis=0), self.features.astype(np.float32)
        dots = np.stack([x[a : a + n] @ near[a : a + n] for a, n in zip(self.starts, self.lengths, strict=True)])
        return np.maximum(self.square[:, None] + squares - 2 * dots, 0.0)


def _rows(batches: Iterator[pa.RecordBatch], weights: np.ndarray | None) -> Iterator[_Rows]:
    for b in batches:
        ends = np.concatenate([[0], np.cumsum(b.column("counts").field("indices").value_lengths().to_numpy(zero_copy_only=False))])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + AT_ONCE, "right")) - 1)
            yield _Rows(b.slice(at, to - at), weights)
            at = to


def _summed_up(known: DataFrame, groups: int, add: Callable[[_Rows, np.ndarray], None], weights: np.ndarray | None, size: int = 1 << TERM_BITS) -> np.ndarray:
    """(groups, ``size`` and one more) sums over all texts: a task's go in PARTS, one row for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((groups, size + PARTS))
        for rows in _rows(batches, weights):
            add(rows, sums)
        parts = [pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) for x in np.split(sums, PARTS, axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "sums"])

    width = (size + PARTS) // PARTS

    def put_together(group: pa.Table) -> pa.Table:
        total = np.zeros(groups * width)
        for x in group["sums"]:
            total += np.frombuffer(pa.decompress(x.as_py(), groups * width * 8, "zstd", asbytes=True))
        return pa.table([group["part"][:1], pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())], ["part", "sums"])

    added = known.mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(put_together, "part int, sums binary")
    found = {r["part"]: np.frombuffer(pa.decompress(bytes(r["sums"]), groups * width * 8, "zstd", asbytes=True)).reshape(groups, width) for r in added.collect()}
    return np.concatenate([found[k] for k in range(PARTS)], axis=1) if found else np.zeros((groups, size + PARTS))


def _lucky(known: DataFrame, weights: np.ndarray, centres: np.ndarray | None, most: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(dimensions, features) of texts drawn by their squared distance to the nearest centre, without repetition: the
    ``most`` largest of log(u) / distance.  A text's u is a hash of its counts, whatever the order of rows."""
    sent = known.sparkSession.sparkContext.broadcast((weights, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, centres = sent.value
        squares = (centres * centres).sum(axis=0) if centres is not None else None
        best: dict = {}
        for rows in _rows(batches, weights):
            far = rows.distances(centres, squares).min(axis=1) if centres is not None else np.ones(len(rows.lengths))
            far[far < 1e-6] = 0.0
            mixed = _mix(rows.dims.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rows.counts.astype(np.uint64))
            u = (_mix(np.add.reduceat(mixed, rows.starts) ^ _mix(np.array([seed + 1], np.uint64))) >> np.uint64(11)).astype(float) / (1 << 53)
            luck = np.where(far > 0, np.log(np.maximum(u, 1e-300)) / np.where(far > 0, far, 1.0), -np.inf)
            for i in np.argsort(-luck, kind="stable")[:most]:
                if luck[i] > -np.inf:
                    at = slice(rows.starts[i], rows.starts[i] + rows.lengths[i])
                    best[float(luck[i])] = (rows.dims[at].astype("<i4").tobytes(), rows.counts[at].astype("<f8").tobytes())
            best = dict(sorted(best.items(), reverse=True)[:most])
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.float64()), *[pa.array([x[k] for x in best.values()], pa.binary()) for k in (0, 1)]], ["luck", "indices", "counts"])

    drawn = {r["luck"]: r for r in known.mapInArrow(run, _CANDIDATE).orderBy(F.desc("luck")).limit(most).collect()}
    sent.unpersist()
    out = []
    for r in drawn.values():
        dims, x = np.frombuffer(r["indices"], "<i4"), np.frombuffer(r["counts"]) * weights[np.frombuffer(r["indices"], "<i4")]
        out.append((dims, x / (np.linalg.norm(x) or 1.0)))
    return out


def _dense(some: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((1 << TERM_BITS, len(some)), np.float32)
    for j, (dims, x) in enumerate(some):
        out[dims, j] = x
    return out


def _passed(known: DataFrame, weights: np.ndarray, centres: np.ndarray, of: str | None) -> np.ndarray:
    """(centres, dimensions and one more): ``features`` or ``counts`` of the texts nearest to each centre, or neither; at last the number of those."""
    sent, groups, size = known.sparkSession.sparkContext.broadcast((weights, centres.astype(np.float32))), centres.shape[1], (1 << TERM_BITS) if of else 0

    def add(rows: _Rows, sums: np.ndarray) -> None:
        centres = sent.value[1]
        near = rows.distances(centres, (centres * centres).sum(axis=0)).argmin(axis=1)
        if of:
            np.add.at(sums.reshape(-1), np.repeat(near, rows.lengths) * sums.shape[1] + rows.dims, getattr(rows, of))
        sums[:, size] += np.bincount(near, minlength=groups)

    out = _summed_up(known, groups, add, weights, size)
    sent.unpersist()
    return out


def _first_centres(known: DataFrame, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means||: a text, twice 2 k far ones, and of those k by k-means++ and rounds of moves, weighted by the texts near each."""
    some = _lucky(known, weights, None, 1, seed)
    for step in (1, 2):
        some += _lucky(known, weights, _dense(some), 2 * k, seed + step)
    if len(some) <= k:
        return _dense(some).astype(float)
    dense = _dense(some)
    held, gram = _passed(known, weights, dense, None)[:, 0], (dense.T @ dense).astype(float)
    gap = np.maximum(np.diag(gram)[:, None] + np.diag(gram) - 2 * gram, 0.0)
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(some), p=held / held.sum()))]
    while len(chosen) < k and (odds := held * gap[:, chosen].min(axis=1)).sum() > 0:
        chosen.append(int(rng.choice(len(some), p=odds / odds.sum())))
    share = np.eye(len(some))[:, chosen]  # centres as weighted means of candidates
    for _ in range(30):
        near = (np.einsum("ic,ij,jc->c", share, gram, share) - 2 * gram @ share).argmin(axis=1)
        member = (near[:, None] == np.arange(len(chosen))) * held[:, None]
        after = np.where(member.sum(axis=0) > 0, member / np.maximum(member.sum(axis=0), 1e-300), share)
        if np.array_equal(after, share):
            break
        share = after
    return dense @ share


def _clustered(texts: DataFrame, k: int, seed: int, rounds: int, with_hashes: bool) -> DataFrame:
    """(id, likeliest, probability, terms), with ``hashed`` on demand, of (id, content): each text's cluster, null without
    terms, and the highest posterior that a multinomial model of the clusters' counts gives it.

    Executors' heaps hold no vectors: a pass streams the counts through twice as many tasks as there are cores, and a task
    holds the centres and one sum for each of their dimensions.
    """
    size = 1 << TERM_BITS
    some = _narrow(materialize(_counted(_with_hashes(_words(texts)).select("id", "hashed")), "counted"))
    context = some.sparkSession.sparkContext
    known = some.where("terms > 0").select("counts").coalesce(max(1, 2 * context.defaultParallelism))

    def holders(rows: _Rows, sums: np.ndarray) -> None:
        sums[0, :size] += np.bincount(rows.dims, minlength=size)
        sums[0, size] += len(rows.lengths)

    found = _summed_up(known, 1, holders, None)[0]
    texts_, held_by = found[size], found[:size]
    if not texts_:
        held = materialize(some.select("id", F.lit(None).cast("int").alias("likeliest"), F.lit(0.0).alias("probability"), "terms", *["hashed"] * with_hashes), "clusters")
        release(some)
        return _read_again(held, texts.sparkSession)
    weights = np.where(held_by >= 2, np.log((texts_ + 1) / (held_by + 1)), 0.0)
    centres = _first_centres(known, weights, k, seed)
    for _ in range(rounds):
        sums = _passed(known, weights, centres, "features")
        after = np.where(sums[:, size] > 0, sums[:, :size].T / np.maximum(sums[:, size], 1.0), centres)
        still = bool((((after - centres) ** 2).sum(axis=0) <= 1e-8).all())
        centres = after
        if still:
            break
    counts = _passed(known, weights, centres, "counts")
    there = counts[:, size] > 0
    prior = np.where(there, np.log(counts[:, size] + 1) - np.log(texts_ + there.sum()), -np.inf)
    logs = np.log(counts[:, :size] + 1).T - np.log(counts[:, :size].sum(axis=1) + size)
    sent = context.broadcast((weights, centres.astype(np.float32), prior, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, centres, prior, logs = sent.value
        squares = (centres * centres).sum(axis=0)
        for b in batches:
            has = b.column("terms").to_numpy(zero_copy_only=False) > 0
            place = np.cumsum(has) - 1
            near, sure = [np.empty(0, np.int32)], [np.empty(0)]
            for rows in _rows(iter([b.filter(pa.array(has))]), weights):
                near.append(rows.distances(centres, squares).argmin(axis=1).astype(np.int32))
                p = prior + np.stack([np.add.reduceat(rows.counts * logs[rows.dims, j], rows.starts) for j in range(len(prior))], 1)
                sure.append(1 / np.exp(p - p.max(axis=1, keepdims=True)).sum(axis=1))
            likeliest = pa.array(np.concatenate(near)).take(pa.array(place, mask=~has))
            probability = np.append(np.concatenate(sure), 0.0)[np.where(has, place, -1)]
            yield pa.RecordBatch.from_arrays([b.column("id"), likeliest, pa.array(probability), b.column("terms"), *([b.column("hashed")] if with_hashes else [])], ["id", "likeliest", "probability", "terms", *["hashed"] * with_hashes])

    kept = ["terms", *["hashed"] * with_hashes]
    more = [T.StructField("likeliest", T.IntegerType()), T.StructField("probability", T.DoubleType()), *[some.schema[c] for c in kept]]
    held = materialize(some.select("id", "counts", *kept).mapInArrow(run, T.StructType([some.schema["id"], *more])), "clusters")
    sent.unpersist()
    release(some)
    return _read_again(held, texts.sparkSession)


def _labelled(texts: DataFrame, placed: DataFrame, k: int, min_topic: int, keywords: int) -> DataFrame:
    """(topic_id, topic_label, keywords, articles) of what _clustered found with hashes."""
    sizes, narrow = _sizes(placed, min_topic), _narrow(placed)
    known = narrow.join(F.broadcast(_sizes(narrow, min_topic).select("likeliest")), "likeliest").select("id", F.col("likeliest").alias("topic_id"), "hashed")
    best = _read_again(_best_terms(known, k, placed.agg(F.sum("terms")).first()[0] or 0, keywords), texts.sparkSession)
    wanted = _terms_of(best)
    holders = {r["id"] for r in _holders(known, wanted).collect()}
    if len(holders) <= PICKED and None not in holders:
        texts = texts.where(F.col("id").isin(list(holders)))
    listed = _listed(best, _spelled(_with_hashes(_words(texts)), wanted), keywords)
    labelled = sizes.withColumnRenamed("likeliest", "topic_id").join(listed, "topic_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return labelled.select("topic_id", topic_label(F.col("keywords")).alias("topic_label"), "keywords", "articles")


def _sizes(placed: DataFrame, min_topic: int) -> DataFrame:
    return placed.where("likeliest IS NOT NULL").groupBy("likeliest").agg(F.count(F.lit(1)).alias("articles")).where(F.col("articles") >= min_topic)


def _members(placed: DataFrame, min_topic: int) -> DataFrame:
    """(id, topic_id, probability)."""
    # One row for each of at most k topics: safe to broadcast.
    is_known = F.broadcast(_sizes(placed, min_topic).select("likeliest", F.lit(True).alias("known")))
    topic = F.when(F.col("known"), F.col("likeliest")).otherwise(OUTLIER).alias("topic_id")
    return placed.join(is_known, "likeliest", "left").select("id", topic, "probability")


def topic_model(texts: DataFrame, k: int = 8, seed: int = 42, min_topic: int = 2, rounds: int = 20, keywords: int = 10) -> tuple[DataFrame, DataFrame]:
    """Topics of (id, content): clusters of TF-IDF vectors over words, pairs and triples of words, labelled by class-based TF-IDF.

    Gives (topic_id, topic_label, keywords, articles) and (id, topic_id, probability): the highest posterior that a
    multinomial model of the clusters' term counts gives the article.  -1 collects the articles without terms and those
    of topics with fewer than ``min_topic`` articles.  Terms of one article alone weigh nothing and are no keywords.

    Texts are split into words once; their words' hashes and their hashed counts are stored, and terms are made anew of
    the hashes where they are looked at.
    """
    placed = _clustered(texts, k, seed, rounds, True)
    return _labelled(texts, placed, k, min_topic, keywords), _members(placed, min_topic)


def article_topics(texts: DataFrame, k: int = 8, seed: int = 42, min_topic: int = 2, rounds: int = 20) -> DataFrame:
    """The second table of ``topic_model``, without looking for keywords."""
    return _members(_clustered(texts, k, seed, rounds, False), min_topic)


@query("g11_topic_model")
def g11(m: Model) -> DataFrame:
    return topic_model(m.texts)[0]


@query("g11b_article_topics")
def g11b(m: Model) -> DataFrame:
    return article_topics(m.texts)
