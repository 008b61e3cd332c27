"""Taking over articles of an older store: chosen, scored, made unique by address and published as one version; and what its tables hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import _TITLED, IMPORT_CHARS, IMPORT_TITLES, IMPORT_WORDS, INVESTIGATIVE, KEEP_SCORE, _sql_match, _titled, import_score, matches
from ..plans.proxy import AS_OF, Model
from ..plans.registry import query
from ..plans.shared import materialize, release, shared_dir
from .snapshots import Snapshots, by_hash

#: Characters that a text must exceed to be fetched at all, and the days that the import looks back.
LEAST_CHARS, IMPORT_DAYS = 100, 365
ARTICLE = "url string, id long, title string, content string, summary string, source string, author string, published_date timestamp_ntz"


def import_reason(title: Column, content: Column) -> Column:
    """Why an article is left out, the first rule that does so; null for one that is taken."""
    text = F.coalesce(content, F.lit(""))
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    score = import_score(title, content, F.array().cast("array<string>"))
    by_title = matches(F.lower(F.coalesce(title, F.lit(""))), IMPORT_TITLES)
    return F.when(by_title, "Title matches exclude pattern").when(F.char_length(text) < IMPORT_CHARS, "Content too short").when(words < IMPORT_WORDS, "Too few words").when(score < KEEP_SCORE, "base score")


def import_plan(old: DataFrame, known: DataFrame, as_of: Column, days: int = IMPORT_DAYS) -> DataFrame:
    """The rows of ``old`` that are fetched, with ``status`` (imported, filtered, skipped_duplicate) and ``reason``.

    Fetched are rows of the last ``days`` days with a text of more than LEAST_CHARS characters.  ``known`` (url) are the
    addresses that the new store has; of rows that share one the latest, then the smallest id, is imported.  A row
    without an address can't be told apart from others: its status is error.
    """
    fetched = old.where((F.char_length("content") > LEAST_CHARS) & (F.col("published_date") >= as_of - F.expr(f"INTERVAL {days} DAYS")))
    judged = fetched.withColumn("reason", import_reason(F.col("title"), F.col("content")))
    first = judged.where("reason IS NULL AND url IS NOT NULL").groupBy("url").agg(F.min_by("id", F.struct((-F.unix_micros(F.col("published_date").cast("timestamp"))).alias("at"), "id")).alias("_first"))
    marked = judged.join(first, "url", "left").join(known.select("url").distinct().withColumn("_known", F.lit(True)), "url", "left")
    again = F.col("_known").isNotNull() | (F.col("_first") != F.col("id"))
    status = F.when(F.col("reason").isNotNull(), "filtered").when(F.col("url").isNull(), "error").when(again, "skipped_duplicate").otherwise("imported")
    return marked.withColumn("status", status).select(*old.columns, "status", "reason")


def run_import(old: DataFrame, store: Snapshots, as_of: Column, days: int = IMPORT_DAYS, dry_run: bool = True) -> DataFrame:
    """(status, reason, n) of an import; unless it is a dry run the imported rows become the store's next version."""
    plan = materialize(import_plan(old, store.read().select("url"), as_of, days), "import")
    told = materialize(plan.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n")), "told")
    taken = plan.where("status = 'imported'")
    if not dry_run and taken.first():
        store.upsert(taken.select(*store.schema.fieldNames()), ["url"])
    release(plan)
    return told


def _old_store(m: Model) -> DataFrame:
    """The texts as articles of an older store: dated by id, every ninth under the address of the one before."""
    url = F.concat(F.lit("https://old.example/"), F.when(F.col("id") % 9 == 1, F.col("id") - 1).otherwise(F.col("id")).cast("string"))
    dated = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((F.col("id") % 500).cast("int"))
    return _titled(m).select(url.alias("url"), "id", "title", "content", "summary", "source", F.lit("").alias("author"), dated.alias("published_date"))


_WORDS = "len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> ''))"
_PLAN = f"""{_TITLED}, j AS (SELECT id, content, 'https://old.example/' || CASE WHEN id % 9 = 1 THEN id - 1 ELSE id END AS url, id % 500 AS age,
 CASE WHEN {_sql_match("lower(title)", IMPORT_TITLES)} THEN 'Title matches exclude pattern' WHEN length(content) < 800 THEN 'Content too short' WHEN {_WORDS} < 100 THEN 'Too few words'
 WHEN 50 + CASE WHEN length(content) > 3000 THEN 15 WHEN length(content) > 2000 THEN 10 ELSE 0 END + CASE WHEN {_sql_match("lower(title)", INVESTIGATIVE)} THEN 15 ELSE 0 END - CASE WHEN length(title) < 30 THEN 10 ELSE 0 END < 50 THEN 'base score' END AS reason
 FROM t WHERE length(content) > 100 AND id % 500 <= 365),
p AS (SELECT *, row_number() OVER (PARTITION BY url, reason IS NULL ORDER BY age, id) AS k FROM j),
s AS (SELECT id, url, reason, CASE WHEN reason IS NOT NULL THEN 'filtered' WHEN k > 1 OR CAST(split_part(url, '/', 4) AS BIGINT) % 4 = 0 THEN 'skipped_duplicate' ELSE 'imported' END AS status FROM p)"""


def _new_store(m: Model) -> Snapshots:
    """A store that knows every fourth address already."""
    store = Snapshots(m.spark, f"{shared_dir(m.spark)}/imported", ARTICLE, by_hash(["url"], 8))
    known = m.texts.where("id % 4 = 0").select(F.concat(F.lit("https://old.example/"), F.col("id").cast("string")).alias("url"), "id", *[F.lit(None).cast("string").alias(c) for c in ("title", "content", "summary", "source", "author")], F.lit(None).cast("timestamp_ntz").alias("published_date"))
    store.upsert(known, ["url"])
    return store


@query("s16b_import_stats", f"WITH {_PLAN} SELECT status, reason, count(*) AS n FROM s GROUP BY 1, 2")
def s16b(m: Model) -> DataFrame:
    return run_import(_old_store(m), _new_store(m), F.lit(AS_OF).cast("timestamp_ntz"))


@query("s16c_imported_rows", f"WITH {_PLAN} SELECT id, url FROM s WHERE status = 'imported' UNION ALL SELECT doc_id, 'https://old.example/' || doc_id FROM documents WHERE doc_id % 4 = 0")
def s16c(m: Model) -> DataFrame:
    store = _new_store(m)
    run_import(_old_store(m), store, F.lit(AS_OF).cast("timestamp_ntz"), dry_run=False)
    return store.read().select("id", "url")


def profile(tables: dict[str, DataFrame], expected: dict[str, list[str]]) -> DataFrame:
    """(table, column, status, type, rows, nulls) of every column that is expected or there, counted over whole tables.

    Status is found, missing or extra; a missing table or column has no type and null counts.
    """
    parts = []
    for name in sorted({*tables, *expected}):
        df = tables.get(name)
        there = dict(df.dtypes) if df is not None else {}
        columns = [*there, *[c for c in expected.get(name, []) if c not in there]]
        status = {c: "missing" if c not in there else "found" if c in expected.get(name, []) else "extra" for c in columns}
        told = [F.struct(F.lit(c).alias("column"), F.lit(status[c]).alias("status"), F.lit(there.get(c)).cast("string").alias("type"), (F.count_if(F.col(f"`{c}`").isNull()) if c in there else F.lit(None)).cast("long").alias("nulls")) for c in columns]
        rows = F.count(F.lit(1)).alias("rows") if df is not None else F.lit(None).cast("long").alias("rows")
        source = df if df is not None else next(iter(tables.values())).sparkSession.range(1)
        counted = source.agg(rows, F.array(*told).alias("columns")) if df is not None else source.select(rows, F.array(*told).alias("columns"))
        parts.append(counted.select(F.lit(name).alias("table"), "rows", F.explode("columns").alias("c")).select("table", "c.column", "c.status", "c.type", "rows", "c.nulls"))
    return reduce(DataFrame.unionByName, parts)


@query("s17b_table_profile", """SELECT 'documents' AS "table", 'doc_id' AS "column", 'found' AS status, 'bigint' AS "type", count(*) AS rows, count(*) - count(doc_id) AS nulls FROM documents
UNION ALL SELECT 'documents', 'text', 'found', 'string', count(*), count(*) - count(text) FROM documents
UNION ALL SELECT 'documents', 'lang', 'extra', 'string', count(*), count(*) - count(lang) FROM documents
UNION ALL SELECT 'documents', 'source', 'extra', 'string', count(*), count(*) - count(source) FROM documents
UNION ALL SELECT 'documents', 'n_chars', 'extra', 'bigint', count(*), count(*) - count(n_chars) FROM documents
UNION ALL SELECT 'documents', 'summary', 'missing', NULL, count(*), NULL FROM documents
UNION ALL SELECT 'labels', 'doc_id', 'found', 'bigint', count(*), count(*) - count(doc_id) FROM labels
UNION ALL SELECT 'labels', 'quality', 'found', 'int', count(*), count(*) - count(quality) FROM labels
UNION ALL SELECT 'labels', 'toxic', 'extra', 'int', count(*), count(*) - count(toxic) FROM labels
UNION ALL SELECT 'topics_seen', 'id', 'missing', NULL, NULL, NULL""")
def s17b(m: Model) -> DataFrame:
    return profile({t: m.table(t) for t in ("documents", "labels")}, {"documents": ["doc_id", "text", "summary"], "labels": ["doc_id", "quality"], "topics_seen": ["id"]})
