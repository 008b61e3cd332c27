"""The news model over the driver's tables: articles, facts, mentions, costs, topics as views of orders and lineitem."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of every windowed query: wall-clock time never enters a result.
AS_OF = "2001-08-01 00:00:00"

#: Lines of a task that makes facts of them.
LINES = 1 << 16


class Model:
    """The model's tables as DataFrames; nothing is read before a query needs it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def articles(self) -> DataFrame:
        status = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END"
        return self.table("orders").selectExpr(
            "o_orderkey AS id",
            "concat('Article ', o_orderkey) AS title",
            "concat('https://news.example/', o_orderkey) AS url",
            "o_orderpriority AS source",
            "o_orderdate AS published_date",
            "o_orderdate + make_dt_interval(0, CAST(o_orderkey % 48 AS INT), 0, 0) AS collected_date",
            f"{status} AS processing_status",
            "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + make_dt_interval(2, CAST(o_orderkey % 24 AS INT), 0, 0) END AS processed_date",
        )

    @cached_property
    def facts(self) -> DataFrame:
        """Made in tasks of about LINES lines each, so that what a task holds doesn't grow with the table (its files tell the count)."""
        part = self.table("part").select("p_partkey", "p_type")
        lines = self.table("lineitem")
        return (
            lines.repartition(max(1, -(-lines.count() // LINES)), "l_orderkey")
            .groupBy(F.col("l_orderkey").alias("article_id"), "l_partkey")
            .agg(
                (F.max("l_quantity") / 50.0).alias("confidence"),
                (F.min("l_linenumber") - 1).alias("sentence_index"),
                F.array_sort(F.collect_set("l_returnflag")).alias("source_models"),
                F.max("l_linestatus").alias("st"),
            )
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                "article_id",
                F.concat(F.lit("E"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("entity"),
                F.col("p_type").alias("entity_type"),
                "confidence",
                "sentence_index",
                "source_models",
                F.expr("CASE WHEN st = 'O' THEN concat('Q', l_partkey) END AS wikidata_id"),
            )
        )

    @cached_property
    def mentions(self) -> DataFrame:
        """Two mentions a sentence, of few entities, so that some recur in an article."""
        return self.table("lineitem").selectExpr(
            "l_orderkey AS article_id",
            "concat('E', lpad(CAST(l_partkey % 5 AS STRING), 7, '0')) AS entity",
            "l_quantity / CAST(50 AS DOUBLE) AS confidence",
            "(l_linenumber - 1) div 2 AS sentence_index",
        )

    @cached_property
    def costs(self) -> DataFrame:
        return self.table("orders").selectExpr("o_orderkey AS article_id", "o_orderpriority AS api_provider", "o_orderdate AS timestamp", "o_totalprice AS cost")

    @cached_property
    def topics(self) -> DataFrame:
        return self.table("nation").selectExpr("n_nationkey AS topic_id", "n_name AS topic_label", "n_regionkey AS snapshot")

    @cached_property
    def article_topics(self) -> DataFrame:
        customers = self.table("customer").selectExpr("c_custkey", "c_nationkey AS topic_id", "abs(c_acctbal) / CAST(10000 AS DOUBLE) AS probability")
        return self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("article_id"), "topic_id", "probability")

    @cached_property
    def texts(self) -> DataFrame:
        """Raw texts as articles: the first line is the title, what follows the content."""
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("content"),
            "lang",
            "source",
        )


#: The same views as DuckDB text.
VIEWS = {
    "articles": """SELECT o_orderkey AS id, 'Article ' || o_orderkey AS title, 'https://news.example/' || o_orderkey AS url, o_orderpriority AS source, o_orderdate AS published_date,
  o_orderdate + to_hours(o_orderkey % 48) AS collected_date,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS processing_status,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 2 DAY + to_hours(o_orderkey % 24) END AS processed_date FROM orders""",
    "facts": """SELECT l_orderkey AS article_id, 'E' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS entity, any_value(p_type) AS entity_type, max(l_quantity) / CAST(50 AS DOUBLE) AS confidence,
  min(l_linenumber) - 1 AS sentence_index, list_sort(list(DISTINCT l_returnflag)) AS source_models, CASE WHEN max(l_linestatus) = 'O' THEN 'Q' || l_partkey END AS wikidata_id
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_partkey""",
    "mentions": """SELECT l_orderkey AS article_id, 'E' || lpad(CAST(l_partkey % 5 AS VARCHAR), 7, '0') AS entity, l_quantity / CAST(50 AS DOUBLE) AS confidence, (l_linenumber - 1) // 2 AS sentence_index FROM lineitem""",
    "costs": "SELECT o_orderkey AS article_id, o_orderpriority AS api_provider, o_orderdate AS timestamp, o_totalprice AS cost FROM orders",
    "topics": "SELECT n_nationkey AS topic_id, n_name AS topic_label, n_regionkey AS snapshot FROM nation",
    "article_topics": "SELECT o_orderkey AS article_id, c_nationkey AS topic_id, abs(c_acctbal) / CAST(10000 AS DOUBLE) AS probability FROM orders JOIN customer ON o_custkey = c_custkey",
    "texts": "SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, text AS content, lang, source FROM documents",
}


def over(views: str, body: str, *more: str) -> str:
    """DuckDB text over the named views; ``more`` are further CTEs."""
    return "WITH " + ",\n".join([f"{v} AS ({VIEWS[v]})" for v in views.split()] + list(more)) + "\n" + body
