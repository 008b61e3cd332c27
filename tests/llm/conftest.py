import pytest
from pyspark.sql import types as T

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")


@pytest.fixture
def docs(spark):
    """A maker of documents tables from (doc_id, text[, lang, source])."""

    def make(rows, extra=None):
        full = [(i, t, *(r[:2] or ("en", "src0") if r else ("en", "src0")), len(t or "")) for i, t, *r in rows]
        df = spark.createDataFrame(full, DOCS)
        for c in extra or ():
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("x"))
        return df

    return make


#: Rows that every operator must get through: nulls, empty and white texts, repeats, no id, a long text.
HARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "word " * 30000), (None, "no id at all here")]


#: Names that operators use or might use inside.
CLASHING = "_salt key slot size rank score hits page _gone _doc _row _first _all _key bucket text2 row gone tie to_doc to_row last_doc h1 pos place first x root sig order spread n words".split()


@pytest.fixture
def hard(docs):
    return docs([(i, t, "en", None if i == 3 else "s") for i, t in HARD], extra=CLASHING)
