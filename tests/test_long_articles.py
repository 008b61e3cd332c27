"""Operators on articles of thousands of names and texts of a million sentences, held against plain comparisons."""

import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lorekiln.functions.text import containing, sentences, spans
from lorekiln.operators import positions, reconcile, relational
from lorekiln.plans.catalog import QUERIES

ITEM = "article_id long, type string, name string"


def names(rng, n, letters="abcdeé", most=7):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


# --- sentences and offsets ---------------------------------------------------------------------------------------


def test_sentence_rows_equal_the_column_form(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    hard = spark.createDataFrame([(-1, ""), (-2, None), (-3, "  One.  Two!\n\n Mr. Three? e.g. four.   "), (-4, ". . ."), (-5, "no end")], "doc_id long, text string")
    both = docs.unionByName(hard)
    rows = {(r["doc_id"], r["index"], r["start"], r["end"], r["text"]) for r in positions.sentence_rows(both, "doc_id", "text").collect()}
    column = both.select("doc_id", F.posexplode(spans(F.col("text"))).alias("index", "s")).select("doc_id", "index", "s.*")
    assert rows == {tuple(r) for r in column.collect()}
    assert [r[4] for r in sorted(rows) if r[0] == -3] == both.where("doc_id = -3").select(sentences(F.col("text"))).first()[0]


def test_sweep_equals_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    offsets = docs.select("doc_id", F.explode(F.sequence(F.lit(-1), F.char_length("text") + 1, F.lit(37))).alias("place"))
    for stretch in (100, 1 << 16):
        swept = positions.membership(offsets.withColumn("index", F.lit("mine")).withColumnRenamed("index", "note"), positions.sentence_rows(docs, "doc_id", "text"), "doc_id", stretch)
        assert swept.columns == ["doc_id", "place", "note", "index"]
        got = {(r["doc_id"], r["place"], r["index"]) for r in swept.collect()}
        scan = docs.select("doc_id", spans(F.col("text")).alias("s")).join(offsets, "doc_id").select("doc_id", "place", containing(F.col("s"), F.col("place").cast("int")).alias("i"))
        assert got == {tuple(r) for r in scan.collect()} and len(got) == offsets.count()


def test_sweep_hard_rows(spark):
    intervals = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 5), (1, 2, 7, 300_000), (2, 0, 3, 4)], "k long, index int, start long, end long")
    offsets = spark.createDataFrame([(1, 0), (1, 4), (1, 5), (1, 6), (1, 7), (1, 299_999), (1, 300_000), (1, 4), (2, 2), (2, 3), (3, 0), (1, None)], "k long, place long")
    got = sorted(((r["k"], -1 if r["place"] is None else r["place"], r["index"]) for r in positions.membership(offsets, intervals, "k").collect()), key=str)
    assert got == sorted([(1, 0, 0), (1, 4, 0), (1, 4, 0), (1, 5, None), (1, 6, None), (1, 7, 2), (1, 299_999, 2), (1, 300_000, None), (2, 2, None), (2, 3, 0), (3, 0, None), (1, -1, None)], key=str)
    assert positions.membership(offsets.where("false"), intervals, "k").collect() == [] and positions.membership(offsets, intervals.where("false"), "k").where("index is not null").collect() == []


def test_a_text_of_a_million_sentences(spark):
    n, sentence = 1_000_000, "It rains. "
    text = spark.range(1).select(F.col("id").alias("k"), F.repeat(F.lit(sentence), n).alias("text"))
    offsets = spark.range(0, n, 7).select(F.lit(0).cast("long").alias("k"), (F.col("id") * 10 + 3).alias("place"), F.col("id").alias("wanted"))
    began = time.time()
    found = positions.membership(offsets, positions.sentence_rows(text, "k", "text"), "k")
    assert found.agg(F.count_if(F.col("index") == F.col("wanted")), F.count(F.lit(1))).first() == (len(range(0, n, 7)),) * 2
    assert time.time() - began < 120  # the scan would compare 10^11 pairs


def test_mention_places(spark, sf):
    got = QUERIES["j13c_mention_places"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got
    for r in got[:300]:
        text = texts[r["doc_id"]]
        paragraphs = text.split("\n\n")
        starts = [sum(len(p) + 2 for p in paragraphs[:k]) for k in range(len(paragraphs))]
        inside = [k for k, p in enumerate(paragraphs) if starts[k] <= r["place"] < starts[k] + len(p)]
        assert text[r["place"] : r["place"] + 5].lower() == " the " and r["paragraph_index"] == (inside[0] if inside else None)


# --- containment -------------------------------------------------------------------------------------------------


def test_containment_equals_all_pairs(spark):
    rng = random.Random(1)
    side = lambda n: [(rng.randrange(3), rng.choice("XY"), s) for s in names(rng, n)] + [(1, "X", None), (1, "X", "AbC"), (1, None, "abc"), (None, "X", "abc")]
    left, right = side(60), side(150)
    left += [left[0], left[0]]
    got = sorted(tuple(r) for r in relational.containment_matches(spark.createDataFrame(left, ITEM), spark.createDataFrame(right, ITEM)).collect())
    wanted = [(a, t, s, w) for a, t, s in left for b, u, w in right if (a, t) == (b, u) and None not in (a, t, s, w) and s.lower() in w.lower() and s != w]
    assert got == sorted(wanted) and len(wanted) > 200


def test_containment_in_an_article_of_five_thousand_names(spark):
    rng = random.Random(2)
    long_ = [(1, "X", f"{a} {b}") for a, b in zip(names(rng, 5000, "abcdefghij", 9), names(rng, 5000, "abcdefghij", 9), strict=True)]
    short = [(1, "X", n[1:]) for _, _, n in long_ if len(n) > 6]
    began = time.time()
    found = relational.containment_matches(spark.createDataFrame(short, ITEM), spark.createDataFrame(long_, ITEM))
    n = found.count()
    took = time.time() - began
    assert n >= len(short) and took < 60
    metrics = found.select("short_name", "long_name").distinct().count()
    assert metrics == sum(s in w for s in {x[2] for x in short} for w in {x[2] for x in long_} if s != w)


# --- fuzzy matching and merging ----------------------------------------------------------------------------------


def greedy(ours, theirs, threshold):
    used, out = set(), []
    for a in ours:
        ranked = [(1.0 if a.lower() == b.lower() else SequenceMatcher(None, a.lower(), b.lower()).ratio(), -j) for j, b in enumerate(theirs) if j not in used]
        if ranked and max(ranked)[0] >= threshold:
            used.add(-max(ranked)[1])
            out.append((theirs[-max(ranked)[1]], max(ranked)[0]))
        else:
            out.append(None)
    return out


def test_bounded_matching_equals_greedy():
    rng = random.Random(3)
    for threshold in (0.75, 0.6, 0.9, 0.7):
        for letters, most in (("ab", 4), ("abc", 9), ("abcdefghijklmnop", 14)):
            theirs = names(rng, 70, letters, most) + ["Ada Lovelace", "ada lovelace", "x" * 230 + "abc", ""]
            ours = names(rng, 60, letters, most) + ["ADA LOVELACE", "Ada Lovelacé", "x" * 229 + "abd", "", "ada lovelace"]
            partners = reconcile.Partners(threshold)
            for b in theirs:
                partners.add(b)
            assert [partners.best(a) for a in ours] == greedy(ours, theirs, threshold)


def test_matching_thousands_of_names(spark):
    rng = random.Random(4)
    theirs = [f"{a} {b}" for a, b in zip(names(rng, 3000, "abcdefghijklmno", 9), names(rng, 3000, "abcdefghijklmno", 9), strict=True)]
    ours = [b[:-1] + "z" for b in theirs]
    frame = lambda n: spark.createDataFrame([(1, k, x) for k, x in enumerate(n)], "article_id long, position int, name string")
    began = time.time()
    got = reconcile.matched(frame(ours), frame(theirs)).collect()
    assert sum(r["a"] is not None for r in got) == 3000 and sum(r["b"] is not None for r in got) == 3000
    assert sum(r["similarity"] is not None for r in got) > 2500 and time.time() - began < 90


def test_merging_equals_the_scan():
    rng = random.Random(5)
    for letters, most in (("ab", 5), ("abcdef", 8)):
        kept, scan = reconcile.Kept(), []
        for name in names(rng, 400, letters, most):
            wanted = next((k for k, held in enumerate(scan) if name in held or held in name), None)
            found = kept.find(name)
            assert (found is None) == (wanted is None) and (found is None or found == [scan[wanted]])
            if found is None:
                kept.add(name, [name])
                scan.append(name)


def test_merging_five_thousand_facts_of_one_article(spark):
    rng = random.Random(6)
    facts = [(1, k, n, "T", 0.5) for k, n in enumerate(names(rng, 5000, "abcdefghijklmnopqrst", 16)) if len(n) > 3]
    began = time.time()
    merged = reconcile.merged_names(spark.createDataFrame(facts, "article_id long, position int, name string, type string, confidence double")).collect()
    assert sum(r["merged"] for r in merged) == len(facts) and time.time() - began < 30
