"""Whitening, SimHash and spelling variants against brute force, and on hard rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lorekiln.llm import queries, simhash, spelling, whitening
from lorekiln.llm.common import table


# --- op11 -------------------------------------------------------------------------------------------------------


def reference_whitening(rows):
    """Rows (vec_id, vector) by numpy's eigenvectors of the exact covariance."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    y = (x * n - s).astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = [int(((n * r - s) ** 2).sum()) for r in x]
    return n, deviation, e, y @ v / np.sqrt(e)


def test_op11_whole_table(spark, sf):
    got = queries.op11_whitening(spark, sf).toPandas().sort_values(["vec_id", "component"])
    rows = sorted((r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect() if r["embedding"])
    n, deviation, e, w = reference_whitening(rows)
    assert len(got) == 32 * n and set(got["n"]) == {n}
    assert got["deviation"].to_numpy().reshape(n, 32)[:, 0].tolist() == deviation
    mine = got["whitened"].to_numpy().reshape(n, 32)
    signs = np.sign((mine * w[:, :32]).sum(axis=0))
    assert np.abs(mine - w[:, :32] * signs).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy()[:32], e[:32] / e.sum(), rtol=1e-9)
    assert got["identity_error"].max() < 1e-9


def test_op11_small_deviations_keep_their_digits():
    rng = np.random.default_rng(1)
    basis, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    lengths = np.array([1e6, 1e3, 1, 1e-3, 1e-6, 1e-9])
    tall, _ = np.linalg.qr(rng.normal(size=(500, 6)))
    r = None
    for block in np.array_split(tall * lengths @ basis.T, 7):
        r = whitening.triangle(r, block)
    v, found = whitening.jacobi(r)
    assert np.allclose(found[:4], lengths[:4], rtol=1e-6)
    assert np.abs(v.T @ v - np.eye(6)).max() < 1e-14
    assert np.abs(np.abs(np.diag(v.T @ basis))[:4] - 1).max() < 1e-9


def test_op11_odd_dimensions_by_rotations():
    for d in (1, 2, 3, 7):
        a = np.random.default_rng(d).normal(size=(20, d))
        v, lengths = whitening.jacobi(whitening.triangle(None, a))
        assert np.allclose(lengths, np.linalg.svd(a, compute_uv=False))
        assert np.abs((a @ v).T @ (a @ v) - np.diag(lengths**2)).max() < 1e-12


def test_op11_hard_rows(spark):
    rows = [(1, [0.5, 2.0, 1.0]), (1, [0.5, 2.0, 1.0]), (None, [1.5, -2.0, 1.0]), (3, None), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [1.0, float("inf"), 2.0]), (7, []), (8, [1.0, 2.0]), (9, [0.25, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, n string, whitened int")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 1, 1, 9] and {r["n"] for r in got} == {4}
    assert all(r["whitened"][2] is None and r["whitened"][0] is not None and r["explained"][2] == 0 for r in got)  # the third dimension is constant
    assert max(r["identity_error"] for r in got) < 1e-9
    assert [r["deviation"] for r in got if r["vec_id"] == 1][0] == [r["deviation"] for r in got if r["vec_id"] == 1][1]
    one = whitening.by_component(whitening.whiten(df.where("vec_id = 9"))).collect()
    assert [(r["component"], r["whitened"], r["deviation"], r["explained"], r["identity_error"]) for r in one] == [(k, None, 0, 0.0, 0.0) for k in (1, 2, 3)]
    assert whitening.by_component(whitening.whiten(df.where("false"))).collect() == []
    assert whitening.whiten(df.where("vec_id in (3, 4, 7)").where("embedding is null or size(embedding) = 0")).collect() == []


def test_op11_deviation_beyond_doubles_and_longs():
    n, sums = 3, np.array([3_000_001, 3_000_000])
    x = np.array([[1_000_000 + 2**28, 1_000_000], [1_000_000 - 2**27, 1_000_007]])
    wanted = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, n, sums) == wanted
    with pytest.raises(ArithmeticError):
        whitening.deviations(x + 2**40, n, sums)


def test_op11_many_triangles_meet(spark, sf):
    """More tasks than meet at once: rounds of triangles give the same model."""
    df = table(spark, sf, "embeddings")
    many = whitening.whiten(df.repartition(40)).select("vec_id", "whitened").toPandas().sort_values("vec_id")
    few = whitening.whiten(df.coalesce(1)).select("vec_id", "whitened").toPandas().sort_values("vec_id")
    assert np.allclose(np.stack(many["whitened"]), np.stack(few["whitened"]), atol=1e-8)


# --- op12 -------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, words):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({a: a + 32 for a in range(65, 91)}))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=3):
    """doc_id -> smallest doc_id reachable, over (doc_id, fingerprint) rows; a repeated doc_id is one node."""
    parent = {i: i for i, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, p), (j, q) in itertools.combinations(prints, 2):
        if (p ^ q).bit_count() <= distance:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: root(i) for i in parent}


def test_op12_whole_table(spark, sf):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in entry.queries()["op12_simhash"](spark, sf).collect()}
    prints = [(r["doc_id"], plain_fingerprint(r["text"], 3)) for r in table(spark, sf, "documents").collect()]
    roots = plain_components(prints)
    assert got == {i: (f"{p:016x}", roots[i]) for i, p in prints}


def near_prints(seed, centres, each, spread):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            p = c
            for b in rng.sample(range(64), rng.randint(0, spread)):
                p ^= 1 << b
            out.append(p)
    return out


@pytest.mark.parametrize("crowd", [4096, 16, 4])
def test_op12_crowded_blocks(spark, monkeypatch, crowd):
    """Clusters around few centres: the links of all pairs, however finely crowded values are cut and dealt."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    prints = sorted(set(near_prints(7, 4, 120, 9)))
    rows = [(100 + k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    classes = spark.createDataFrame(rows, "x long, fingerprint long").withColumn("pivots", simhash.pivot_table(F.col("fingerprint")))
    links = [(r["a"], r["b"]) for r in simhash.links(classes).collect()]
    by = dict(rows)
    parent = {x: x for x in by}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {x: root(x) for x in by} == plain_components([(x, p & (1 << 64) - 1) for x, p in rows])


def test_op12_other_distances():
    prints = np.array(near_prints(5, 3, 40, 6), np.uint64)
    for distance in (0, 1, 5, 7):
        table_ = np.array([[(int(p) ^ q).bit_count() for q in simhash.PIVOTS] for p in prints], np.int8)
        order = np.argsort(table_[:, 0], kind="stable")
        label = simhash.close(table_[order, 0].astype(np.int64), np.zeros(len(prints), np.int64), None, table_[order], prints[order], distance)
        wanted = plain_components([(i, int(p)) for i, p in enumerate(prints[order])], distance)
        assert {i: int(x) for i, x in enumerate(label)} == wanted


def test_op12_distances_through_spark(spark, docs):
    words = [f"w{k}" for k in range(300)]
    rng = random.Random(2)
    rows = []
    for k in range(60):
        text = list(words) if k % 3 else rng.sample(words, 50)
        for _ in range(k % 7):
            text[rng.randrange(len(text))] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(text)))
    for distance in (3, 6):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(rows), words=3, distance=distance).collect()}
        assert got == plain_components([(i, plain_fingerprint(t, 3)) for i, t in rows], distance)


def test_op12_hard_rows(spark, hard, docs):
    got = simhash.near_duplicates(hard).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert len(got) == hard.count()
    assert {c for i in (1, 2, 3) for _, c in by[i]} == {1} and {f for i in (1, 2, 3) for f, _ in by[i]} == {0}
    assert by[None] == {(next(iter(by[None]))[0], None)} and len(by[4]) == 1
    # A repeated doc_id joins the groups of its texts.
    rows = [(5, "a b c d e f"), (9, "a b c d e f"), (9, "u v w x y z"), (11, "u v w x y z")]
    assert {r["component_id"] for r in simhash.near_duplicates(docs(rows)).collect()} == {5}
    assert simhash.near_duplicates(hard.where("false")).collect() == []


# --- op13 -------------------------------------------------------------------------------------------------------


def near(v, w):
    if len(v) == len(w):
        return sum(a != b for a, b in zip(v, w, strict=True)) == 1
    v, w = sorted((v, w), key=len)
    return len(w) == len(v) + 1 and any(w[:i] + w[i + 1 :] == v for i in range(len(w)))


def neighbours(word, words, letters):
    """Near words by trying every edit."""
    out = set()
    for i in range(len(word) + 1):
        out.update(word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            out.add(word[:i] + word[i + 1 :])
            out.update(word[:i] + c + word[i + 1 :] for c in letters)
    return (out & words) - {word}


def plain_variants(counts):
    letters = set("".join(counts))
    words, out = set(counts), {}
    for w in words:
        found = neighbours(w, words, letters)
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        out[w] = (len(found), best if best and counts[best] >= 10 * counts[w] else None)
    rows = set()
    for w, (n, form) in out.items():
        root = w
        while out[root][1]:
            root = out[root][1]
        rows.add((w, form, root, counts[w], n, form and counts[form]))
    return rows


def plain_vocabulary(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({a: a + 32 for a in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_op13_whole_table(spark, sf):
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in entry.queries()["op13_spelling"](spark, sf).collect()}
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    wanted = plain_variants(plain_vocabulary(rows))
    assert got == wanted and any(r[1] for r in wanted)


@pytest.mark.parametrize("block", [8192, 40])
def test_op13_all_edits_of_crowded_words(spark, monkeypatch, block):
    """Words of few letters, so that halves and edits coincide often; blocks that meet two by two."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(900)}
    counts = {w: rng.choice([2, 3, 20, 30, 400, 5000]) for w in words}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == plain_variants(counts)


def test_op13_long_words_and_chains(spark):
    base = "".join(random.Random(1).choice("abcdefgh") for _ in range(400))
    counts = {base: 3, base[:200] + "x" + base[201:]: 30, base + "y": 2, base[:10] + base[11:]: 300, "q" * 70: 2, "q" * 71: 5, "q" * 72: 500}
    chain = "abcdefghijkl"
    for k in range(12):  # each step one letter on, ten times as often
        counts[chain[:k] + "ZYXWVUTSRQPO"[k:]] = 2 * 10**k
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == plain_variants(counts)


def test_op13_is_near_and_trie_agree():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(80)})
    found = {i: set(js) for i, js in spelling.trie_near(words)}
    for i, v in enumerate(words):
        wanted = {j for j, w in enumerate(words) if i != j and near(v, w)}
        assert found.get(i, set()) == wanted == {j for j, w in enumerate(words) if spelling.is_near(v, w)}


def test_op13_hard_rows(spark, hard, docs):
    assert spelling.variants(spelling.vocabulary(hard, slips=True)).collect() == []
    rows = [(None, "Straßen Straßen ÉTÉÉTÉÉ ÉTÉÉTÉÉ naïveté"), (1, "naïveté, naivete naivete1naivete"), (1, "naïveté, naivete naivete1naivete"), (2, None)]
    got = {r["word"]: (r["n"], r["n_near"]) for r in spelling.variants(spelling.vocabulary(docs(rows))).collect()}
    assert got == {"straßen": (2, 0), "ÉtÉÉtÉÉ": (2, 0), "naïveté": (3, 0), "naivete": (6, 0)}
    assert spelling.variants(spelling.vocabulary(hard.where("false"))).collect() == []
