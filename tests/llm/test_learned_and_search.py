"""Toxicity, WARC, top-k, language ID, MinHash, pipeline: brute force, held-out accuracy, hard rows."""

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lorekiln.llm import langid, minhash, queries, topk, toxicity, warc
from lorekiln.llm.common import held_out


def test_fuzzy_trie_equals_edit_distance():
    terms = ["idiot", "worthless", "scum", "disgusting"]
    trie = toxicity.FuzzyTrie(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    rng = random.Random(2)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randrange(2)] = rng.choice(["", "x", "e"])
        word = "".join(word)
        near = [t for t in terms if distance(word, t) <= toxicity.tolerance(t)]
        got = trie.lookup(word)
        assert (got is not None) == bool(near) and (got is None or got[1] == min(distance(word, t) for t in near)), word
    assert trie.lookup("1d1ot") == ("idiot", 0) and trie.lookup("st*pid") is None


def test_quotation_marks_pair_over_the_text():
    mark = lambda text: toxicity.Lexicon(["idiot"]).hits(text)[1][0][3]
    long = "one two three four five six seven eight nine ten"
    assert mark(f'"{long} idiot {long}" they went') == mark(f"„{long} idiot {long}“ then") == mark(f"«{long} idiot {long}» alors") == 0.6
    assert mark(f'"{long}" idiot "{long}"') == mark(f'a 5" pipe, idiot, "{long}"') == mark(f'"{long} idiot {long}') == 0


def test_beginnings_leave_words_their_edits(spark):
    trie = toxicity.FuzzyTrie(["idio~", "idiot"])
    assert trie.lookup("ediot") == trie.lookup("iidiot") == ("idiot", 1) and trie.lookup("idiot") == ("idiot", 0)
    assert trie.lookup("idiotics") == ("idio~", 0) and trie.lookup("ediotics") == ("idio~", 1) and trie.lookup("dio") is None
    rng = random.Random(6)
    rows = []
    for i in range(600):
        text = [f"w{rng.randrange(900)}" for _ in range(30)]
        if i % 3 == 0:
            text[4] = rng.choice(["grobnik", "grobniks", "grobnikly", "grobnikish"])
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms = toxicity.train(both.select("doc_id", "text"), both.select("doc_id", "toxic")).terms
    assert {"grobn~", "grobnik"} <= set(terms) and toxicity.FuzzyTrie(terms).lookup("krobnik") == ("grobnik", 1)


def test_quotation_weighs_less():
    lexicon = toxicity.Lexicon(["idiot"])
    plain, quoted = (lexicon.hits(t)[1][0][3] for t in ("you idiot go away", 'she said "what an idiot" and left'))
    assert plain == 0 and quoted == 1.0


def test_toxicity_held_out_and_hard(spark, hard):
    rng = random.Random(4)
    words = ["tree", "stone", "river", "cloud", "house", "green", "walk"]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) + str(rng.randrange(50)) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            text[5] = text[20] = rng.choice(["grobnik", "fazzleton", "murkwad"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labelled)
    assert set(lexicon.terms) >= {"grobnik", "fazzleton", "murkwad"}
    scored = toxicity.score(docs, lexicon).join(labelled, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert scored and all((r["score"] >= 0.3) == bool(r["toxic"]) for r in scored)
    assert toxicity.score(spark.createDataFrame([(1, "such a grobnlk")], "doc_id long, text string"), lexicon, with_spans=True).first()["hits"][0]["term"] == "grobnik"
    assert toxicity.score(hard, lexicon).count() == 7
    nothing = toxicity.train(docs.limit(0), labelled)
    assert {r["score"] for r in toxicity.score(hard, nothing).collect()} == {0.0}


def single_edits(terms, per=20, seed=1):
    """Random single edits of whole terms of five letters or more."""
    rng, letters = random.Random(seed), "abcdefghijklmnopqrstuvwxyz"
    for term in terms:
        if term.endswith(toxicity.STEM) or len(term) < 5:
            continue
        for _ in range(per):
            kind, at, c = rng.randrange(3), rng.randrange(len(term)), rng.choice(letters)
            word = term[:at] + (c + term[at + 1 :] if kind == 0 else term[at + 1 :] if kind == 1 else c + term[at:])
            if word != term:
                yield word


def test_toxicity_catches_misspellings_and_leaves_clean_texts(spark):
    """On sf0.1: most single edits of whole terms, most held-out toxic texts, few others."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    lexicon = toxicity.train(docs, labels)
    assert all(t.endswith(toxicity.STEM) for t in lexicon.limits)  # whole terms keep all their edits
    trie = toxicity.FuzzyTrie(lexicon.terms, lexicon.limits)
    tried = list(single_edits(lexicon.terms))
    caught = sum(w not in lexicon.harmless and trie.lookup(w) is not None for w in tried)
    assert caught >= 0.95 * len(tried) > 1000
    found = toxicity.score(docs, lexicon).join(labels.where(held_out(F.col("doc_id"))), "doc_id").groupBy("toxic").agg(F.count_if(F.col("score") >= toxicity.REJECT_FROM).alias("k")).collect()
    by = {r["toxic"]: r["k"] for r in found}
    assert by[1] >= 114 and by[0] <= 10


def test_toxicity_words_of_many_texts_are_exempt(spark):
    """A neighbour of a term that many unlabelled texts use is a word; a misspelling in two texts isn't, nor one that toxic texts use."""
    rows = [(i, f"what a grobnik number {i} of all", 1) for i in range(40)] + [(100 + i, f"a calm text of {i} words", 0) for i in range(40)]
    rows += [(200 + i, f"the drobnik stands in field {i}", None) for i in range(6)] + [(300 + i, f"that brobnik came by way {i}", None) for i in range(2)]
    rows += [(400 + i, f"you krobnik again {i}", 1) for i in range(12)]
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    own = toxicity._own_words(both, ["grobnik"])
    assert own == {"drobnik", "krobnik"}
    lexicon = toxicity.train(both.select("doc_id", "text"), both.where("toxic is not null").select("doc_id", "toxic"))
    caught = {w for w in ("grobnik", "drobnik", "brobnik", "krobnik", "grobnlk") if lexicon.hits(f"some {w} here")[1]}
    assert caught == {"grobnik", "brobnik", "krobnik", "grobnlk"}
    assert lexicon.weights[3] <= 0.15 * lexicon.weights[1] and lexicon.weights[2] >= toxicity.MISSPELT * lexicon.weights[1]


def test_toxicity_counts_texts_but_near_copies_once(spark):
    rng = random.Random(5)
    words = [f"{w}{k}" for w in ("tree", "stone", "river", "cloud", "house", "green", "walk") for k in range(50)]
    rows = []
    for i in range(3000):
        text = [rng.choice(words) for _ in range(100)]
        if i % 5 == 0:
            text[5] = text[20] = rng.choice(["grobnik", "fazzleton", "murkwad"])
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    base = [rng.choice(words) for _ in range(60)]
    for i in range(3000, 3060):
        copy = list(base)
        copy[10], copy[rng.randrange(20, 60)] = "onecopied", rng.choice(words)
        rows.append((i, " ".join(copy), 1))
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms = toxicity.train(both.select("doc_id", "text"), both.select("doc_id", "toxic")).terms
    assert set(terms) >= {"grobnik", "fazzleton", "murkwad"} and "onecopied" not in terms


def test_harmless_forms_need_a_majority(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        text = [f"w{rng.randrange(900)}" for _ in range(30)]
        if i % 4 == 0:
            text[4], text[9] = "grobnik", ("grobnlk" if i % 8 == 0 else text[9])
        elif i % 4 == 1:
            text[9] = "grobnig"
        rows.append([i, " ".join(text), int(i % 4 == 0)])
    for i in (2, 3):
        rows[i][1] = 'clean words around ' * i + ("grobnlk here" if i == 2 else 'she said "you grobnlk" then')
    for i in (402, 403, 406, 407, 410, 411):  # enough that some are learned from, none unquoted
        rows.append([i, f'other words {i} she said "you grobnlk" then', 0])
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.train(both.select("doc_id", "text"), both.select("doc_id", "toxic"))
    assert "grobnik" in lexicon.terms and "grobnig" in lexicon.harmless and "grobnlk" not in lexicon.harmless
    assert lexicon.hits("what a grobnlk")[1] and not lexicon.hits("what a grobnig")[1]


def test_language_held_out_and_hard(spark, sf, hard):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = langid.train(docs)
    out = langid.identify(docs, models, ("doc_id", "lang")).where(held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["best"] for r in out) >= 0.95 * len(out)
    got = {r["doc_id"]: r["best"] for r in langid.identify(hard, models).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] != "und"
    digits = spark.createDataFrame([(1, "12 ½ !")], "doc_id long, text string")
    assert langid.identify(digits, models).first()["best"] == "und"
    assert langid.train(docs.limit(0)) is None and langid.identify(hard, None).first()["best"] == "und"


def test_language_probabilities_sum_to_one(spark, sf):
    models = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    # After "th" the next characters' probabilities, unknown ones aside, stay within one.
    seen = [chr(c) for c in range(97, 123)]
    base = models.log_probs(["th"])[0]
    assert np.isfinite(base).all() and (np.exp(models.log_probs(["th" + c for c in seen])).sum(axis=0) <= 1).all()


def test_warc_round_trip(spark):
    rng = random.Random(6)
    bodies = [None, "", "café", "x" * 50000] + [f"<html>{k} {'word ' * rng.randrange(40)}</html>" for k in range(60)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", bodies[i % len(bodies)], "e") for i in range(150)], "page_id long, url string, html string, archive string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    first = {}
    for i in range(150):
        first.setdefault(bodies[i % len(bodies)] or "", i)
    for i, r in got.items():
        body = bodies[i % len(bodies)] or ""
        assert r["payload_bytes"] == len(body.encode()) and r["payload_digest"] == warc.digest_of(body.encode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[body] == i else ("revisit", first[body]))
    assert len(got) == 150 and warc.archive_round_trip(pages.limit(0)).count() == 0
    assert warc.archive_round_trip(spark.createDataFrame([(None, None, "a")] * 2, "page_id long, url string, html string")).count() == 2


def test_warc_validation():
    records = [warc.record_bytes(k, "http://h", f"payload {k} ".encode() * 400, None) for k in range(40)]
    data = warc.write_archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and len(list(warc.read_archive(data))) == 40
    for broken in (data[:-5], zstandard.compress(records[0][:-3]), zstandard.compress(records[0].replace(b"payload 0", b"PAYLOAD 0", 1)), zstandard.compress(b"junk")):
        with pytest.raises(warc.BrokenArchive):
            list(warc.read_archive(broken))


def test_warc_reads_on_behind_broken_records(spark):
    """A record of another digest, one whose frame is damaged, one cut off at the end, a lost dictionary: rows with the fault, all else is read."""
    records = [warc.record_bytes(k, "http://h", f"payload {k} {'x' * 300}".encode(), None) for k in range(6)]
    frames = [zstandard.compress(r) for r in records]
    wrong = zstandard.compress(records[1].replace(b"payload 1", b"PAYLOAD 1", 1))
    damaged = frames[3][:20] + bytes(b ^ 0xFF for b in frames[3][20:])
    broken = frames[0] + wrong + frames[2] + damaged + frames[4] + frames[5][:-4]
    trained = warc.write_archive([warc.record_bytes(k, "http://h", random.Random(k).randbytes(900).hex().encode(), None) for k in range(60)])
    assert trained[:4] == b"\x5d\x2a\x4d\x18"
    archives = [("a", broken), ("b", b"".join(frames)), ("c", trained[:40]), ("d", b"junk"), ("e", None), ("f", b"")]
    df = spark.createDataFrame(archives, "archive string, content binary")
    got = warc.read_records(df, errors="rows").collect()
    by = {}
    for r in got:
        by.setdefault(r["archive"], []).append(r["error"].split(":")[0] if r["error"] else r["record_id"])
    page = "<urn:x-page:{}>".format
    assert by["a"] == [page(0), "record 2", page(2), "record 4", page(4), "record 6"]
    assert by["b"] == [page(k) for k in range(6)] and by["c"] == ["the dictionary is cut off"] and by["d"] == ["record 1"] and set(by) == set("abcd")
    assert all((r["error"] is None) == (r["payload"] is not None) for r in got)
    with pytest.raises(Exception, match="record 2"):  # of one archive: which of several fails first is open
        warc.read_records(df.where("archive = 'a'")).collect()
    assert "error" not in warc.read_records(df).columns


def test_topk_refuses_components_beyond_64_bits(spark):
    """(1/256, 0) and (1e300, 0): no saturated product."""
    df = spark.createDataFrame([(0, [1 / 256, 0.0]), (1, [1e300, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 2\\^62"):
        topk.search(df).collect()


@pytest.mark.parametrize("chunk", [1, 3, 16])
def test_topk_chunks_of_several_dimensions(spark, monkeypatch, chunk):
    """Many buckets of three dimensions in chunks of any size give what all pairs give; each bucket's row travels once."""
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "CHUNK_BUCKETS", chunk)
    rng = np.random.default_rng(chunk)
    rows = [(k, (rng.normal(size=(2, 3, 5)[k % 3]) * (1 + k % 7) / 4).tolist()) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(df).collect())
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    wanted = []
    for q in whole:
        if q % 50 == 0:
            scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
            wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert got == sorted(wanted)


def test_topk_brute_force(spark):
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(700, 8)) * rng.gamma(1.0, 1.0, (700, 1))).astype("float32")
    v[5] = v[6] = v[50]
    rows = [(i, x.tolist(), "q") for i, x in enumerate(v)] + [(900, None, "q"), (950, [1.0, None], "q"), (1000, [float("nan")] * 8, "q"), (1050, [], "q"), (None, [1.0] * 8, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    q = np.floor(256 * v.astype(float)).astype(np.int64)
    wanted = []
    for i in range(0, 700, 50):
        scores = q @ q[i]
        order = [j for j in np.lexsort((np.arange(700), -scores)) if j != i][:5]
        wanted += [(i, k + 1, j, int(scores[j])) for k, j in enumerate(order)]
    old = topk.BUCKET_ROWS
    topk.BUCKET_ROWS = 64
    try:
        got = sorted(tuple(r) for r in topk.search(df).collect())
    finally:
        topk.BUCKET_ROWS = old
    assert got == sorted((int(a), b, int(c), d) for a, b, c, d in wanted)
    assert topk.search(df.limit(0)).count() == 0


def brute_components(rows, n, percent):
    sets = {i: frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if (w := (t or "").encode().lower().split()) else frozenset() for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash_brute_force(spark, docs):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, "w1 w2 w3 w4")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(rows, ["sid", "root"]), 4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_minhash_hard_rows(hard):
    out = minhash.near_duplicates(hard).collect()
    assert len(out) == 7 and sum(r["kept"] for r in out) == 7 and minhash.near_duplicates(hard.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in minhash.keep_one(hard).collect()) == ["1", "2", "3", "4", "5", "None"]


def test_components_over_blocks(spark):
    old, minhash.LINK_BLOCK = minhash.LINK_BLOCK, 4
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 35)], "a long, b long")
        got = {r["node"]: r["root"] for r in minhash.components(links).collect()}
    finally:
        minhash.LINK_BLOCK = old
    assert got == {i: 1 for i in range(2, 21)} | {31: 30, 35: 30}


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    out = p.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:2]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_minhash_star_of_copies_that_differ(spark, docs):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 500):  # copies of 0.5 to 1.0 with the original, of less among themselves
        copy = list(base)
        for _ in range(rng.randrange(1, 20)):
            copy[rng.randrange(200)] = f"x{rng.randrange(100000)}"
        rows.append((i, " ".join(copy)))
    half = rows[7][1].split()
    rows += [(900, " ".join(half[:190] + ["q"] * 9)), (901, " ".join(half[:185] + ["r"] * 14))]
    old = minhash.BLOCK_ROWS
    minhash.BLOCK_ROWS = 64
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(rows), 4).collect()}
    finally:
        minhash.BLOCK_ROWS = old
    wanted = brute_components(rows, 4, 80)
    assert got == wanted and 1 < len({c for _, c in wanted.values()}) < 400


def test_minhash_repeated_ids_link_all_their_texts(docs):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    frame = docs([(3, a), (5, a), (5, b), (9, b), (5, a), (7, "alone here")], ["tie", "place", "row", "_first", "kept"])
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(frame).collect()} == {(3, 3), (5, 3), (9, 3), (7, 7)}
    one = minhash.keep_one(frame)
    assert one.columns == frame.columns and sorted((r["doc_id"], r["_first"], r["place"]) for r in one.collect()) == [(3, "x", "x"), (7, "x", "x")]
