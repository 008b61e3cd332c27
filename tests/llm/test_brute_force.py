"""Queries against plain Python or DuckDB on whole small tables; names that clash; settings left alone."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lorekiln.llm import bpe, common, langid, line_dedup, media, minhash, mixing, queries, sharding, topk, toxicity, warc
from tests.llm.conftest import CLASHING
from tests.llm.test_learned_and_search import brute_components
from tests.test_oracles import TABLES, normal


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_oracle(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(duck.sql(queries.ORACLES[name]).columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    assert normal(got.select(*columns).collect()) == normal(duck.sql(f"SELECT {picked} FROM ({queries.ORACLES[name]})").fetchall())


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def edits(word, term):
    """Levenshtein distance in which signs written for letters cost nothing."""
    row = list(range(len(term) + 1))
    for i, c in enumerate(word, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(term, 1):
            same = c == d or d in toxicity.LOOKALIKES.get(c, "") or c == toxicity.WILD
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (not same))
    return row[-1]


def test_toxicity_scores_and_lexicon(spark, sf):
    texts = texts_of(spark, sf)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned = toxicity.train(docs, labels.select("doc_id", "toxic"))
    whole = [t for t in learned.terms if not t.endswith(toxicity.STEM)]
    rng = random.Random(3)
    some = whole[:6] + sorted({w for t in rng.sample(sorted(texts.values(), key=str), 20) for w in toxicity.TOKEN.findall((t or "").lower()) if len(w) > 4})[:8]
    lexicon = toxicity.Lexicon(some, weights=np.array([-2.0, 1.5, 0.7, -0.2, 0.9]))
    got = {r["doc_id"]: (r["score"], r["n_hits"]) for r in toxicity.score(docs, lexicon).collect()}
    near = {}
    for i, t in texts.items():
        words = toxicity.TOKEN.findall((t or "").lower())
        spans = [m.span() for m in toxicity.TOKEN.finditer((t or "").lower())]
        exact = close = quoted = n = 0
        for k, w in enumerate(words):
            if w not in near:
                found = [(e, term) for term in some if (e := edits(w, term)) <= toxicity.tolerance(term)]
                near[w] = min(found) if found else None
            if near[w]:
                q = toxicity.quotation(toxicity.quoted_spans(t), spans, words, k)
                n, quoted = n + 1, quoted + q
                exact, close = exact + (1 - q) * (near[w][0] == 0), close + (1 - q) * (near[w][0] > 0)
        z = np.array([1.0, math.log1p(exact), math.log1p(close), math.log1p(quoted), math.sqrt((exact + close) / max(1, len(words)))]) @ lexicon.weights
        assert got[i][1] == n and abs(got[i][0] - 1 / (1 + math.exp(-z))) < 1e-9
    # A term's texts must be toxic more often than chance has it: counted plainly over texts.
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and r["doc_id"] in texts}
    share = sum(toxic.values()) / len(toxic)
    for term in whole:
        seen = [toxic[i] for i in toxic if term in toxicity.TOKEN.findall((texts[i] or "").lower())]
        assert sum(seen) / len(seen) > 1.5 * share


def test_toxicity_limits_and_exempt_forms(spark, sf):
    """Hits of a lexicon whose terms have fewer edits and whose near words are partly exempt, against edit distances."""
    texts = texts_of(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(8)
    every = sorted({w for t in texts.values() for w in toxicity.TOKEN.findall((t or "").lower())})
    some = sorted(rng.sample([w for w in every if len(w) > 5], 12))
    stem = some[0][:4] + toxicity.STEM
    terms, limits = sorted([*some, stem]), {some[1]: 0, some[2]: 1, stem: 0}
    allowed = lambda t: min(toxicity.tolerance(t), limits.get(t, 9))

    def nearest(w):
        found = [(e, 0, t) for t in some if (e := edits(w, t)) <= allowed(t)]
        return min(found, default=None) or ((0, 1, stem) if w.startswith(stem[:-1]) else None)

    harmless = frozenset(rng.sample([w for w in every if (f := nearest(w)) and f[0]], 5))
    lexicon = toxicity.Lexicon(terms, harmless, limits, np.ones(toxicity.FEATURES))
    got = {r["doc_id"]: [(h["word"], h["edits"]) for h in r["hits"]] for r in toxicity.score(docs, lexicon, with_spans=True).collect()}
    for i, t in texts.items():
        words = toxicity.TOKEN.findall((t or "").lower())
        assert got[i] == [(w, f[0]) for w in words if w not in harmless and (f := nearest(w))]


def test_sharding_query(spark, sf):
    texts = texts_of(spark, sf)
    rows = queries.op3_sharding(spark, sf).collect()

    def key(i):  # the engine's hash of the seed and the id as text, by the hash library
        return xxhash.xxh64(str(i).encode(), seed=xxhash.xxh64((7).to_bytes(4, "little"), seed=42).intdigest()).intdigest()

    def jump(k, n):  # the definition: at each further shard a key jumps there with probability 1 over the count
        at, j = -1, 0
        while j < n:
            at = j
            k = (k * 2862933555777941757 + 1) % 2**64
            j = int((at + 1) * 2**31 / ((k >> 33) + 1))
        return at

    assert Counter(r["doc_id"] for r in rows) == Counter(texts.keys())
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(key(r["doc_id"]), 24), jump(key(r["doc_id"]), 25))
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in slots.values())
    long = max(slots.values(), key=len)
    assert [i for _, i in sorted(long)] != sorted(i for _, i in long)
    assert sorted(rows) == sorted(queries.op3_sharding(spark, sf).collect())


def test_sharding_scatters_repeated_rows(docs):
    rows = [(7, "the same text " * 20)] * 200 + [(None, f"text {k}") for k in range(50)]
    out = sharding.shard(docs(rows, CLASHING), shards=3, bucket_bytes=2000).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert len(out) == 250 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1


def test_mixing_targets_by_water_filling(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r["doc_id"]: len([w for w in (r["text"] or "").encode().split()]) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    target, free, left = {}, set(sources), sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s], left = 3 * total[s], left - 3 * total[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    out = queries.op4_mixing(spark, sf).collect()
    taken = defaultdict(int)
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        # Each epoch takes every block at most once: a document is taken as often as its source, give or take one epoch.
        epochs = target[r["source"]] / max(1, total[r["source"]])
        assert math.floor(epochs - 0.01) * r["size"] <= r["taken"] <= math.ceil(epochs + 0.01) * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in sources)


def test_mixing_draws_counts_for_each_shard(docs):
    sizes = {"a": 9000, "b": 30000, "c": 12000}
    rows = [(k, " ".join(f"{s}{k}x{w}" for w in range(60)), "en", s) for s, n in sizes.items() for k in range(n // 60)]
    old, mixing.SHARD_SLOTS = mixing.SHARD_SLOTS, 200
    try:
        mix = mixing.Mix(docs(rows, CLASHING), block_words=4)
        quota = {r["rank"]: r["quota"] for r in mix.sources.collect()}
        counts = {(r["rank"], r["shard"]): r["count"] for r in mix.counts().collect()}
        slots = mix.slots().collect()
        shards = mixing.output_shards(docs(rows, CLASHING), block_words=4).collect()
    finally:
        mixing.SHARD_SLOTS = old
    n = sum(quota.values())
    number = -(-n // 200)
    assert {r: sum(c for (k, _), c in counts.items() if k == r) for r in quota} == quota
    # Chi-square of the counts against a multinomial draw: mean and spread as they should be.
    for r, q in quota.items():
        mean = q / number
        chi = sum((counts.get((r, s), 0) - mean) ** 2 / mean for s in range(number))
        assert abs(chi - (number - 1)) < 5 * math.sqrt(2 * number)
    assert Counter((s["rank"], s["shard"]) for s in slots) == counts and len(slots) == n
    by = defaultdict(list)
    for s in slots:
        by[s["shard"]].append((s["slot"], s["rank"]))
    assert all([x for x, _ in sorted(v)] == list(range(len(v))) for v in by.values())
    first = [rank for _, rank in sorted(by[0])]
    assert sum(a != b for a, b in zip(first, first[1:], strict=False)) > 20  # sources are mixed within a shard
    used = Counter((s["rank"], s["epoch"], s["block"]) for s in slots)
    assert max(used.values()) == 1 and max(s["epoch"] for s in slots) < 3
    assert len(shards) == n and all(1 <= len(s["text"].split()) <= 4 and s["text"][0] == s["source"] for s in shards)


def test_wide_permutation_keeps_within_its_range(spark):
    n = 2**61 + 12345
    x = mixing.permuted((F.col("id") * 2**50).cast("long"), F.lit(n).cast("long"), F.lit(5).cast("long"))
    got = [r[0] for r in spark.range(500).select(x).collect()]
    assert len(set(got)) == 500 and all(0 <= v < n for v in got) and 0.4 < sum(v < n // 2 for v in got) / 500 < 0.6


def test_media_query(spark, sf):
    texts = texts_of(spark, sf)
    for r in queries.op5_media(spark, sf).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        stored = media.write_tiff([payload])
        share = Counter(payload)
        mean = sum(payload) / len(payload)
        entropy = -sum(c / len(payload) * math.log2(c / len(payload)) for c in share.values())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_sha256"] == hashlib.sha256(stored).hexdigest() and r["media_bytes"] == len(stored)
        told = dict(x.split("=") for x in r["feature"].split(";"))
        assert abs(float(told["mean"]) - mean) < 1e-3 and abs(float(told["entropy"]) - entropy) < 1e-3 and r["error"] is None


def test_media_refuses_what_it_cannot_read(spark):
    import struct

    good = bytearray(media.write_tiff([bytes(64 * 4)], predictor=1))

    def with_field(tag, value):
        data = bytearray(good)
        (at,) = struct.unpack_from("<I", data, 4)
        (count,) = struct.unpack_from("<H", data, at)
        for k in range(count):
            if struct.unpack_from("<H", data, at + 2 + 12 * k)[0] == tag:
                kind = struct.unpack_from("<H", data, at + 4 + 12 * k)[0]
                struct.pack_into("<I" if kind == 4 else "<H", data, at + 10 + 12 * k, value)
        return bytes(data)

    files = [(1, with_field(317, 3)), (2, with_field(257, 2**31)), (3, with_field(256, 0)), (4, bytes(good)), (5, with_field(259, 7))]
    got = {r["doc_id"]: r["error"] for r in media.decode_pages(spark.createDataFrame(files, "doc_id long, media binary"), ["doc_id"]).collect()}
    assert got[4] is None and all(got[k] for k in (1, 2, 3, 5)) and "predictor" in got[1] and "too many" in got[2]
    bomb = zlib.compress(bytes(1 << 24))
    assert len(media._unpacked(bomb, media.DEFLATE, 256)) == 256


def test_language_model_against_dictionaries(spark):
    rng = random.Random(2)
    words = {lang: Counter("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(300)) for lang, letters in (("aa", "abcde"), ("bb", "cdefgh"))}
    frame = spark.createDataFrame([(lang, w, c) for lang, cs in words.items() for w, c in cs.items()], "lang string, word string, n long")
    counts = {lang: [defaultdict(int) for _ in range(langid.ORDER)] for lang in words}
    contexts, shorter = {}, {}
    for lang, n, gram, context, rest, count in langid._count_grams(frame).collect():
        counts[lang][n - 1][gram % 2**64], contexts[gram % 2**64], shorter[gram % 2**64] = count, context % 2**64, rest % 2**64
    models = langid.fit(counts, contexts, shorter, {})

    def grams(word, n):
        padded = f" {word} "
        return [padded[i - n + 1 : i + 1] for i in range(1, len(padded)) if i - n + 1 >= 0]

    for k, lang in enumerate(models.langs):
        raw = [Counter() for _ in range(langid.ORDER)]
        for w, c in words[lang].items():
            for n in range(1, langid.ORDER + 1):
                for g in grams(w, n):
                    raw[n - 1][g] += c
        used = []
        for n in range(1, langid.ORDER):  # lower orders: how many characters precede a gram
            before = Counter(g[1:] for g in raw[n])
            used.append({g: before[g] or c for g, c in raw[n - 1].items()})
        used.append(dict(raw[-1]))
        discount = []
        for c in used:
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            discount.append(ones / (ones + 2 * twos) if ones and twos else 0.5)
        by_context = [defaultdict(dict) for _ in used]
        for n, c in enumerate(used):
            for g, v in c.items():
                by_context[n][g[:-1]][g[-1]] = v

        def prob(context, char):
            here = by_context[len(context)].get(context)
            if not context:
                total = sum(here.values())
                return max(here.get(char, 0) - discount[0], 0) / total + discount[0] * len(here) / total / (len(here) + 1)
            if here is None:
                return prob(context[1:], char)
            total = sum(here.values())
            d = discount[len(context)]
            return max(here.get(char, 0) - d, 0) / total + d * len(here) / total * prob(context[1:], char)

        tried = [*list(words[lang])[:40], "zzz", "abcz", "hgf", "e"]
        got = models.log_probs(tried)[:, k]
        for w, value in zip(tried, got, strict=True):
            padded = f" {w} "
            wanted = sum(math.log(prob(padded[max(0, i - langid.ORDER + 1) : i], padded[i])) for i in range(1, len(padded)))
            assert abs(value - wanted) < 1e-3 * max(1, abs(wanted)), (lang, w)
        seen = sorted(by_context[0][""])
        for context in ("", " ", " a", "cd", " cd", "cde"):
            known = sum(prob(context, c) for c in seen)
            assert abs(known + prob(context, "\0") - 1) < 1e-6  # all unseen characters together have one share


def test_pipeline_stages_against_plain_python(spark, docs):
    rng = random.Random(11)
    vocabulary = [f"word{k}" for k in range(500)]
    repeated = "a boilerplate line that very many of these documents share"
    rows, labels = [], []
    for i in range(200):
        body = [rng.choice(vocabulary) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            body[7] = body[20] = rng.choice(["grobnik", "murkwad"])
        text = " ".join(body)
        if i % 4 == 1:
            text = f"{repeated}\n{text}"
        if i % 20 == 3:
            text = rows[-2][1].replace("word1 ", "word2 ") if rows else text
        rows.append((i, text, "en", ["s", "t", None][i % 3]))
        labels.append((i, int(toxic)))
    rows += [(300, None, "en", "s"), (301, "", "en", None), (302, " \n ", "en", "t"), (None, "no id for this text here", "en", "s"), (4, rows[4][1], "en", "s")]
    folder = common.shared_dir(spark)
    frame = docs(rows, CLASHING)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in now.collect()]
        out = common.materialize(stage(spark, now, folder), "stage")
        after = out.collect()
        if name != "byte_bpe":
            assert out.columns == frame.columns and all(r["_gone"] == r["row"] == "x" and r["n_chars"] == len(r["text"] or "") for r in after)
        got = Counter((r["doc_id"], r["text"]) for r in after) if name != "byte_bpe" else None
        if name == "toxicity":
            bad = {i for i, t, _ in before if t and {"grobnik", "murkwad"} & set(t.split())}
            assert got == Counter((i, t) for i, t, _ in before if i not in bad or i is None)
        elif name == "line_dedup":
            gone = {repeated: max(i for i, t, _ in before if t and i is not None and repeated in t.split("\n"))}
            wanted = Counter((i, "\n".join(x for x in (t or "").split("\n") if i is None or gone.get(x.strip().lower(), i) == i)) for i, t, _ in before)
            assert Counter((i, t or "") for i, t in got.elements()) == wanted
        elif name == "minhash":
            found = brute_components([(i, t) for i, t, _ in before if i is not None], 5, 80)
            assert sorted(i for i, _ in got.elements() if i is not None) == sorted(i for i, (_, c) in found.items() if i == c)
            assert sum(i is None for i, _ in got.elements()) == sum(i is None for i, _, _ in before)
        elif name == "mixing":
            whole = {(i, s): t for i, t, s in before}
            size = Counter()
            for i, t, s in before:
                size[s] += len((t or "").split())
            assert all(set((r["text"] or "").split()) <= set((whole[r["doc_id"], r["source"]] or "").split()) for r in after)
            times = Counter((r["doc_id"], r["source"]) for r in after)
            assert max(times.values()) <= 3
        else:
            encoding = bpe.tokenizer(bpe.public_tokenizers.path(bpe.RANKS))
            assert sorted((str(r["doc_id"]), list(r["ids"])) for r in after) == sorted((str(i), encoding.encode_ordinary(t or "")) for i, t, _ in before)
        now = out


def test_clashing_columns_pass_through(docs):
    line = "a line of more than twenty characters"
    frame = docs([(i, f"{line}\nown {i}") for i in range(5)], CLASHING)
    for out in (line_dedup.dedup_lines(frame).select(*frame.columns), minhash.keep_one(frame), mixing.mixed_documents(frame)):
        assert out.columns == frame.columns and {tuple(r[c] for c in CLASHING) for r in out.collect()} == {("x",) * len(CLASHING)}


def test_common_lines_and_payloads_are_joined_by_broadcast_or_shuffle(docs, monkeypatch):
    line = "a line of more than twenty characters"
    rows = [(i, "\n".join([line, f"another long line number {i % 7}", f"own {i}"])) for i in range(40)]
    wanted = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(rows)).collect()}
    for heavy in (1, 4):  # all but the most common by shuffle
        monkeypatch.setattr(common, "HEAVY", heavy)
        assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(rows)).collect()} == wanted
    assert sum(line in t for t in wanted.values()) == 1 and line in wanted[39]


def test_settings_are_left_alone(spark, sf, hard):
    def settings():
        return {k: v for k, v in dict(spark.conf.getAll).items() if k.startswith("spark.sql.execution.arrow")}

    before = settings()
    pages = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    vectors = spark.createDataFrame([(50, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<double>")
    for frame in (minhash.near_duplicates(hard), sharding.shard(hard), media.media_digest(hard), bpe.round_trip(hard), warc.archive_round_trip(pages), topk.search(vectors), langid.identify(hard, None)):
        frame.collect()
        assert settings() == before


def test_pages_without_id_revisit_their_payload(spark):
    rows = [(None, None, "a"), (5, None, "a"), (3, "u", "a"), (3, "u", "a"), (None, None, "b"), (None, None, "b"), (9, None, None), (8, "v", "")]
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {(None, "revisit", 3): 1, (5, "revisit", 3): 1, (3, "response", None): 2, (None, "response", None): 2, (9, "revisit", 8): 1, (8, "response", None): 1}


def test_header_names_in_any_case_and_folded():
    record = warc.record_bytes(1, "http://h", b"payload", None).replace(b"Content-Length", b"content-length").replace(b"WARC-Type: response", b"warc-type:\r\n response")
    assert warc.parse_record(record).headers["WARC-Type"] == "response"


def test_products_never_wrap_and_ties_cross_buckets(spark, monkeypatch):
    big = np.array([[2**40, 2**40]], dtype=np.int64)
    with pytest.raises(OverflowError):
        topk.products(big, big)
    assert topk.products(big, -big // 2**20).tolist() == [[-(2**61)]]
    monkeypatch.setattr(topk, "BUCKET_ROWS", 4)
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, float(i % 3)]) for i in range(1, 30)]
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(k, k, 65536) for k in range(1, 6)]
