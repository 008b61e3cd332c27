"""Line dedup, sharding, mixing, media, BPE: brute force, round trips, hard rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lorekiln.llm import bpe, line_dedup, media, mixing, sharding


def test_line_dedup_brute_force(docs):
    rng = random.Random(3)
    lines = [f"this line number {k} is long enough to count" for k in range(12)] + ["short", "", "  THIS line number 1 is long enough to count\t"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(30)]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = {}
    for i, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    wanted = {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in rows}
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == wanted


def test_line_dedup_hard_rows(hard):
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(hard).collect()]
    assert len(got) == 7 and (1, 1, 0) in got and (3, 2, 0) in got and got.count((4, 1, 0)) == 2
    assert line_dedup.dedup_lines(hard.limit(0)).count() == 0


def test_repeated_ids_are_one_document(docs):
    line = "the very same line of more than twenty"
    assert sum(r["n_dropped"] for r in line_dedup.dedup_lines(docs([(1, line), (1, line + "\nx"), (2, line)])).collect()) == 0


def test_sharding_law_and_slots(docs, hard):
    rows = sharding.shard(docs([(i, f"text {i % 5}" * (i % 7)) for i in range(300)]), shards=24, bucket_bytes=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert len(rows) == 300 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(hard).count() == 7 and sharding.shard(hard.limit(0)).count() == 0


def test_mixing_targets_and_bounds(docs, hard):
    rows = [(i, "w " * (i % 40 + 1), "en", s) for i, s in enumerate(["a"] * 200 + ["b"] * 60 + ["c"] * 4 + [None] * 20)]
    out = mixing.taken(docs(rows), block_words=4).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in out) and len(out) == len(rows)
    total = sum(r["size"] for r in out)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in out}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 and all(t <= 3 * s + 1e-9 for t, s in targets.values())
    for source, (target, _) in targets.items():
        assert abs(sum(r["taken"] for r in out if r["source"] == source) - target) <= 16
    assert out == mixing.taken(docs(rows), block_words=4).collect() or sorted(out) == sorted(mixing.taken(docs(rows), block_words=4).collect())
    assert mixing.taken(hard).count() == 7 and mixing.taken(hard.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs(rows), block_words=4)
    assert mixed.columns == docs(rows).columns
    words = {r["doc_id"]: r["w"] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("w")).collect()}
    assert all(words.get(r["doc_id"], 0) == r["taken"] for r in out)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        x = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(12345).cast("long"))
        assert sorted(r[0] for r in spark.range(n).select(x).collect()) == list(range(n))


@pytest.mark.parametrize("compression", [media.NONE, media.LZW, media.PACKBITS, media.ADOBE_DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    rng = random.Random(5)
    pages = [bytes(rng.choice([rng.randrange(256), 65, 65]) for _ in range(64 * n)) for n in (1, 3, 200)]
    got = list(media.read_pages(media.write_tiff(pages, compression=compression, predictor=predictor, strip_rows=7)))
    assert [p.samples for p in got] == pages and [p.page for p in got] == [0, 1, 2]


@pytest.mark.parametrize("style", sorted(set(media.STYLES)))
def test_tiff_styles_and_pages(style):
    """Strips and tiles, packed and predicted in each way; pages longer than PAGE_ROWS go on in the next directory."""
    rng = random.Random(6)
    payload = bytes(rng.choice([rng.randrange(256), 65, 66]) for _ in range(64 * (media.PAGE_ROWS + 130)))
    for data in (payload, payload[: 64 * 3]):
        got = list(media.read_pages(media.write_tiff([data], compression=style[0], predictor=style[1], tiled=style[2])))
        assert b"".join(p.samples for p in got) == data and len(got) == -(-len(data) // (64 * media.PAGE_ROWS))
        assert {p.compression for p in got} == {style[0]}


def test_texts_go_through_all_styles(spark, sf):
    """The query's files hold every compression, both predictors, strips and tiles, and several pages; one row a page, and one a file."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    stored = media.store_texts(docs)
    pages = media.decode_pages(stored, ["doc_id"]).collect()
    assert {r["compression"] for r in pages} == {media.NONE, media.LZW, media.PACKBITS, media.ADOBE_DEFLATE, media.DEFLATE}
    assert max(r["page"] for r in pages) > 0 and not any(r["error"] for r in pages)
    texts = {r["doc_id"]: media.payload_of(r["text"])[1] for r in docs.collect()}
    whole = {}
    for r in sorted(pages, key=lambda r: (r["doc_id"], r["page"])):
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + r["samples"]
    assert whole == texts
    digests = {r["doc_id"]: (r["payload_sha256"], r["pages"]) for r in media.decode_files(stored, ["doc_id"]).collect()}
    assert digests == {i: (hashlib.sha256(p).hexdigest(), -(-len(p) // (64 * media.PAGE_ROWS))) for i, p in texts.items()}


def test_lzw_fills_its_table():
    data = bytes(random.Random(1).randrange(256) for _ in range(30000)) + b"ab" * 9000
    assert media.lzw_decode(media.lzw_encode(data)) == data and media.unpack_bits(media.pack_bits(data)) == data


def test_tiled_big_endian_tiff():
    import struct

    tiles = [bytes([k]) * 256 for k in range(4)]  # 2 x 2 tiles of 16 x 16 over 20 x 18 samples
    body = b"".join(tiles)
    entries = [(256, 3, 1, 20 << 16), (257, 3, 1, 18 << 16), (258, 3, 1, 8 << 16), (259, 3, 1, 1 << 16), (322, 3, 1, 16 << 16), (323, 3, 1, 16 << 16), (324, 4, 4, 8 + 1024), (325, 4, 4, 8 + 1024 + 16)]
    lists = struct.pack(">4I", *[8 + 256 * k for k in range(4)]) + struct.pack(">4I", *[256] * 4)
    start = 8 + len(body) + len(lists)
    data = struct.pack(">2sHI", b"MM", 42, start) + body + lists + struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries) + bytes(4)
    (page,) = media.read_pages(data)
    assert page.samples[0] == 0 and page.samples[19] == 1 and page.samples[17 * 20] == 2 and page.samples[-1] == 3


def test_media_digest(docs, hard, spark):
    for r in media.media_digest(hard).collect():
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= 64
    text = "héllo"
    r = media.media_digest(docs([(1, text)])).first()
    payload = text.encode() + bytes(58)
    assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (6, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))
    broken = spark.createDataFrame([(1, b"II*\0junk"), (2, None)], "doc_id long, media binary")
    assert [r["error"] is not None for r in media.decode_pages(broken, ["doc_id"]).collect()] == [True]


PIECES = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "1", "23", "é", "ß", "!", " ", "日", "\U0001f600", " the", "<|endoftext|>", "\t"]


def test_tree_encoding_equals_the_library():
    encoding = bpe.tokenizer(bpe.public_tokenizers.path(bpe.RANKS))
    rng = random.Random(9)
    for leaf in (1, 2, 7, 64):
        tree = bpe.TreeEncoder(encoding, leaf)
        for _ in range(400):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(80)))
            ids = tree.encode(text)
            assert ids == encoding.encode_ordinary(text), text
            assert bpe.decode_tree(encoding, ids, 2) == text.encode()


def test_encode_and_decode_frames(hard):
    encoded = bpe.encode_texts(hard)
    back = {(r["doc_id"], bytes(r["text"]).decode()) for r in bpe.decode_ids(encoded).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in hard.collect()}
    for r in bpe.round_trip(hard, keep=("doc_id", "text")).collect():
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
