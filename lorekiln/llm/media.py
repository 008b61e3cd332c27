"""Media columns: TIFF files as binary columns, decoded to one row per page.

The reader walks the chain of image directories, decodes strips and tiles that are stored plainly or
packed by PackBits, LZW or deflate, undoes horizontal prediction, and gives a page's samples.  The
writer makes grey 8-bit pages of PAGE_ROWS rows, in strips or tiles, packed and predicted in one of STYLES,
which a hash of the samples chooses unless the caller does: equal texts have equal files, and a collection
goes through all of them.  Files are written to the shared folder and read back from there.  Everything
works on one file at a time, strip by strip; no shuffle is needed.

Cases: null or empty media give no page; a broken file gives one row with ``error`` set and no
samples, after those of the pages before the fault; so do a predictor other than none or horizontal, and
a page that claims more than ``MAX_PAGE_BYTES``, before any memory is taken for it.  A strip is never
unpacked beyond the bytes that its rows need.  Null text counts as empty, whose payload is 64 zero bytes.
Repeated rows are read anew, an empty table gives no rows, a very long text is a file of many pages.
Extra columns named in ``keep`` pass through, others are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns, materialize

WIDTH = 64
#: Bytes of samples up to which a page is decoded.
MAX_PAGE_BYTES = 1 << 30
STRIP_ROWS = 64
#: Rows of a page; what is longer goes on in the next one.
PAGE_ROWS = 256
#: Columns and rows of a tile.
TILE = (32, 64)
NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
#: (compression, predictor, tiled): what the hash of a file's samples chooses from; deflate, the fastest, most often.
STYLES = [
    (NONE, 1, False), (PACKBITS, 1, False), (PACKBITS, 1, True), (LZW, 1, False), (LZW, 2, False), (LZW, 2, True),
    (ADOBE_DEFLATE, 2, False), (ADOBE_DEFLATE, 2, True), (DEFLATE, 1, True), *[(ADOBE_DEFLATE, 1, False)] * 4, *[(ADOBE_DEFLATE, 1, True)] * 3,
]
#: Bytes of each TIFF field type and the code with which ``struct`` reads it.
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and (most is None or len(out) < most):
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + head + 2]
            i += head + 2
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
            i += 2
    return bytes(out)


class _Bits:
    """Codes of TIFF's LZW, most significant bit first."""

    CLEAR, END = 256, 257

    @staticmethod
    def width(size: int) -> int:
        return 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12


def lzw_encode(data: bytes) -> bytes:
    out, acc, held = bytearray(), 0, 0
    codes = {bytes((i,)): i for i in range(256)}
    size = 258

    def put(code: int, width: int) -> None:
        nonlocal acc, held
        acc, held = acc << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    put(_Bits.CLEAR, 9)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word], _Bits.width(size))
        codes[longer] = size
        size += 1
        if size == 4094:
            put(_Bits.CLEAR, 12)
            codes, size = {bytes((k,)): k for k in range(256)}, 258
        word = data[i : i + 1]
    if word:
        put(codes[word], _Bits.width(size))
        size += 1
    put(_Bits.END, _Bits.width(size))
    if held:
        out.append(acc << 8 - held & 255)
    return bytes(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    out, acc, held, at, size = [], 0, 0, 0, 0
    words: list[bytes] = []
    last = b""
    while most is None or size < most:
        width = _Bits.width(len(words) + bool(last)) if words else 9
        while held < width and at < len(data):
            acc, held, at = acc << 8 | data[at], held + 8, at + 1
        if held < width:
            break
        held -= width
        code, acc = acc >> held, acc & (1 << held) - 1
        if code == _Bits.END:
            break
        if code == _Bits.CLEAR:
            words, last = [bytes((i,)) for i in range(256)] + [b"", b""], b""
            continue
        if code > len(words) or (code == len(words) and not last):
            raise ValueError("LZW code out of range")
        word = words[code] if code < len(words) else last + last[:1]
        if last:
            words.append(last + word[:1])
        out.append(word)
        size += len(word)
        last = word
    return b"".join(out)


def _unpacked(data: bytes, how: int, most: int) -> bytes:
    """A strip or tile unpacked, up to a little over ``most`` bytes."""
    if how == NONE:
        return data[:most]
    if how == PACKBITS:
        return unpack_bits(data, most)
    if how == LZW:
        return lzw_decode(data, most)
    if how in (ADOBE_DEFLATE, DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise ValueError(f"compression {how} is not supported")


@dataclass
class Page:
    page: int
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    samples: bytes


def _fields(data: bytes, at: int, end: str) -> tuple[dict[int, tuple], int]:
    (count,) = struct.unpack_from(end + "H", data, at)
    fields = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
        code = FIELD.get(kind)
        if code is None:
            continue
        size, where = struct.calcsize(code) * n, at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(end + "I", data, where)
        fields[tag] = struct.unpack_from(f"{end}{n}{code}", data, where)
    (following,) = struct.unpack_from(end + "I", data, at + 2 + 12 * count)
    return fields, following


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF file, in the order of its directories; chunky samples of 8 or 16 bits."""
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None or struct.unpack_from(end + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(end + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        tags, at = _fields(data, at, end)
        one = lambda tag, default=None, tags=tags: tags[tag][0] if tag in tags else default
        width, height, channels, bits = one(256), one(257), one(277, 1), one(258, 1)
        how, predictor = one(259, 1), one(317, 1)
        if bits not in (8, 16) or one(284, 1) != 1:
            raise ValueError("only chunky samples of 8 or 16 bits are supported")
        if predictor not in (1, 2):
            raise ValueError(f"predictor {predictor} is not supported")
        tiled = 322 in tags
        across, down = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
        if min(width, height, channels, across, down) < 1:
            raise ValueError("a page, strip or tile without samples")
        if max(width * height, across * down) * channels * bits // 8 > MAX_PAGE_BYTES:
            raise ValueError("the page claims too many samples")
        offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        kind = np.dtype(f"{end}u{bits // 8}")
        image = np.zeros((height, width, channels), kind)
        for k, (start, size) in enumerate(zip(offsets, sizes, strict=True)):
            top, left = (k // -(-width // across) * down, k % -(-width // across) * across) if tiled else (k * down, 0)
            rows = down if tiled else min(down, height - top)
            need = rows * across * channels
            block = np.frombuffer(_unpacked(data[start : start + size], how, need * kind.itemsize), kind, need).reshape(rows, across, channels)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=kind)
            image[top : top + rows, left : left + across] = block[: height - top, : width - left]
        yield Page(len(seen) - 1, width, height, channels, bits, how, image.tobytes())


def _predicted(block: np.ndarray, predictor: int) -> bytes:
    """Rows of samples, or with horizontal prediction their differences."""
    return (np.diff(block, axis=1, prepend=np.uint8(0)).astype(np.uint8) if predictor == 2 else np.ascontiguousarray(block)).tobytes()


def write_tiff(pages: list[bytes], width: int = WIDTH, compression: int | None = None, predictor: int | None = None, tiled: bool | None = None, strip_rows: int = STRIP_ROWS) -> bytes:
    """A little-endian TIFF of grey 8-bit pages, each a whole number of rows; longer ones than PAGE_ROWS are cut into several.

    What isn't given of compression, predictor and tiling is chosen by a hash of the samples.
    """
    style = STYLES[zlib.crc32(b"".join(pages)) % len(STYLES)]
    compression, predictor, tiled = (own if own is not None else chosen for own, chosen in zip((compression, predictor, tiled), style, strict=True))
    deflate = lambda b: zlib.compress(b, 1)
    pack = {NONE: bytes, LZW: lzw_encode, PACKBITS: pack_bits, ADOBE_DEFLATE: deflate, DEFLATE: deflate}[compression]
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    link = 4
    for payload in (p[at : at + PAGE_ROWS * width] for p in pages for at in range(0, len(p), PAGE_ROWS * width)):
        image = np.frombuffer(payload, np.uint8).reshape(-1, width)
        height = len(image)
        across, down = TILE if tiled else (width, strip_rows)
        parts = []
        for top in range(0, height, down):
            for left in range(0, width, across):
                block = image[top : top + down, left : left + across]
                if tiled:  # tiles are whole: what lies outside of the image is zero
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1])))
                parts.append(pack(_predicted(block, predictor)))
        places = []
        for part in parts:
            places.append(len(out))
            out += part
        out += b"\0" * (len(out) % 2)
        lists = []
        for values in (places, [len(part) for part in parts]):
            lists.append(values[0] if len(values) == 1 else len(out))
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        shape = [(322, 4, 1, across), (323, 4, 1, down), (324, 4, len(parts), lists[0]), (325, 4, len(parts), lists[1])] if tiled else [(273, 4, len(parts), lists[0]), (278, 4, 1, down), (279, 4, len(parts), lists[1])]
        entries = sorted([(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, compression), (262, 3, 1, 1), (277, 3, 1, 1), (317, 3, 1, predictor), *shape])
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The length of a text's UTF-8 and those bytes, filled with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def store_texts(docs: DataFrame, compression: int | None = None, predictor: int | None = None) -> DataFrame:
    """doc_id, n_bytes and media, written to the shared folder: each text as a TIFF, 64 samples wide."""

    def encode(ids: list, texts: list) -> list[list]:
        made = [payload_of(t) for t in texts]
        return [ids, [n for n, _ in made], [write_tiff([p], compression=compression, predictor=predictor) for _, p in made]]

    return materialize(map_columns(docs.select("doc_id", "text"), lambda: encode, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary"), "media")


class Features:
    """Mean, deviation and entropy of samples that come page by page, and their eight coarse shares."""

    def __init__(self):
        self.counts = np.zeros(256, np.int64)

    def add(self, samples: bytes) -> None:
        self.counts += np.bincount(np.frombuffer(samples, np.uint8), minlength=256)

    def told(self) -> str:
        counts, levels = self.counts, np.arange(256)
        n = max(1, int(counts.sum()))
        mean = float((counts * levels).sum()) / n
        spread = math.sqrt(max(0.0, float((counts * levels * levels).sum()) / n - mean * mean))
        p = counts[counts > 0] / n
        shares = ",".join(f"{x / n:.4f}" for x in counts.reshape(8, 32).sum(axis=1))
        return f"mean={mean:.4f};sd={spread:.4f};entropy={max(0.0, -float((p * np.log2(p)).sum())):.4f};shares={shares}"


def page_features(samples: bytes) -> str:
    of = Features()
    of.add(samples)
    return of.told()


#: What a file that can't be read may raise.
UNREADABLE = (ValueError, KeyError, IndexError, struct.error, zlib.error, TypeError, MemoryError)


def decode_pages(media: DataFrame, keep: list[str], with_samples: bool = True) -> DataFrame:
    """One row for each page of the files in column ``media``: ``keep``, the page's place and shape, digests, feature, samples."""
    own = "page int, width int, height int, channels int, bits int, compression int, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string"
    fields = T.StructType([media.schema[c] for c in keep] + T.StructType.fromDDL(own + ", samples binary" * with_samples).fields)

    def decode(*columns: list) -> list[list]:
        rows = []
        for *kept, data in zip(*columns, strict=True):
            if not data:
                continue
            stored = [len(data), hashlib.sha256(data).hexdigest()]
            try:
                for p in read_pages(data):
                    s = p.samples
                    row = [*kept, p.page, p.width, p.height, p.channels, p.bits, p.compression, *stored, len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-WIDTH:]), page_features(s), None]
                    rows.append(row + [s] * with_samples)
            except UNREADABLE as e:
                rows.append([*kept, *[None] * 6, *stored, *[None] * 4, f"{type(e).__name__}: {e}", *[None] * with_samples])
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in fields]

    return map_columns(media.select(*keep, "media"), lambda: decode, fields)


def decode_files(media: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each file in column ``media``: ``keep``, digests of the file and of all its pages' samples, in order, and their feature."""
    own = "pages int, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string"
    fields = T.StructType([media.schema[c] for c in keep] + T.StructType.fromDDL(own).fields)

    def decode(*columns: list) -> list[list]:
        rows = []
        for *kept, data in zip(*columns, strict=True):
            if not data:
                continue
            stored = [len(data), hashlib.sha256(data).hexdigest()]
            n, size, digest, tail, of = 0, 0, hashlib.sha256(), b"", Features()
            try:
                for p in read_pages(data):
                    n, size, tail = n + 1, size + len(p.samples), (tail + p.samples)[-WIDTH:] if len(p.samples) < WIDTH else p.samples[-WIDTH:]
                    digest.update(p.samples)
                    of.add(p.samples)
                rows.append([*kept, n, *stored, size, digest.hexdigest(), zlib.crc32(tail), of.told(), None])
            except UNREADABLE as e:
                rows.append([*kept, n, *stored, *[None] * 4, f"{type(e).__name__}: {e}"])
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in fields]

    return map_columns(media.select(*keep, "media"), lambda: decode, fields)


def media_digest(docs: DataFrame) -> DataFrame:
    files = decode_files(store_texts(docs), ["doc_id", "n_bytes"])
    return files.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages", "error")
