"""WARC archives compressed record by record with Zstandard, and their reader.

An archive starts with a skippable frame that holds the dictionary, itself a Zstandard frame or plain;
each record follows as one frame.  The reader loads that dictionary, decodes one frame per record, and
validates version line, needed headers, the length and the digests.

Archives travel as rows (archive, content): Parquet in the shared folder on the way from writer to
reader, or whatever ``spark.read.format("binaryFile")`` finds, see ``open_archives``.

Cases: null html is an empty payload.  Rows equal in page_id and payload are all what the first of
them is.  A page without id revisits the smallest id of its payload; a payload whose pages all have a
null id is a response throughout.  A very long page is one record and one frame, in an archive of its
own where it exceeds the archive's size.  An empty table writes no archive.  A broken record raises with
its number, or with ``errors="rows"`` gives a row with the fault, after which reading goes on at the next
frame that holds a whole record; other archives and records are read all the same.  Header names are read whatever their case, folded lines as one.  Extra columns are
not written, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, materialize, packed, pieces, spread_join

SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 16 << 10
SAMPLES = 200
VERSION = b"WARC/1.1"
#: The headers that are read, by their names in lower case: names are the same whatever their case.
NAMES = {n.lower(): n for n in ("WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length", "WARC-Target-URI", "WARC-Refers-To", "WARC-Payload-Digest", "WARC-Profile", "X-Payload-Length")}
NEEDED = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry a fixed date: reruns write the same bytes.
DATE = "2000-01-01T00:00:00Z"


class BrokenArchive(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, revisits: int | None) -> bytes:
    """A response, or a revisit of page ``revisits``, which holds no payload but its digest and length."""
    clean = "".join(c for c in url or "" if c > " ")
    headers = {"WARC-Type": "response" if revisits is None else "revisit", "WARC-Record-ID": f"<urn:x-page:{page_id}>", "WARC-Date": DATE}
    headers |= {"WARC-Target-URI": clean} if clean else {}
    headers["WARC-Payload-Digest"] = f"sha1:{digest_of(payload)}"
    headers["X-Payload-Length"] = str(len(payload))
    if revisits is not None:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:x-page:{revisits}>"}
    block = payload if revisits is None else b""
    headers["Content-Length"] = str(len(block))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items())
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def write_archive(records: list[bytes]) -> bytes:
    """One archive; its dictionary is trained on the records' beginnings where there are enough of them."""
    content, compress = b"", zstandard.ZstdCompressor(level=3)
    samples = [r[:4096] for r in records[:SAMPLES]]
    if len(samples) >= 16 and sum(map(len, samples)) > 4 * DICT_BYTES:
        try:
            trained = zstandard.train_dictionary(DICT_BYTES, samples)
        except zstandard.ZstdError:  # too uniform to train on
            trained = None
        if trained:
            packed = zstandard.ZstdCompressor().compress(trained.as_bytes())
            content, compress = struct.pack("<II", SKIPPABLE, len(packed)) + packed, zstandard.ZstdCompressor(level=3, dict_data=trained)
    return content + b"".join(compress.compress(r) for r in records)


def parse_record(data: bytes) -> Record:
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not found or first.split(b"/")[0] != b"WARC" or first not in (b"WARC/1.0", VERSION):
        raise BrokenArchive("no WARC version line")
    headers, last = {}, None
    for line in lines:
        text = line.decode("utf-8", "surrogateescape")
        if text[:1] in (" ", "\t") and last:  # a folded line goes on with the header before it
            headers[last] = f"{headers[last]} {text.strip()}".strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise BrokenArchive(f"not a header: {name[:60]}")
        last = NAMES.get(name.strip().lower(), name.strip())
        headers[last] = value.strip()
    if missing := [n for n in NEEDED if n not in headers]:
        raise BrokenArchive(f"no {', '.join(missing)}")
    length = headers["Content-Length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BrokenArchive("Content-Length and the block differ")
    payload, said = rest[:-4], headers.get("WARC-Payload-Digest", "")
    if headers["WARC-Type"] == "response" and said.startswith("sha1:") and said[5:] != digest_of(payload):
        raise BrokenArchive("the payload has another digest")
    return Record(headers, payload)


def _frame(reader: zstandard.ZstdDecompressor, view: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the frame that begins at a place, and where it ends."""
    frame = reader.decompressobj()
    parts, step = [], 1 << 16
    while not frame.eof:
        piece = view[at : at + step]
        if not piece:
            raise BrokenArchive("a frame is cut off")
        parts.append(frame.decompress(piece))
        at += len(piece)
    return b"".join(parts), at - len(frame.unused_data)


def _dictionary(content: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, if there is one, and where the records begin."""
    if len(content) < 8 or struct.unpack_from("<I", content)[0] != SKIPPABLE:
        return None, 0
    (size,) = struct.unpack_from("<I", content, 4)
    raw = content[8 : 8 + size]
    if len(raw) != size:
        raise BrokenArchive("the dictionary is cut off")
    try:
        return zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw), 8 + size
    except zstandard.ZstdError as e:
        raise BrokenArchive(f"the dictionary: {e}") from e


def read_archive(content: bytes, errors: str = "raise") -> Iterator[Record | BrokenArchive]:
    """The records of an archive, one Zstandard frame each.

    With ``errors="rows"`` a broken record comes as the exception that tells of it, once for each broken stretch:
    reading goes on at the next frame's magic number behind which a whole record is found.
    """
    if errors not in ("raise", "rows"):
        raise ValueError("errors: raise or rows")
    try:
        trained, at = _dictionary(content)
    except BrokenArchive as e:
        if errors == "raise":
            raise
        yield e
        return
    view = memoryview(content)
    reader = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    number, lost = 0, False
    while at < len(content):
        number += not lost
        try:
            data, after = _frame(reader, view, at)
            record = parse_record(data)
        except (zstandard.ZstdError, BrokenArchive) as e:
            fault = BrokenArchive(f"record {number}: {e}")
            if errors == "raise":
                raise fault from e
            if not lost:
                yield fault
            lost, at = True, content.find(ZSTD_MAGIC, at + 1)
            if at < 0:
                return
            continue
        number, lost, at = number + lost, False, after
        yield record


def html_of(row: str) -> Column:
    return F.coalesce(f"{row}.html", F.lit("")).cast("binary")


def assign_revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``pages`` with first: the smallest page_id of an equal payload, null where the row itself is to be a response.

    Digests are combined before the shuffle, and only payloads seen twice are joined back; a payload
    that holds a third of all pages is joined by broadcast, since few payloads can.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    keyed = packed(pages, "page_id").withColumn("key", F.when(F.octet_length(html_of("row")) >= min_payload, F.sha1(html_of("row"))))
    groups = pages.select("page_id", F.when(F.octet_length(html) >= min_payload, F.sha1(html)).alias("key")).where("key is not null")
    groups = groups.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = spread_join(keyed, materialize(groups, "payloads"), ["key"], "n", ["first"])
    own = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    columns = [F.col(f"row.`{c}`").alias(c) for c in pages.columns if c != "first"]
    return joined.select(*columns, F.when(own, F.col("first")).alias("first"))


def write_archives(pages: DataFrame, min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows (archive, content) in the shared folder: a partition's pages in archives of about ``archive_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            content = write_archive(held)
            return pa.RecordBatch.from_pydict({"archive": [f"{hashlib.sha1(content).hexdigest()}.warc.zst"], "content": pa.array([content], pa.binary())})

        for part in (p for b in batches for p in pieces(b)):
            for page_id, url, html, first in zip(*[c.to_pylist() for c in part.columns], strict=True):
                held.append(record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), first))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    rows = assign_revisits(pages.select("page_id", "url", "html"), min_payload)
    return materialize(rows.mapInArrow(run, "archive string, content binary"), "archives")


def open_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives lying as files in any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def read_records(archives: DataFrame, with_payload: bool = True, errors: str = "raise") -> DataFrame:
    """A row for each record: archive, record_id, record_type, target_uri, refers_to_id, payload_bytes, payload_digest, payload.

    With ``errors="rows"`` also a row for each broken stretch, whose ``error`` names record and fault; it is null elsewhere.
    """

    def make() -> Callable[..., list[list]]:
        def values(name: str, r: Record | BrokenArchive) -> list:
            if isinstance(r, BrokenArchive):
                return [name, *[None] * (6 + with_payload), str(r)]
            h = r.headers
            length = int(h["X-Payload-Length"]) if h["WARC-Type"] == "revisit" and h.get("X-Payload-Length", "").isdigit() else len(r.payload)
            digest = h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or digest_of(r.payload)
            return [name, h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Target-URI"), h.get("WARC-Refers-To"), length, digest, *[r.payload] * with_payload, None]

        def read(names: list, contents: list) -> list[list]:
            rows = [values(name, r) for name, content in zip(names, contents, strict=True) for r in read_archive(content or b"", errors)]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(8 + with_payload)]

        return read

    schema = "archive string, record_id string, record_type string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    found = map_columns(archives.select("archive", "content"), make, f"{schema}, error string", rows=1)
    return found if errors == "rows" else found.drop("error")


def archive_round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back."""
    records = read_records(write_archives(pages, min_payload), with_payload=False)
    number = lambda c: F.regexp_extract(c, r"<urn:x-page:(-?\d+)>", 1).try_cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))
