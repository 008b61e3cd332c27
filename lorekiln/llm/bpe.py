"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved down to leaves, which are encoded by themselves; two neighbours are joined by encoding
anew a window around their border, which grows until the tokens outside it are proven stable.  Decoding
concatenates up the same tree.

The proof.  Call a place *safe* if a space follows a character that is no white space.  No match of the
splitting pattern holds white space after anything else but white space, so a match ends at every safe
place, whatever surrounds it; what the matcher sees of a match that ends there lies inside the text up to
that space, and matches after it depend on the text after it alone.  Merges stay inside matches.  So the
tokens left of a safe place in the left half, and those right of one in the right half, are what the
joined text has.  A window that ends in two such places settles all between; a half without one is taken
whole, which costs its length once on each level, n log n in all.  The proof holds for
``public_tokenizers.PATTERN``; ``SAFE`` goes with that pattern, and another one needs a rule of its own.

Cases: null and empty texts have no tokens.  Special tokens' strings are ordinary text.  Rows are
encoded one by one, so repeated and very long rows need no care.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from .common import map_columns

RANKS = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 2048
SAFE = re.compile(r"(?<=\S) ")
#: Characters by which a window's two sides grow at first; then they double.
WINDOW = 32


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file, once in a process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def last_safe(text: str) -> int:
    """The last safe place of a text, found in a growing window from its end; 0 if there is none."""
    size = WINDOW
    while True:
        start = max(0, len(text) - size)
        found = [m.start() for m in SAFE.finditer(text, start)]
        if found or not start:
            return found[-1] if found else 0
        size *= 2


def first_safe(text: str) -> int:
    """The first safe place of a text, found in a growing window from its start; its length if there is none."""
    size = WINDOW
    while True:
        m = SAFE.search(text, 0, size)
        if m or size >= len(text):
            return m.start() if m else len(text)
        size *= 2


class TreeEncoder:
    """Encodes by halves; ``leaf`` gives the tokens of a short text and ``lengths`` the bytes of each token."""

    def __init__(self, encoding: tiktoken.Encoding, leaf_chars: int = LEAF_CHARS):
        self.leaf = encoding.encode_ordinary
        self.bytes: dict[int, int] = {}
        self.encoding, self.leaf_chars = encoding, leaf_chars

    def _count(self, tokens: list[int], n_bytes: int, from_end: bool) -> int:
        """How many tokens at one end make up so many bytes."""
        known, k = self.bytes, 0
        while n_bytes > 0:
            t = tokens[-1 - k] if from_end else tokens[k]
            if t not in known:
                known[t] = len(self.encoding.decode_single_token_bytes(t))
            n_bytes -= known[t]
            k += 1
        if n_bytes:
            raise AssertionError("a safe place isn't a border of tokens")
        return k

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        start, stop = last_safe(left), first_safe(right)
        outer, inner = left[start:], right[:stop]
        drop_a = len(a) if not start else self._count(a, len(outer.encode()), True)
        drop_b = len(b) if stop == len(right) else self._count(b, len(inner.encode()), False)
        window = self.leaf(outer + inner)
        return a[: len(a) - drop_a] + window + b[drop_b:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))


def decode_tree(encoding: tiktoken.Encoding, tokens: list[int], leaf: int = 4096) -> bytes:
    if len(tokens) <= leaf:
        return encoding.decode_bytes(tokens)
    half = len(tokens) // 2
    return decode_tree(encoding, tokens[:half], leaf) + decode_tree(encoding, tokens[half:], leaf)


def _encoder(path: str | None) -> tuple[tiktoken.Encoding, Callable[[str], list[int]]]:
    encoding = tokenizer(path or public_tokenizers.path(RANKS))
    return encoding, TreeEncoder(encoding).encode


def encode_texts(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ids: the tokens of each text.  ``path``: a rank file each executor has; the installed one by default."""

    def make() -> Callable[..., list[list]]:
        _, encode = _encoder(path)
        return lambda *c: [*c[:-1], [encode(t or "") for t in c[-1]]]

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep)
    return map_columns(docs.select(*keep, "text"), make, f"{schema}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and text: the ids put together again, as bytes."""

    def make() -> Callable[..., list[list]]:
        encoding = tokenizer(path or public_tokenizers.path(RANKS))
        return lambda *c: [*c[:-1], [decode_tree(encoding, ids or []) for ids in c[-1]]]

    schema = ", ".join(f"`{c}` {dict(encoded.dtypes)[c]}" for c in keep)
    return map_columns(encoded.select(*keep, "ids"), make, f"{schema}, text binary")


def round_trip(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256 and on request ids: both operators on each text, in one pass."""

    def make() -> Callable[..., list[list]]:
        encoding, encode = _encoder(path)
        name = [str(i) for i in range(encoding.n_vocab)]

        def digest(*columns: list) -> list[list]:
            every = [encode(t or "") for t in columns[-1]]
            out = [
                *columns[:-1],
                [len(x) for x in every],
                [hashlib.sha256(",".join([name[i] for i in x]).encode()).hexdigest() for x in every],
                [hashlib.sha256(decode_tree(encoding, x)).hexdigest() for x in every],
            ]
            return [*out, every] if with_ids else out

        return digest

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep)
    return map_columns(docs.select(*keep, "text"), make, schema + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
