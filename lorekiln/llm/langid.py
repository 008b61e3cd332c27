"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text is its words, each between two spaces; a model gives each character and the closing space a
probability from the three characters before it.  A language's n-grams lie in an array sorted by 64-bit
hash, beside it their log probabilities and back-off weights.  The language of lowest cross-entropy per
character is chosen.  Rejection is calibrated: on texts kept out of the counts, the
quantile REJECT_QUANTILE of the cross-entropy under the right language is each language's limit.

The models are a classifier fitted on a bounded sample: about ``per_lang`` documents of each language,
those of smallest hash of their id, whole texts.  Every text is then scored whole.

Cases: null texts and those without a letter are ``und`` with score 0.  Documents of null language or
text are scored but not learned from.  Without any labelled row every text is ``und``.  Rows that
repeat a document are scored alike; ties go to the language first in order.  A very long text is scored
whole, word by word; an empty table gives no rows.  Extra columns are not read, whatever their names.

The models are sent to every executor: at most the grams of ``per_lang`` documents for each language.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_columns

ORDER = 4
PER_LANG = 1500
CALIBRATION = 5
REJECT_QUANTILE = 0.999
WORDS_HELD = 300_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Multiplier of the rolling hash.
_BASE = 0x100000001B3


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def gram_hashes(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the hash of the n-gram that ends at each predicted character (0: none so long), and that character's word."""
    text = " " + " ".join(words) + " "
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = code == 32
    start = np.maximum.accumulate(np.where(space, np.arange(len(code)), 0))
    # A closing space is predicted from its word; as an opening one it is context alone.
    begin = np.empty_like(start)
    begin[0], begin[1:] = 0, start[:-1]
    depth = np.arange(len(code)) - begin + 1
    grams, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, ORDER + 1):
        # The hash of codes i-n+1..i, characters nearest the end weighing least.
        power = np.uint64(pow(_BASE, n - 1, 1 << 64))
        h = h.copy()
        h[n - 1 :] += (code[: len(code) - n + 1] + np.uint64(1)) * power
        grams.append(np.where(depth >= n, mixed(h + np.uint64(n * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)), np.uint64(0))[1:])
    word = np.cumsum(space)[:-1] - 1
    return grams, word


@dataclass
class Models:
    """For each language its grams as sorted hashes, beside them their log probabilities (NaN: a context alone) and back-off weights.

    A gram takes space only in the languages that have it.
    """

    langs: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Natural log probabilities of whole words with their closing spaces, by language."""
        out = np.zeros((len(words), len(self.langs)))
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            grams, word = gram_hashes(part)
            # Grams recur: each is looked up once a language.
            unique = [np.unique(g, return_inverse=True) for g in grams]
            inside = [g != 0 for g in grams]
            for k in range(len(self.langs)):
                out[i : i + len(part), k] = np.bincount(word, self._chars(k, unique, inside), len(part))
        return out

    def _chars(self, k: int, unique: list[tuple[np.ndarray, np.ndarray]], inside: list[np.ndarray]) -> np.ndarray:
        """Each character's log probability in language ``k``, from short contexts to long: a known gram sets it, an unknown one pays its context's back-off."""
        keys, logp, backoff = self.grams[k], self.logp[k], self.backoff[k]
        total = np.full(len(unique[0][1]), self.floor[k], np.float32)
        pay = None
        for n, (grams, back) in enumerate(unique):
            at = np.searchsorted(keys, grams)
            at[at == len(keys)] = 0
            found = (keys[at] == grams) & (grams != 0)
            if n:
                # A context of the gram's length less one exists only inside the word.
                total += np.where(inside[n], np.roll(pay, 1), np.float32(0))
            known = np.where(found, logp[at], np.float32(np.nan))[back]
            total = np.where(np.isnan(known), total, known)
            pay = np.where(found, backoff[at], np.float32(0))[back]
        return total


def fit(counts: dict[str, list[dict[int, int]]], contexts: dict[int, int], shorter: dict[int, int], limits: dict[str, float]) -> Models:
    """Models from ``counts[lang][n - 1]``: gram -> count; contexts, shorter: gram -> the gram without its last, first character."""
    langs = sorted(counts)
    tables: tuple[list, list, list] = ([], [], [])
    floor = np.zeros(len(langs), np.float32)
    for k, lang in enumerate(langs):
        by_order = counts[lang]
        # Lower orders count the distinct characters before a gram; grams at a word's start keep their counts.
        used = []
        for n in range(1, ORDER + 1):
            if n == ORDER:
                used.append(by_order[n - 1])
                continue
            types: dict[int, int] = defaultdict(int)
            for g in by_order[n]:
                types[shorter[g]] += 1
            used.append({g: types.get(g) or c for g, c in by_order[n - 1].items()})
        last: dict[int, float] = {}
        logs: dict[int, float] = {}
        weights: dict[int, float] = {}
        for n, c in enumerate(used, 1):
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total: dict[int, int] = defaultdict(int)
            kinds: dict[int, int] = defaultdict(int)
            for g, v in c.items():
                total[contexts[g]] += v
                kinds[contexts[g]] += 1
            p = {}
            if n == 1:
                size = len(c) + 1
                for g, v in c.items():
                    p[g] = max(v - discount, 0) / total[0] + discount * kinds[0] / total[0] / size
                floor[k] = np.log(discount * kinds[0] / total[0] / size)
            else:
                for g, v in c.items():
                    x = contexts[g]
                    p[g] = max(v - discount, 0) / total[x] + discount * kinds[x] / total[x] * last[shorter[g]]
                for x, t in total.items():
                    weights[x] = np.log(discount * kinds[x] / t)
            last = p
            logs.update((g, np.log(v)) for g, v in p.items())
        keys = np.array(sorted(logs.keys() | weights.keys()), np.uint64)
        tables[0].append(keys)
        tables[1].append(np.array([logs.get(int(g), np.nan) for g in keys], np.float32))
        tables[2].append(np.array([weights.get(int(g), 0.0) for g in keys], np.float32))
    return Models(langs, *tables, floor, np.array([limits.get(x, np.inf) for x in langs]))


def _count_words(sample: DataFrame) -> dict[str, dict[str, int]]:
    """Word counts by language; counted on the executors."""

    def make() -> Callable[..., list[list]]:
        def run(langs: list, texts: list) -> list[list]:
            counts: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(langs, texts, strict=True):
                for w in words_of(text):
                    counts[lang, w] += 1
            return [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())]

        return run

    return map_columns(sample.select("lang", "text"), make, "lang string, word string, n long")


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Models | None:
    """Models from a bounded sample of the rows of known language that aren't held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_lang / n))])
    sample = known.select("doc_id", "lang", "text").where(draw < share[F.col("lang")])
    kept_out = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(CALIBRATION)) == 0
    words = _count_words(sample.where(~kept_out)).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, list[dict[int, int]]] = {lang: [defaultdict(int) for _ in range(ORDER)] for lang in sizes}
    contexts: dict[int, int] = {}
    shorter: dict[int, int] = {}
    # Grams are counted on the executors as well: a row for each language and gram comes back.
    for lang, n, gram, context, rest, count in _count_grams(words).toLocalIterator():
        counts[lang][n - 1][gram & 0xFFFFFFFFFFFFFFFF] = count
        contexts[gram & 0xFFFFFFFFFFFFFFFF] = context & 0xFFFFFFFFFFFFFFFF
        shorter[gram & 0xFFFFFFFFFFFFFFFF] = rest & 0xFFFFFFFFFFFFFFFF
    counts = {k: v for k, v in counts.items() if v[0]}
    if not counts:
        return None
    models = fit(counts, contexts, shorter, {})
    held = identify(sample.where(kept_out), models, ("doc_id", "lang")).where("lang = best").groupBy("lang")
    limits = {r["lang"]: r["q"] for r in held.agg(F.percentile("entropy", REJECT_QUANTILE).alias("q")).collect()}
    models.limits = np.array([limits.get(x, np.inf) for x in models.langs])
    return models


def _count_grams(words: DataFrame) -> DataFrame:
    signed = lambda x: x.view(np.int64)

    def make() -> Callable[..., list[list]]:
        def run(langs: list, words_: list, ns: list) -> list[list]:
            out: list[list] = [[] for _ in range(6)]
            langs_, n_ = np.array(langs, object), np.array(ns, np.int64)
            for lang in sorted(set(langs)):
                at = np.flatnonzero(langs_ == lang)
                grams, word = gram_hashes([words_[i] for i in at])
                weight = n_[at][word]
                for n in range(ORDER):
                    g = grams[n]
                    real = np.flatnonzero(g)
                    unique, first, back = np.unique(g[real], return_index=True, return_inverse=True)
                    i = real[first]
                    # The space that opens a word hashes like the one that closed the word before it; before the first, index -1 is one.
                    context = grams[n - 1][i - 1] if n else np.zeros(len(i), np.uint64)
                    rest = grams[n - 1][i] if n else np.zeros(len(i), np.uint64)
                    values = [[lang] * len(i), [n + 1] * len(i), signed(unique).tolist(), signed(context).tolist(), signed(rest).tolist(), np.bincount(back, weight[real]).astype(int).tolist()]
                    for column, v in zip(out, values, strict=True):
                        column.extend(v)
            return out

        return run

    rows = map_columns(words.select("lang", "word", "n"), make, "lang string, n int, gram long, context long, rest long, count long")
    return rows.groupBy("lang", "n", "gram").agg(F.first("context"), F.first("rest"), F.sum("count"))


def identify(docs: DataFrame, models: Models | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, best (the likeliest language, ``und`` without letters), score, entropy and rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def make() -> Callable[..., list[list]]:
        m = shared.value
        held: dict[str, int] = {}
        table = np.empty((0, len(m.langs) if m else 0))

        def run(*columns: list) -> list[list]:
            nonlocal table
            texts = columns[-1]
            if m is None:
                return [*columns[:-1], [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)]
            if len(held) > WORDS_HELD:
                held.clear()
                table = table[:0]
            every = [words_of(t) for t in texts]
            new = list({w for words in every for w in words} - held.keys())
            if new:
                table = np.concatenate([table, m.log_probs(new)])
                held.update(zip(new, range(len(held), len(held) + len(new)), strict=True))
            out: list[list] = [[], [], [], []]
            for text, words in zip(texts, every, strict=True):
                if not words or not has_letter(text):
                    values = (UNKNOWN, 0.0, None, True)
                else:
                    at = np.fromiter(map(held.__getitem__, words), np.int64, len(words))
                    chars = sum(map(len, words)) + len(words)
                    entropy = -table[at].sum(axis=0) / chars
                    k = int(np.argmin(entropy))
                    odds = np.exp(np.clip((entropy[k] - entropy) * min(chars, 200), -60, 0))
                    values = (m.langs[k], float(1 / odds.sum()), float(entropy[k]), bool(entropy[k] > m.limits[k]))
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            return [*columns[:-1], *out]

        return run

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep)
    return map_columns(docs.select(*keep, "text"), make, f"{schema}, best string, score double, entropy double, rejected boolean")
