"""Toxicity scores from a learned lexicon, matched with misspellings and weighed by context.

The lexicon is learned from labelled rows: words whose presence in toxic texts beats chance by a
log-likelihood ratio, counted over texts of which near copies with the same label count once (near by the
MinHash values of their shingles), and beginnings of words where several words that share one do so
together better than each.  Its terms form a trie;
Levenshtein automata of the terms' tolerances are intersected with it, state by state and lazily made
deterministic, so that a word costs a table lookup for each character until it can no longer match.
Digits and signs that stand for letters match those letters at no cost.  A word that lies near a term
without being a misspelling of it is exempt, word by word: one that the labelled sample doesn't show as
toxic, or one that many texts of the whole collection use, counted over all documents, unless the sample
shows it as it shows a term.  Whole terms keep their edits; beginnings lose theirs where what they reach
beside such words is no sign of toxicity.

A hit's evidence of quotation: the text's quotation marks, paired over the whole text, enclose it, and a
window of words around it holds verbs of saying or naming.  A hit counts as abuse by what that leaves, as quotation by the rest.  A
logistic model over the two masses, exact and misspelt, gives the score.

Lexicon and model are a classifier fitted on a bounded sample of labelled rows: about ``per_label`` rows
of each label, those of smallest hash of their id, whole texts.  Every text is then scored whole.

Cases: null and empty texts score like texts without a hit.  Labels that are null, or whose doc_id has
no document, teach nothing; repeated labels of a document count as toxic if any is.  Without labels of
both kinds every score is 0.  Rows that repeat a document are scored alike.  A very long text is scored
whole.  An empty table gives no rows.  Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_columns, materialize, release
from .minhash import Signer, WordHashes, shingle_set

#: Score from which a text is rejected.
REJECT_FROM = 0.3
PER_LABEL = 4000
MAX_TERMS = 3000
#: How much oftener toxic texts must use a form for it to tell something.
LIFT = 3.0
#: A form near a term is a word in its own right where so many texts use it, and this share of the texts that use the term.
OWN_TEXTS, OWN_SHARE = 3, 0.05
#: The least weight of misspelt hits, of the exact ones' weight.
MISSPELT = 0.7
WINDOW = 6
FEATURES = 5
#: Near copies: MinHash values of a text's shingles, values that make a bucket, and the equal values asked for.
SHINGLE_WORDS, VALUES, BUCKET_VALUES, EQUAL_VALUES = 3, 64, 4, 38
#: Lengths of word beginnings that may become terms for all words that begin so, written with a final STEM.
STEMS = (4, 5)
STEM = "~"
TOKEN = re.compile(r"\w+(?:[@$*]\w+)*")
QUOTES = re.compile("[\"“”„‟«»‹›]")
#: The marks that may close what a mark opens.
CLOSES = {'"': '"', "“": "”", "”": "”", "„": "“”", "‟": "”", "«": "»", "»": "«»", "‹": "›", "›": "‹›"}
#: Signs written for letters; * stands for any letter.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
WILD = "*"
#: Words that report or name another's words, in four languages.
REPORTING = frozenset(
    "said says wrote writes called calls calling quoted quote word term phrase slur insult reported according "
    "sagte sagt schrieb nannte zitierte zitat wort begriff laut "
    "dit disait écrit appelé cité mot terme selon "
    "dijo dice escribió llamó citó palabra término según".split()
)


def tolerance(term: str) -> int:
    """Edits allowed for a term: short ones must be met exactly, long ones may differ in two, beginnings in one."""
    return 1 if term.endswith(STEM) else 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """The terms' trie intersected with their Levenshtein automata, made deterministic state by state.

    A state is a set of (trie node, edits so far); transitions are kept once made.  Characters outside
    the terms' alphabet and the look-alikes behave alike and share one transition.
    """

    DEAD = -1

    def __init__(self, terms: list[str], limits: dict[str, int] | None = None):
        self.tolerance = {t: min(tolerance(t), (limits or {}).get(t, 9)) for t in terms}.__getitem__
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.budget: list[int] = [0]
        self.stem: dict[int, str] = {}
        for t in terms:
            node = 0
            for c in t.removesuffix(STEM):
                self.budget[node] = max(self.budget[node], self.tolerance(t))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.budget.append(0)
                node = self.children[node][c]
            self.budget[node] = max(self.budget[node], self.tolerance(t))
            if t.endswith(STEM):
                self.stem[node] = t
            else:
                self.term[node] = t
        self.alphabet = {c for node in self.children for c in node} | set(LOOKALIKES) | {WILD}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.match: list[tuple[str, int] | None] = []
        self.begun: list[tuple[str, int] | None] = []
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, at: dict[int, int]) -> dict[int, int]:
        """With the characters of terms that may be missing: an edit each."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and e + 1 < at.get(child, 99):
                    at[child] = e + 1
                    todo.append((child, e + 1))
        return at

    def _state(self, at: dict[int, int]) -> int:
        if not at:
            return self.DEAD
        key = tuple(sorted(at.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            ends = [(e, self.term[node]) for node, e in key if self.term[node] and e <= self.tolerance(self.term[node])]
            self.match.append(min(ends)[::-1] if ends else None)
            stems = [(e, self.stem[node]) for node, e in key if node in self.stem and e <= self.tolerance(self.stem[node])]
            self.begun.append(min(stems)[::-1] if stems else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        to: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.budget[node] and e < to.get(node, 99):
                to[node] = e

        alike = LOOKALIKES.get(c, "")
        for node, e in self.states[state]:
            put(node, e + 1)
            for letter, child in self.children[node].items():
                put(child, e if letter == c or letter in alike or c == WILD else e + 1)
        return self._state(self._closed(to))

    def lookup(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its tolerance, and the edits; of equally near ones a whole term, then the first beginning."""
        state, following, alphabet, begun = self.start, self.next, self.alphabet, self.begun
        best: tuple[str, int] | None = None
        for c in word:
            known = following[state]
            to = known.get(c)
            if to is None:
                sign = c if c in alphabet else "\0"
                to = known.get(sign)
                if to is None:
                    to = known[sign] = self._step(state, sign)
            if to < 0:
                return best
            state = to
            stem = begun[state]
            if stem and (best is None or stem[1] < best[1]):
                # An edited beginning stands for longer words alone.
                if not stem[1] or len(word) >= len(stem[0]):
                    best = stem
        whole = self.match[state]
        return whole if whole and (best is None or whole[1] <= best[1]) else best


@dataclass
class Lexicon:
    """terms, the words near one that tell nothing, and the edits of terms that have fewer than their length allows."""

    terms: list[str]
    harmless: frozenset[str] = frozenset()
    limits: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    trie: FuzzyTrie | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"trie": None}

    def hits(self, text: str | None) -> tuple[int, list[tuple[str, str, int, float, int, int]]]:
        """The number of words; (word, term, edits, quotation 0 to 1, start, end) of each match."""
        if not text:
            return 0, []
        if self.trie is None:
            self.trie = FuzzyTrie(self.terms, self.limits)
        lookup = self.trie.lookup
        lower = text.lower()
        words = TOKEN.findall(lower)
        found = {w: m for w in set(words) if w not in self.harmless and (m := lookup(w))}
        if not found:
            return len(words), []
        if len(lower) != len(text):  # lower-casing changed lengths: spans refer to the lower-cased text
            text = lower
        spans = [m.span() for m in TOKEN.finditer(lower)]
        quoted = quoted_spans(text)
        return len(words), [(w, *found[w], quotation(quoted, spans, words, i), *spans[i]) for i, w in enumerate(words) if w in found]


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Where the text's quotations begin and end, its marks paired once from the start; marks without a partner count for nothing.

    A mark with white space on its outer side alone opens, on its inner side alone closes; else it may do either.
    """
    spans: list[tuple[int, int]] = []
    opened: list[tuple[str, int]] = []
    for m in QUOTES.finditer(text):
        c, i = m.group(), m.start()
        outer = i == 0 or text[i - 1].isspace() or text[i - 1] in "([{"
        inner = i + 1 == len(text) or text[i + 1].isspace() or text[i + 1] in ".,;:!?)]}"
        k = next((k for k in range(len(opened) - 1, -1, -1) if c in CLOSES[opened[k][0]]), None)
        if k is not None and not (outer and not inner):
            spans.append((opened[k][1], i))
            del opened[k:]
        elif not (inner and not outer):
            if k is not None:  # a second opening mark: the first had no partner
                del opened[k:]
            opened.append((c, i))
    return spans


def quotation(quoted: list[tuple[int, int]], spans: list[tuple[int, int]], words: list[str], i: int) -> float:
    """How far word ``i`` is quoted: within a quotation of the text, near verbs of saying."""
    first, last = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
    marks = any(a < spans[i][0] and spans[i][1] <= b for a, b in quoted)
    said = any(w in REPORTING for w in words[first:i]) or any(w in REPORTING for w in words[i + 1 : last + 1])
    return min(1.0, 0.6 * marks + 0.4 * said)


def features(n_words: int, hits: list[tuple]) -> np.ndarray:
    exact = sum(1 - h[3] for h in hits if not h[2])
    near = sum(1 - h[3] for h in hits if h[2])
    quoted = sum(h[3] for h in hits)
    return np.array([1.0, math.log1p(exact), math.log1p(near), math.log1p(quoted), math.sqrt((exact + near) / max(1, n_words))])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; abuse never lowers a score."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([w[:1], np.maximum(w[1:], 0)])


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, toxic) of about ``per_label`` rows of each label, and the share of rows taken by label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    shares = {k: min(1.0, per_label / n) for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    taken = known.where(draw < F.when(F.col("toxic") == 1, F.lit(shares.get(1, 0.0))).otherwise(F.lit(shares.get(0, 0.0))))
    # Twice per_label ids at most, give or take the draw's deviation: a bounded broadcast.
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(taken), "doc_id"), shares


def _text_key(text: str, toxic: int) -> int:
    """A hash of text and label that fits a signed column."""
    return xxhash.xxh3_64_intdigest(text, seed=toxic) >> 1


def _near_copies(signed: dict[int, tuple[int, bytes]]) -> dict[int, int]:
    """Text key -> cluster, from text key -> label and signature: near copies that share a label are one cluster.

    Within a bucket a text is compared with those not yet reached from the ones before it, so that a large
    group of copies costs few comparisons and texts that only share a bucket stay apart.
    """
    keys = sorted(signed)
    labels = np.array([signed[k][0] for k in keys])
    values = np.frombuffer(b"".join(signed[k][1] for k in keys), "<u2").reshape(len(keys), VALUES)
    parent = list(range(len(keys)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for at in range(0, VALUES, BUCKET_VALUES):
        buckets: dict[tuple, list[int]] = defaultdict(list)
        for i, part in enumerate(values[:, at : at + BUCKET_VALUES]):
            buckets[(labels[i], part.tobytes())].append(i)
        for members in buckets.values():
            left = np.array(members)
            reached: list[int] = []
            while len(left) + len(reached) > 1:
                if reached:
                    i = reached.pop()
                else:
                    i, left = int(left[0]), left[1:]
                near = (values[left] == values[i]).sum(axis=1) >= EQUAL_VALUES
                for j in left[near].tolist():
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
                    reached.append(j)
                left = left[~near]
                if not len(left):
                    break
    return {k: root(i) for i, k in enumerate(keys)}


def _clusters(sample: DataFrame) -> tuple[dict[int, int], int]:
    """Text key -> cluster of the sample's texts that have words, and how many clusters are toxic."""

    def make() -> Callable[..., list[list]]:
        hashes, signer = WordHashes(), Signer(VALUES)

        def run(texts: list, toxic: list) -> list[list]:
            out: list[list] = [[], [], []]
            for text, label in zip(texts, toxic, strict=True):
                if any(len(w) > 2 for w in TOKEN.findall(text.lower())):
                    for column, v in zip(out, (_text_key(text, label), label, signer.sign(shingle_set(text, SHINGLE_WORDS, hashes))), strict=True):
                        column.append(v)
            return out

        return run

    rows = map_columns(sample.select("text", "toxic"), make, "key long, toxic int, sig binary").collect()
    signed = {r["key"]: (r["toxic"], bytes(r["sig"])) for r in rows}
    cluster_of = _near_copies(signed)
    return cluster_of, len({c for k, c in cluster_of.items() if signed[k][0]})


def _own_words(docs: DataFrame, terms: list[str]) -> frozenset[str]:
    """The forms near a term that are words in their own right: used by OWN_TEXTS texts of all documents or more, and by OWN_SHARE of
    the texts that use the term.  Equal texts count once.  Shares of the term's own use decide, so that the number of
    such forms follows the lexicon, not the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon(terms))

    def make() -> Callable[..., list[list]]:
        own = shared.value

        def run(texts: list) -> list[list]:
            out: list[list] = [[], [], [], []]
            for text in texts:
                key = None
                for form, term, edits in {h[:3] for h in own.hits(text)[1]}:
                    key = _text_key(text, 0) if key is None else key
                    for column, v in zip(out, (form, term, edits, key), strict=True):
                        column.append(v)
            return out

        return run

    used = materialize(map_columns(docs.select("text"), make, "form string, term string, edits int, key long").distinct(), "used")
    by_term = used.where("edits = 0").groupBy("term").agg(F.count_distinct("key").alias("of_term"))  # as many rows as terms
    forms = used.where("edits > 0").groupBy("form", "term").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(by_term), "term", "left")
    own = forms.where(F.col("n") >= F.greatest(F.lit(OWN_TEXTS), OWN_SHARE * F.coalesce("of_term", F.lit(0)))).select("form").collect()
    release(used)
    return frozenset(r["form"] for r in own)


def _least_share(share: float) -> float:
    """The share of toxic texts among those of a word from which it may be a term."""
    return min(0.9, max(0.5, 2 * share))


def _exempt(rows: list[tuple], own: frozenset[str]) -> tuple[frozenset[str], dict[str, int]]:
    """The forms near a term that tell nothing of toxicity, and by beginning the edits that remain where they are limited.

    Forms are counted over the sample's texts, near copies once; quoted hits tell nothing, and one text alone never
    decides.  A form tells of toxicity where toxic texts use it LIFT times as often, for their number, as others do;
    a word in its own right (``own``) where so large a share of its texts is toxic as is asked of terms.  A beginning
    loses its edit if the uses of what it reaches beside exempt forms tell nothing; whole terms keep their edits.
    """
    texts: tuple[set, set] = (set(), set())
    forms: dict = defaultdict(lambda: (set(), set()))
    reached: dict = defaultdict(set)
    for _, toxic, cluster, _, hits in rows:
        texts[toxic].add(cluster)
        for w, term, edits, quoted in hits:
            if edits and quoted < 0.5:
                forms[w][toxic].add(cluster)
                if term.endswith(STEM):
                    reached[term, edits].add(w)
    often = LIFT * len(texts[1]) / max(1, len(texts[0]))
    least = _least_share(len(texts[1]) / max(1, len(texts[0]) + len(texts[1])))
    tells = {w for w, (clean, toxic) in forms.items() if len(toxic) > 1 and len(toxic) > least * (len(clean) + len(toxic))}
    harmless = {w for w, (clean, toxic) in forms.items() if len(clean) > 1 and len(toxic) <= often * len(clean)} | (own - tells)
    limits: dict[str, int] = {}
    for (term, edits), words in sorted(reached.items(), key=lambda x: -x[0][1]):  # the fewest edits last
        clean, toxic = (sum(len(forms[w][k]) for w in words - harmless) for k in (0, 1))
        if clean > 1 and toxic <= often * clean:
            limits[term] = edits - 1
    return frozenset(harmless), limits


def _terms(sample: DataFrame, max_terms: int) -> tuple[list[str], dict[int, int]]:
    """The lexicon's terms, and the clusters by text key."""
    cluster_of, toxic_clusters = _clusters(sample)
    total = len(set(cluster_of.values()))
    if not toxic_clusters or toxic_clusters == total:
        return [], cluster_of
    share = toxic_clusters / total

    def make() -> Callable[..., list[list]]:
        def run(texts: list, toxic: list) -> list[list]:
            out: list[list] = [[], [], []]
            for text, label in zip(texts, toxic, strict=True):
                words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
                stems = {w[:n] + STEM for w in words for n in STEMS if len(w) > n}
                if words:
                    cluster = cluster_of[_text_key(text, label)]
                    for column, v in zip(out, ([*words, *stems], [cluster] * (len(words) + len(stems)), [label] * (len(words) + len(stems))), strict=True):
                        column.extend(v)
            return out

        return run

    rows = map_columns(sample.select("text", "toxic"), make, "word string, cluster long, toxic int")
    clusters = rows.groupBy("word", "cluster").agg(F.max("toxic").alias("toxic"))
    words = clusters.groupBy("word").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    # Over-representation against the share of toxic texts, near copies joined: a binomial log-likelihood ratio, under a bound for all words tried.
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    ratio = 2 * (part(p, n * share) + part(n - p, n * (1 - share)))
    scored = words.select("word", "p", "n", ratio.alias("g")).where(p / n > _least_share(share))
    tried = max(1, words.count())
    best = scored.where(F.col("g") > 2 * math.log(tried)).orderBy(F.desc("g"), "word").limit(max_terms)
    gain = {r["word"]: r["g"] for r in best.collect()}
    # A beginning is a term where it explains more than any one word or shorter beginning; the words it covers stay terms with their tolerance.
    chosen: list[str] = []
    for stem in sorted((w for w in gain if w.endswith(STEM)), key=len):
        covered = [g for w, g in gain.items() if w != stem and w.startswith(stem[:-1])]
        if not any(stem.startswith(c[:-1]) for c in chosen) and gain[stem] > 1.2 * max(covered, default=0.0):
            chosen.append(stem)
    return sorted([w for w in gain if not w.endswith(STEM)] + chosen), cluster_of


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_terms: int = MAX_TERMS) -> Lexicon:
    sample, shares = _sample(docs, labels, per_label)
    terms, cluster_of = _terms(sample, max_terms)
    if len(shares) < 2 or not terms:
        return Lexicon([])
    lexicon = Lexicon(terms)

    def make() -> Callable[..., list[list]]:
        def run(ids: list, texts: list, toxic: list) -> list[list]:
            every = [lexicon.hits(t) for t in texts]
            keys = [_text_key(t, label) for t, label in zip(texts, toxic, strict=True)]
            return [ids, toxic, keys, [n for n, _ in every], [["\t".join(map(str, h[:4])) for h in hits] for _, hits in every]]

        return run

    kind = dict(sample.dtypes)["doc_id"]
    seen = map_columns(sample.select("doc_id", "text", "toxic"), make, f"doc_id {kind}, toxic int, key long, n long, hits array<string>").collect()
    # For the weights each half of the sample is judged by what the other tells is harmless; the lexicon's exemptions come from all of it.
    parsed = [
        (r["doc_id"], r["toxic"], cluster_of.get(r["key"]), r["n"], [(w, t, int(e), float(q)) for w, t, e, q in (h.split("\t") for h in r["hits"])])
        for r in seen
    ]
    own = _own_words(docs, terms)
    half = lambda i: xxhash.xxh3_64_intdigest(str(i)) % 2
    told = [_exempt([r for r in parsed if half(r[0]) == k], own) for k in (0, 1)]

    def counted(i: object, hits: list[tuple]) -> list[tuple]:
        harmless, limits = told[1 - half(i)]
        return [h for h in hits if not h[2] or (h[0] not in harmless and h[2] <= limits.get(h[1], 9))]

    x = np.array([features(n, counted(i, hits)) for i, _, _, n, hits in parsed])
    y = np.array([float(t) for _, t, _, _, _ in parsed])
    weight = np.array([1 / shares[int(t)] for t in y])
    # Kinds of hits that the sample hardly holds keep an order: misspelt ones weigh most of an exact one, quoted ones little.
    weights = logistic(x, y, weight / weight.mean())
    weights[2] = max(weights[2], MISSPELT * weights[1])
    weights[3] = min(weights[3], 0.15 * weights[1])
    return Lexicon(terms, *_exempt(parsed, own), weights)


def score(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",), with_spans: bool = False) -> DataFrame:
    """``keep``, score, n_hits, and with ``with_spans`` each hit's word, term, edits, quotation and place in the text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    learned = bool(lexicon.terms)

    def make() -> Callable[..., list[list]]:
        own = shared.value

        def run(*columns: list) -> list[list]:
            every = [own.hits(t) for t in columns[-1]]
            z = [float(features(n, hits) @ own.weights) for n, hits in every]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) if learned else 0.0 for v in z]
            out = [*columns[:-1], scores, [len(hits) for _, hits in every]]
            return [*out, [[dict(zip(("word", "term", "edits", "quotation", "start", "end"), h, strict=True)) for h in hits] for _, hits in every]] if with_spans else out

        return run

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep) + ", score double, n_hits int"
    spans = ", hits array<struct<word: string, term: string, edits: int, quotation: double, start: int, end: int>>"
    return map_columns(docs.select(*keep, F.col("text").alias("_scored")), make, schema + spans * with_spans)
