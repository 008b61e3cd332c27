"""Text cleaning, splitting, entity names and lenient JSON, as Column expressions wherever those can say it."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.proxy import Model, over
from ..plans.registry import query

# Elements whose text is dropped, boilerplate phrases, leftovers of markup with what replaces them.
DROPPED = ("script", "style", "nav", "footer", "header", "aside")
BOILERPLATE = [r"Click here to subscribe.*", r"Sign up for our newsletter.*", r"Advertisement\s*", r"ADVERTISEMENT\s*", r"Read more:.*", r"Related articles?:.*", r"Share on (Facebook|Twitter|LinkedIn).*", r"©\s*\d{4}.*All rights reserved.*", r"This story was originally published.*", r"Contact the author at.*", r"\[.*?(Photo|Image|Video).*?\]"]
MARKUP = [(r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]+>", " ")]
LEFTOVERS = [(r'\b(class|style|id|href|src|alt|rel|target|width|height)="[^"]*"', " "), (r"\b(class|style|id|href|src|alt|rel|target|width|height)=\S+", " "), (r"(?i)\b(noreferrer|noopener|nofollow|relnoreferrer|styleheight)\b", " "), (r"(?i)classwp\w+", " "), (r"hrefhttp\S+", " "), (r"\d+tdtda", " "), (r"probationli", " "), (r"\bpthe\b", "the"), (r"\bpq\b", " "), (r"div\b", " "), (r"figcaption", " ")]
TITLES = ["mayor", "governor", "senator", "representative", "president", "vice president", "congressman", "congresswoman", "judge", "justice", "sheriff", "chief", "commissioner", "secretary", "mr", "mrs", "ms", "dr", "prof", "professor"]
NER_LABELS = {"PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "DATE": "DATE", "TIME": "DATE", "EVENT": "EVENT", "LAW": "LAW", "PRODUCT": "PRODUCT", "NORP": "ORGANIZATION"}
HTML_HINTS = ["href", "class", "style", "rel", "alt", "src", "div", "span", "img", "fig", "wp", "block", "attachment", "noreferrer", "noopener", "nofollow", "blockquote", "figcaption", "probationli", "classwp", "styleheight", "tdtda", "hrefhttp", "pthe", "pq"]
STOP_WORDS = ["the", "a", "an", "this", "that", "these", "those", "it", "its", "he", "she", "they", "them", "their", "his", "her", "our", "your", "and", "or", "but", "if", "when", "where", "who", "what", "which", "article", "story", "report", "news", "according", "including", "vermont", "vt", "like", "new", "just", "now", "well", "good", "best", "better"]
#: The five named character references that SQL can undo; others need the Python form.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in DROPPED

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in DROPPED and self.depth > 0

    def handle_data(self, data: str) -> None:
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def visible_text(document: str | None) -> str:
    """The text outside dropped elements, pieces joined by spaces."""
    parser = _Visible()
    parser.feed(document or "")
    parser.close()
    return " ".join(parser.parts)


@F.pandas_udf(T.StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    return s.map(visible_text)


#: What Python's html.unescape takes for a character reference.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _characters(references: pd.Series) -> pd.Series:
    return references.map(lambda refs: refs if refs is None else [html_lib.unescape(r) for r in refs])


def unescape(c: Column) -> Column:
    """All character references undone.  Python sees the references only, so that its memory doesn't follow the documents' sizes."""
    signs = _characters(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)))
    return F.array_join(F.zip_with(F.split(c, REFERENCE, -1), signs, lambda rest, sign: F.concat(rest, F.coalesce(sign, F.lit("")))), "")


@query("t01_html_to_text")
def t01(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", html_to_text("html").alias("text"))


def replaced(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def clean_html(c: Column, undo: Callable[[Column], Column] | None = None) -> Column:
    """Tags, attributes and known artefacts removed; character references undone by ``undo`` (such as ``unescape``, for
    all of them, through Python) or, by built-in functions, the five named ones."""
    c = replaced(c, MARKUP)
    if undo is not None:
        c = undo(c)
    else:
        for name, sign in ENTITIES:
            c = F.replace(c, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(replaced(c, LEFTOVERS), r"\s+", " "))


def _sql_replaced(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        flags = "g"
        if pattern.startswith("(?"):
            head, pattern = pattern[2:].split(")", 1)
            flags += head
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', '{flags}')"
    return column


def _sql_entities(column: str) -> str:
    for name, sign in ENTITIES:
        column = f"replace({column}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return column


_ASCII = "regexp_replace(html, '[^\\x00-\\x7F]', '', 'g')"


@query("t02_clean_html", f"SELECT page_id, trim(regexp_replace({_sql_replaced(_sql_entities(_sql_replaced(_ASCII, MARKUP)), LEFTOVERS)}, '\\s+', ' ', 'g')) AS text FROM pages")
def t02(m: Model) -> DataFrame:
    ascii_only = F.regexp_replace("html", r"[^\x00-\x7F]", "")  # both dialects' classes agree on ASCII
    return m.table("pages").select("page_id", clean_html(ascii_only).alias("text"))


@query("t02b_clean_html_all_references")
def t02b(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", clean_html(F.col("html"), unescape).alias("text"))


def remove_boilerplate(c: Column) -> Column:
    return replaced(c, [("(?im)" + p, "") for p in BOILERPLATE])


@query("t03_boilerplate", f"SELECT doc_id, {_sql_replaced('t', [('(?im)' + p, '') for p in BOILERPLATE])} AS text FROM (SELECT doc_id, regexp_replace(text || chr(10) || 'Read more: ' || doc_id || chr(10) || '[A Photo ' || doc_id || ']', '[^\\x00-\\x7F]', '', 'g') AS t FROM documents)")
def t03(m: Model) -> DataFrame:
    marked = F.concat("text", F.lit("\nRead more: "), F.col("doc_id").cast("string"), F.lit("\n[A Photo "), F.col("doc_id").cast("string"), F.lit("]"))
    return m.table("documents").select("doc_id", remove_boilerplate(F.regexp_replace(marked, r"[^\x00-\x7F]", "")).alias("text"))


@query("t03b_boilerplate_copyright", f"SELECT doc_id, {_sql_replaced('t', [('(?im)' + p, '') for p in BOILERPLATE])} AS text FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') || chr(10) || '© 20' || doc_id || ' The Paper. ALL rights reserved' || chr(10) || 'last line ©' AS t FROM documents)")
def t03b(m: Model) -> DataFrame:
    # The one sign beyond ASCII that a pattern names is put in after the others are taken out.
    ending = F.concat(F.lit("\n© 20"), F.col("doc_id").cast("string"), F.lit(" The Paper. ALL rights reserved\nlast line ©"))
    marked = F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", ""), ending)
    return m.table("documents").select("doc_id", remove_boilerplate(marked).alias("text"))


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, " +", " "), r"\n\s*\n+", "\n\n")
    return F.trim(F.array_join(F.transform(F.split(c, "\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", "")), "\n"))


@query("t04_whitespace", "SELECT doc_id, sha256(trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\\n\\s*\\n+', chr(10) || chr(10), 'g'), chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), chr(10)))) AS digest FROM documents")
def t04(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", F.sha2(normalize_whitespace(F.col("text")), 256).alias("digest"))


#: Fixed value: a sentence ends after . ? or ! before white space, but not after initials (e.g.) or a short capitalised
#: abbreviation (Mr.); what follows need not be a capital.
SENTENCE_END = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s"
#: White space in Python's sense, and the same pattern where classes must be told to be Unicode's and a dot to be any character but a newline.
_WHITE = r"[\s\x1c-\x1f]"
_JVM_SENTENCE_END = r"(?U)(?<!\w\.\w[^\n])(?<![A-Z][a-z]\.)(?<=[.?!])" + _WHITE


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_WHITE}+|{_WHITE}+$", "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, _JVM_SENTENCE_END), stripped), lambda s: s != "")


@query("t05_sentences")
def t05(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_index", "sentence"))


@query("t06_paragraphs", "SELECT doc_id, CAST(pos - 1 AS INTEGER) AS paragraph_index, length(p) AS n FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS p, generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), 1) AS pos FROM documents) WHERE trim(p) <> ''")
def t06(m: Model) -> DataFrame:
    # Indices of empty paragraphs are left out, not closed up.
    doubled = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    parts = m.table("documents").select("doc_id", F.posexplode(F.split(doubled, "\n\n")).alias("paragraph_index", "p"))
    return parts.where("trim(p) <> ''").select("doc_id", "paragraph_index", F.char_length("p").cast("long").alias("n"))


def token_estimate(c: Column) -> Column:
    return F.floor(F.char_length(c) / 4).cast("int")


@query("t07_token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def t07(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


def chunks(texts: DataFrame, key: str, column: str, size: int = 200, overlap: int = 50) -> DataFrame:
    """Sentence-aligned chunks of about ``size`` tokens, each beginning with up to ``overlap`` tokens of the one before."""

    def one(text: str) -> list[tuple[int, str, int]]:
        out, held, tokens = [], [], 0
        for s in (x.strip() for x in re.split(SENTENCE_END, text or "")):
            if not s:
                continue
            if held and tokens + len(s) // 4 > size:
                out.append((len(out), " ".join(held), tokens))
                kept, tokens = [], 0
                for back in reversed(held):
                    if tokens + len(back) // 4 > overlap:
                        break
                    kept.insert(0, back)
                    tokens += len(back) // 4
                held = kept
            held.append(s)
            tokens += len(s) // 4
        return [*out, (len(out), " ".join(held), tokens)] if held else out

    def run(batches):
        for b in batches:
            rows = [(k, *c) for k, t in zip(b[key], b[column], strict=True) for c in one(t)]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "text", "token_estimate"])

    return texts.select(key, column).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, chunk_index int, text string, token_estimate int")


@query("t08_chunks")
def t08(m: Model) -> DataFrame:
    return chunks(m.table("documents"), "doc_id", "text")


def normalize_entity(name: Column, kind: Column) -> Column:
    """Persons lose titles, and City after another word; organisations a leading The."""
    words = F.filter(F.split(name, " "), lambda w: w != "")
    bare = lambda w: F.lower(F.regexp_replace(w, r"[.,]+$", ""))
    kept = F.filter(words, lambda w, i: ~bare(w).isin(TITLES) & ~((bare(w) == "city") & (i > 0)))
    organisation = F.when(F.lower(name).startswith("the "), F.trim(F.substring(name, 5, 1 << 20))).otherwise(name)
    return F.when(kind == "PERSON", F.array_join(kept, " ")).when(kind == "ORGANIZATION", organisation).otherwise(name)


_TITLE_LIST = ", ".join(f"'{t}'" for t in TITLES)


@query("t09_normalize_entity", f"SELECT c_custkey, array_to_string(list_filter(string_split(name, ' '), lambda w, i: NOT (lower(regexp_replace(w, '[.,]+$', '')) IN ({_TITLE_LIST})) AND NOT (lower(w) = 'city' AND i > 1)), ' ') AS person, c_name || ' Guild' AS organization FROM (SELECT c_custkey, 'Rutland City Mayor ' || c_name || ' Dr.' AS name, c_name FROM customer)")
def t09(m: Model) -> DataFrame:
    name = F.concat(F.lit("Rutland City Mayor "), "c_name", F.lit(" Dr."))
    return m.table("customer").select("c_custkey", normalize_entity(name, F.lit("PERSON")).alias("person"), normalize_entity(F.concat(F.when(F.col("c_custkey") % 2 == 0, "The ").otherwise(""), "c_name", F.lit(" Guild")), F.lit("ORGANIZATION")).alias("organization"))


def occurrences(text: Column, name: Column) -> Column:
    """Zero-based offsets of a name's occurrences in a text, whatever the case, without overlap."""
    parts = F.split(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(name), F.lit(r"\E")), -1)
    lengths = F.transform(parts, lambda p: F.char_length(p).cast("long"))
    step = F.char_length(name).cast("long")
    places = F.aggregate(
        F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0))),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("found")),
        lambda acc, n: F.struct((acc["at"] + n + step).alias("at"), F.concat(acc["found"], F.array(acc["at"] + n)).alias("found")),
    )
    return places["found"]


@query("t10_occurrences", "SELECT doc_id, (length(t) - length(replace(t, ' the ', ''))) // 5 AS n, strpos(t, ' the ') - 1 AS first FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE strpos(t, ' the ') > 0")
def t10(m: Model) -> DataFrame:
    found = m.table("documents").select("doc_id", occurrences(F.col("text"), F.lit(" the ")).alias("at")).where("size(at) > 0")
    return found.select("doc_id", F.size("at").cast("long").alias("n"), F.get("at", F.lit(0)).alias("first"))


def spans(c: Column) -> Column:
    """(start, end, text) of each sentence of a text: offsets of the stripped sentence, in order."""
    white = rf"(?U)^{_WHITE}+"
    # Each end takes one white character; what a part has at its ends lies outside its sentence.
    parts = F.transform(F.split(c, _JVM_SENTENCE_END, -1), lambda p: F.struct(F.char_length(p).alias("n"), F.char_length(F.regexp_replace(p, white, "")).alias("left"), stripped(p).alias("text")))
    placed = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("found")),
        lambda acc, p: F.struct(
            (acc["at"] + p["n"] + 1).alias("at"),
            F.concat(acc["found"], F.array(F.struct((acc["at"] + p["n"] - p["left"]).alias("start"), (acc["at"] + p["n"] - p["left"] + F.char_length(p["text"])).alias("end"), p["text"].alias("text")))).alias("found"),
        ),
    )
    return F.filter(placed["found"], lambda x: x["text"] != "")


def containing(places: Column, offset: Column) -> Column:
    """The index of the first of (start, end) intervals, in order, that holds an offset: start <= offset < end; null if none does."""
    hits = F.filter(F.sequence(F.lit(0), F.size(places) - 1), lambda i: (F.get(places, i)["start"] <= offset) & (offset < F.get(places, i)["end"]))
    return F.when(F.size(places) > 0, F.get(hits, F.lit(0)))


@query(
    "j13_interval_membership",
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
placed AS (SELECT doc_id, i, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start, length(line) AS n FROM lines),
found AS (SELECT doc_id, strpos(lower(text), ' the ') - 1 AS place FROM documents WHERE strpos(lower(text), ' the ') > 0)
SELECT f.doc_id, place, CAST(i AS INTEGER) AS line FROM found f LEFT JOIN placed p ON p.doc_id = f.doc_id AND start <= place AND place < start + n""",
)
def j13(m: Model) -> DataFrame:
    lines = F.split("text", "\n", -1)
    ends = F.aggregate(lines, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(x) + 1)))
    places = F.zip_with(lines, ends, lambda x, e: F.struct(e.alias("start"), (e + F.char_length(x)).alias("end")))
    found = m.table("documents").select("doc_id", occurrences(F.col("text"), F.lit(" the ")).alias("all"), F.slice(places, 1, F.size(lines)).alias("places")).where("size(all) > 0")
    return found.select("doc_id", F.get("all", F.lit(0)).alias("place"), containing(F.col("places"), F.get("all", F.lit(0))).alias("line"))


@query("t11_article_hash", over("articles", "SELECT id, sha256(url || '||' || title) AS article_hash FROM articles"))
def t11(m: Model) -> DataFrame:
    return m.articles.select("id", F.sha2(F.concat_ws("||", "url", "title"), 256).alias("article_hash"))


def mapped_label(c: Column) -> Column:
    pairs = [F.lit(x) for kv in NER_LABELS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], c)


@query("t12_ner_labels", "SELECT p_partkey, CASE label WHEN 'ORG' THEN 'ORGANIZATION' WHEN 'GPE' THEN 'LOCATION' WHEN 'TIME' THEN 'DATE' WHEN 'NORP' THEN 'ORGANIZATION' ELSE label END AS label FROM (SELECT p_partkey, list_extract(['ORG', 'GPE', 'TIME', 'NORP', 'PERSON', 'OTHER'], CAST(p_size % 6 + 1 AS INTEGER)) AS label FROM part)")
def t12(m: Model) -> DataFrame:
    raw = F.get(F.array(*[F.lit(x) for x in ("ORG", "GPE", "TIME", "NORP", "PERSON", "OTHER")]), (F.col("p_size") % 6).cast("int"))
    return m.table("part").select("p_partkey", mapped_label(raw).alias("label"))


@query("t13_source_names", over("articles", "SELECT id, coalesce(name, source) AS source FROM articles LEFT JOIN (VALUES ('1-URGENT', 'Urgent'), ('2-HIGH', 'High')) v(k, name) ON k = source"))
def t13(m: Model) -> DataFrame:
    return renamed_sources(m.articles, {"1-URGENT": "Urgent", "2-HIGH": "High"}).select("id", "source")


def renamed_sources(articles: DataFrame, names: dict[str, str]) -> DataFrame:
    """Feed titles by the given map; others stay."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return articles.withColumn("source", F.coalesce(pairs[F.col("source")], "source"))


def topic_label(keywords: Column) -> Column:
    """The first capitalised keyword, else the first phrase, else the first keyword, in title case."""
    proper = F.filter(keywords, lambda k: k.rlike(r"^\p{Lu}"))
    phrase = F.filter(keywords, lambda k: F.contains(k, F.lit("_")))
    chosen = F.coalesce(F.get(proper, F.lit(0)), F.get(phrase, F.lit(0)), F.get(keywords, F.lit(0)))
    return F.coalesce(F.initcap(F.replace(chosen, F.lit("_"), F.lit(" "))), F.lit("Miscellaneous"))


@query("t14_topic_label", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) WHEN 1 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') ELSE 'Miscellaneous' END AS label FROM part")
def t14(m: Model) -> DataFrame:
    phrase = F.replace("p_name", F.lit(" "), F.lit("_"))
    keywords = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("budget"), phrase, "p_type")).when(F.col("p_size") % 3 == 1, F.array(F.lit("budget"), phrase)).otherwise(F.array().cast("array<string>"))
    return m.table("part").select("p_partkey", topic_label(keywords).alias("label"))


@query("t15_canonical_pair", "SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem")
def t15(m: Model) -> DataFrame:
    return m.table("lineitem").select(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).distinct()


def meaningful(keyword: Column) -> Column:
    """Letters alone, three at least, no stop word, no hint of markup, lower or title case."""
    low = F.lower(keyword)
    shape = keyword.rlike(r"^\p{L}{3,}$") & ((keyword == low) | (keyword == F.initcap(low)))
    return shape & ~low.isin(STOP_WORDS) & ~low.rlike("|".join(HTML_HINTS))


@query("f26_meaningful_keywords", f"SELECT DISTINCT w AS keyword FROM (SELECT unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand || ' the Vermont Classic', ' ')) AS w FROM part) WHERE regexp_matches(w, '^[A-Za-z]{{3,}}$') AND (w = lower(w) OR w = upper(substr(w, 1, 1)) || lower(substr(w, 2))) AND lower(w) NOT IN ({', '.join(repr(s) for s in STOP_WORDS)}) AND NOT regexp_matches(lower(w), '{'|'.join(HTML_HINTS)}')")
def f26(m: Model) -> DataFrame:
    words = m.table("part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.lit("the Vermont Classic")), " ")).alias("keyword"))
    return words.where(meaningful(F.col("keyword"))).distinct()


def lenient_json(c: Column) -> Column:
    """The text itself, a fenced block's object, or what lies from the first { to the last }: the first that is JSON, as text."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull() & (x != ""), x)
    return F.coalesce(valid(c), valid(fenced), valid(braces))


@query("e01_lenient_json", "SELECT event_id, CAST(json_extract(CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END, '$.k') AS BIGINT) AS k FROM events")
def e01(m: Model) -> DataFrame:
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('Here:\n```json\n', props, '\n```') WHEN 2 THEN concat('so ', props, ' ok') ELSE 'none' END")
    return m.table("events").select("event_id", F.get_json_object(lenient_json(raw), "$.k").cast("long").alias("k"))


FACTS_SCHEMA = "extracted_facts array<struct<entity: string, type: string, confidence: double, event_description: string>>"


def valid_extraction(c: Column) -> Column:
    """Whether a reply holds facts of which none lacks one of the four keys."""
    facts = F.from_json(c, FACTS_SCHEMA)["extracted_facts"]
    complete = F.forall(facts, lambda f: f["entity"].isNotNull() & f["type"].isNotNull() & f["confidence"].isNotNull() & f["event_description"].isNotNull())
    return F.coalesce(complete, F.lit(False))


@query("e02_valid_extraction", "SELECT event_id, event_id % 3 = 0 AS valid FROM events")
def e02(m: Model) -> DataFrame:
    reply = F.expr("""CASE event_id % 3 WHEN 0 THEN concat('{"extracted_facts": [{"entity": "', event_type, '", "type": "EVENT", "confidence": 0.5, "event_description": "x"}]}') WHEN 1 THEN '{"extracted_facts": [{"entity": "a"}]}' ELSE '{"summary": "x"}' END""")
    return m.table("events").select("event_id", valid_extraction(reply).alias("valid"))


def claim(c: Column, prop: str, path: str) -> Column:
    """What the first statement of a property says at ``path`` of its value."""
    return F.get_json_object(c, f"$.claims.{prop}[0].mainsnak.datavalue.value{path}")


def claims(c: Column) -> dict[str, Column]:
    """Population (P1082), coordinates (P625) and class (P31) of an entity's JSON; null where a statement lacks its value."""
    lat, lon = claim(c, "P625", ".latitude").try_cast("double"), claim(c, "P625", ".longitude").try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    return {
        "population": claim(c, "P1082", ".amount").try_cast("double").cast("long"),
        "lat": F.when(both, lat),
        "lon": F.when(both, lon),
        "instance_of": claim(c, "P31", ".id"),
    }


@query(
    "e03_nested_claims",
    """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN k * 1000 END AS population, CASE WHEN event_id % 2 = 0 THEN k / CAST(4 AS DOUBLE) END AS lat,
  CASE WHEN event_id % 2 = 0 THEN -k / CAST(8 AS DOUBLE) END AS lon, CASE WHEN event_id % 5 <> 0 THEN 'Q' || k END AS instance_of
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def e03(m: Model) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    snak = lambda prop, value, there: F.when(there, F.concat(F.lit(f'"{prop}":[{{"mainsnak":{{"datavalue":{{"value":'), value, F.lit("}}}]")))
    amount = F.concat(F.lit('{"amount":"+'), k.cast("string"), F.lit('000"}'))
    place = F.concat(F.lit('{"latitude":'), (k / 4).cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"longitude":'), (-k / 8).cast("string"))).otherwise(""), F.lit("}"))
    kind = F.concat(F.lit('{"id":"Q'), k.cast("string"), F.lit('"}'))
    parts = F.concat_ws(",", snak("P1082", amount, F.col("event_id") % 3 != 0), snak("P625", place, F.lit(True)), snak("P31", kind, F.col("event_id") % 5 != 0))
    found = claims(F.concat(F.lit('{"claims":{'), parts, F.lit("}}")))
    return m.table("events").select("event_id", *[c.alias(n) for n, c in found.items()])


@query("e04_array_union", over("facts", "SELECT article_id, entity, array_to_string(list_sort(list_distinct(list_concat(source_models, ['X', 'A']))), ',') AS models FROM facts"))
def e04(m: Model) -> DataFrame:
    joined = F.array_union("source_models", F.array(F.lit("X"), F.lit("A")))
    return m.facts.select("article_id", "entity", F.array_join(F.array_sort(joined), ",").alias("models"))


@query("e05_slice_explode", "SELECT doc_id, unnest(string_split(text, ' ')[1:10]) AS word FROM documents")
def e05(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", F.explode(F.slice(F.split("text", " "), 1, 10)).alias("word"))


@query("d01_date_functions", over("articles", "SELECT id, date_trunc('month', published_date)::TIMESTAMP AS month, CAST(published_date AS DATE) AS day, CAST(epoch(collected_date) - epoch(published_date) AS BIGINT) AS seconds FROM articles"))
def d01(m: Model) -> DataFrame:
    seconds = F.unix_timestamp(F.col("collected_date").cast("timestamp")) - F.unix_timestamp(F.col("published_date").cast("timestamp"))
    return m.articles.select("id", F.date_trunc("month", "published_date").cast("timestamp_ntz").alias("month"), F.to_date("published_date").alias("day"), seconds.alias("seconds"))
