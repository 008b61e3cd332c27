"""Rules that reject articles of low news value, as regular expressions over title and summary.

Every rule is one boolean Column, so that a whole cascade is a single projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.proxy import Model
from ..plans.registry import query

# The patterns of each rule, over lower-cased text unless said otherwise.
REGION = [r"\bvermont\b", r"\bvt\b", r"\bvt\.", r"\bburlington\b", r"\bmontpelier\b", r"\brutland\b", r"\bbrattleboro\b", r"\bbarre\b", r"\bsouth burlington\b", r"\bcolchester\b", r"\bessex\b", r"\bwinooski\b", r"\bst\. albans\b", r"\bnewport\b", r"\bvergennes\b", r"\bnortheast kingdom\b", r"\bchamplain valley\b", r"\bgreen mountains\b", r"\bmad river valley\b", r"\bupper valley\b", r"\bchittenden county\b", r"\bwindham county\b", r"\bwindsor county\b", r"\bfranklin county\b", r"\brutland county\b", r"\borange county\b", r"\blake champlain\b", r"\bstowe\b", r"\bkillington\b", r"\bsugarbush\b", r"\bmarlboro\b", r"\bmiddlebury\b", r"\bbenning?ton\b", r"\bst\. johnsbury\b", r"\bwhite river junction\b", r"\bspringfield\b", r"\blyndon\b"]
OUTSIDE = [r"\bnh\b", r"\bnew hampshire\b", r"\bn\.h\.\b"]
OUTSIDE_CITIES = ["claremont", "lebanon", "hanover", "concord", "manchester", "nashua", "portsmouth", "keene", "laconia", "berlin", "plymouth", "littleton", "newport nh", "charlestown nh"]
INSIDE = r"\b(vermont|vt|burlington|montpelier)\b"
OBITUARY = [r"\bobituar(y|ies)\b", r"\bdeath notices?\b", r"\bin memoriam\b", r"\bpassed away\b", r"\bdied\b.*\b(age|years old)\b", r"\bservices? will be held\b", r"\bcelebration of life\b", r"\bmemorial service\b", r",\s*\d{2,3},?\s+\w+\s+native$"]
OBITUARY_TITLE = [r"^[A-Z][\w\s]+,\s*\d+,?\s+(of\s+|.*\s+native)", r",\s*\d{2,3}(\s|$)"]  # in the title's own case
NEWS_WORDS = ["court", "state", "town", "school", "police", "fire", "vote", "council", "board", "committee", "mayor", "governor", "senator", "arrest", "crash", "accident", "meeting", "election", "bill", "law", "budget", "tax", "company", "business", "report", "study"]
EVENT = [r"\bevent calendar\b", r"\bcommunity calendar\b", r"\bupcoming events?\b", r"\bthings to do\b", r"\bevents? this week(end)?\b", r"\bwhat\'?s happening\b", r"\bsave the date\b", r"\bmark your calendar\b", r"\bevent listings?\b", r"\bcommunity events?\b", r"\barts? & entertainment calendar\b", r"\bmust see,?\s*must do\b", r"\bopens\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"]
EVENT_TITLE = [r"\bevents?:?\s+(this|next|june|july|august|september|october|november|december|january|february|march|april|may|\d+)", r"\bhappening (this|next|on) (week(end)?|month|saturday|sunday|friday)\b"]
EVENT_DATE = r",?\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\.?\s+\d{1,2}\b"
EVENT_WORDS = ["dinner", "walk", "treat", "party", "festival", "fair", "concert", "show", "performance", "celebration", "gathering", "conversation", "meeting"]
REVIEW = [r"\breview:", r"\breviewed\b", r"\bmovie review\b", r"\bbook review\b", r"\balbum review\b", r"\brestaurant review\b", r"\bfood review\b", r"\bfilm review\b", r"\bconcert review\b", r"\btheater review\b", r"\bplay review\b", r"\bart review\b", r"\bmusic review\b", r"[★⭐]{2,5}", r"\b\d\s+stars?\b", r"\b\d/5\b", r"\b\d\.?\d?/10\b"]
SPORTS_WORDS = ["football", "basketball", "baseball", "hockey", "soccer", "game", "playoff", "championship", "tournament", "season", "score", "final", "overtime", "quarter", "inning", "period"]
SCORE = [r"\b\d+\s*-\s*\d+\b", r"\b\w+\s+\d+,\s+\w+\s+\d+\b", r"\bvs\.?\s+", r"\bbeats?\b", r"\bdefeats?\b", r"\btops\b", r"\bnips\b", r"\bslips\s+pass(ed)?\b"]
RECAP = [r"\bgame recap\b", r"\bgame notes?\b", r"\brecap:", r"\bscoreboard\b", r"\bgame summary\b", r"\bmatch report\b", r"\breel in\b.*\b(record|bass|fish)", r"\b(bass|trout|fishing|angling)\s+(record|tournament|competition)", r"\bhunting\s+season\b", r"\b(youth|unofficial)\s+angler\b"]
SPORTS_TITLE = r"\bin (girls?\'?|boys?\'?|mens?\'?|womens?\'?) (soccer|basketball|hockey|football|baseball|volleyball|lacrosse|tennis|track)\b"
CLASSIFIED = [r"\bfor sale\b", r"\bfor rent\b", r"\bhelp wanted\b", r"\bjob opening\b", r"\bnow hiring\b", r"\breal estate\b", r"\bclassifieds?\b", r"\blistings?\b", r"\bpublic notice\b", r"\blegal notice\b", r"\bbid request\b", r"\brfp\b"]
PRICE = r"\$[\d,]+(\.\d{2})?"
LISTING_WORDS = ["sale", "rent", "bed", "bath", "acre", "sqft"]
WEATHER = [r"\bweather forecast\b", r"\bforecast:", r"\bweather alert\b", r"\bweather warning\b", r"\bstorm watch\b", r"\bwinter storm\b", r"\bflood watch\b", r"\bsevere weather\b", r"\btoday\'?s weather\b", r"\bweather update\b", r"\b7-day forecast\b", r"\bextended forecast\b"]
WEATHER_TITLE = r"(high|low|temp|temperature)s?\s+(of|in)\s+\d+°?"
OPINION = [r"\bopinion:", r"\beditorial:", r"\bcolumn:", r"\bcommentary:", r"\bletter to the editor\b", r"\bletters to the editor\b", r"\bguest column\b", r"\bguest commentary\b", r"\bop-ed\b", r"\bmy view\b", r"\bpoint of view\b"]
OPINION_TITLE = [r"\btime to reclaim\b.*\bpractice\b.*\bgod\b", r"\bpeople are the sovereign power\b", r"\bcapturing the.*cruelty\b"]
HUMAN_INTEREST = [r"\bdream comes true\b", r"\bfollowing (his|her|their) dream\b", r"\bfriends enjoy\b", r"\bswim and run\b", r"\benjo(y|ying) .*\b(along|in|at)\b", r"\banswering the call\b", r"\b(heartwarming|inspiring|uplifting) (story|tale)\b"]
#: The feeds that also carry other regions' news, of whose articles the region's keywords are asked.
REGIONAL_FEEDS = ["https://www.boston.com/tag/vermont/feed/", "https://whdh.com/regional/vermont/feed/", "https://www.news10.com/news/vt-news/feed/", "https://www.mynbc5.com/topstories-rss", "https://www.mychamplainvalley.com/feed/"]
MIN_CHARS = 200


def any_of(patterns: list[str] | str) -> str:
    """One alternation, so that a text is searched once."""
    return patterns if isinstance(patterns, str) else "|".join(f"(?:{p})" for p in patterns)


def matches(c: Column, patterns: list[str] | str) -> Column:
    # (?U): word, digit and space classes are Unicode's, as in the rules' own dialect.
    return c.rlike("(?U)" + any_of(patterns))


def holds_any(c: Column, words: list[str]) -> Column:
    return matches(c, [w.replace(".", r"\.") for w in words])


def rules(title: Column, summary: Column, content: Column, min_chars: int = MIN_CHARS) -> dict[str, Column]:
    """Each rule as a boolean, in the order in which they are tried."""
    low_title = F.lower(title)
    text = F.lower(F.concat(title, F.lit(" "), F.coalesce(summary, F.lit(""))))
    words = F.filter(F.split(F.trim(title), r"(?U)\s+"), lambda w: w != "")
    name_like = F.size(words).between(2, 4) & F.forall(words, lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}"))
    some_text = F.coalesce(F.nullif(content, F.lit("")), F.nullif(summary, F.lit("")), F.lit(""))
    return {
        "out_of_region": matches(low_title, OUTSIDE) | (holds_any(low_title, OUTSIDE_CITIES) & ~matches(text, INSIDE)),
        "obituary": matches(text, OBITUARY) | matches(title, OBITUARY_TITLE) | (name_like & ~holds_any(low_title, NEWS_WORDS)),
        "event_listing": matches(text, EVENT) | matches(low_title, EVENT_TITLE) | (matches(low_title, EVENT_DATE) & holds_any(low_title, EVENT_WORDS)),
        "review": matches(text, REVIEW),
        "sports_game": (holds_any(text, SPORTS_WORDS) & matches(text, SCORE)) | matches(text, RECAP) | matches(low_title, SPORTS_TITLE),
        "classified_ad": matches(text, CLASSIFIED) | (matches(title, PRICE) & holds_any(low_title, LISTING_WORDS)),
        "weather_alert": matches(text, WEATHER) | matches(low_title, WEATHER_TITLE),
        "opinion_editorial": matches(text, OPINION) | matches(low_title, OPINION_TITLE),
        "human_interest_fluff": matches(text, HUMAN_INTEREST),
        "too_short": F.char_length(F.regexp_replace(some_text, r"(?U)^\s+|\s+$", "")) < min_chars,
    }


# Fixed values of the planned variant: what passes every rule but obituary and length, what is rejected first,
# where the region's token counts, and what makes climate and sports stories policy.
POLICY = [r"\b(bill|legislation|statute|law|act|resolution|amendment)\b", r"\b(legislature|senate|house|assembly|congress)\b", r"\b(committee|subcommittee|caucus)\b", r"\b(policy|regulation|ordinance|rule|directive)\b", r"\b(budget|appropriation|funding|grant|subsidy)\b", r"\b(governor|lieutenant governor|attorney general)\b", r"\b(mayor|selectboard|city council|town meeting)\b", r"\bclimate (policy|action|plan|legislation|bill)\b", r"\b(tax|taxation) (policy|reform|bill|proposal)\b", r"\b(zoning|land use|development) (policy|reform|ordinance)\b", r"\b(education|healthcare|housing|transportation) (policy|reform|bill)\b", r"\b(election|campaign|vote|referendum|ballot)\b", r"\b(hearing|testimony|debate|public comment)\b", r"\b(veto|override|passed|approved|rejected|signed into law)\b"]
BLACKLIST = [r"^(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\'?s? weather\b", r"^weather (for|on) (today|tonight|tomorrow|this weekend)\b", r"^(today|tonight|tomorrow)\'?s? (high|low|temperature)\b", r"^(this week|this weekend) in (sports|entertainment|arts)\b", r"^what\'?s (on|happening) (this|tonight|today)\b", r"^(follow|like|subscribe|share) (us|our|me)\b", r"^(comment|weigh in|let us know|tell us) (below|what you think)\b"]
OUTSIDE_CONTEXT = [r"\bnew hampshire\b", r"\bnh\s+(state|governor|legislature|senate|house)\b", r"\b(in|from|near)\s+nh\b", r"\bn\.h\.\b"]
CLIMATE_POLICY = [r"\bclimate (policy|action|plan|legislation|bill|law)\b", r"\bcarbon (tax|pricing|market|trading|credit)\b", r"\bemissions? (reduction|target|cap|trading)\b", r"\bgreenhouse gas (reduction|policy|regulation)\b", r"\brenewable energy (policy|mandate|standard)\b"]
SPORTS_POLICY = [r"\b(stadium|arena) (funding|budget|proposal|plan)\b", r"\bsports (betting|gambling|wagering) (bill|legislation|law)\b", r"\b(athletic|sports) (program|department) (budget|funding|grant)\b", r"\b(coach|athlete) (contract|salary) (approved|negotiated)\b"]


def planned_rules(title: Column, summary: Column, content: Column, min_chars: int = MIN_CHARS) -> dict[str, Column]:
    """``rules`` with the region read in context, and climate and sports policy exempt."""
    text = F.lower(F.concat(title, F.lit(" "), F.coalesce(summary, F.lit(""))))
    checked = rules(title, summary, content, min_chars)
    inside = matches(text, _INSIDE_WORD)
    checked["out_of_region"] = (matches(text, OUTSIDE_CONTEXT) | holds_any(text, OUTSIDE_CITIES)) & ~inside
    checked["weather_alert"] = checked["weather_alert"] & ~matches(text, CLIMATE_POLICY)
    checked["sports_game"] = checked["sports_game"] & ~matches(text, SPORTS_POLICY)
    return checked


def reject_reason(title: Column, summary: Column, content: Column, min_chars: int = MIN_CHARS, policy_whitelist: bool = False, blacklist: list[str] | None = None, in_context: bool = False) -> Column:
    """The first rule that rejects an article, or ``passed``; options turn on the planned whitelist and blacklist."""
    checked = (planned_rules if in_context else rules)(title, summary, content, min_chars)
    low = F.lower(title)
    reason = F.when(F.coalesce(title, F.lit("")) == "", "missing_title")
    if blacklist:
        reason = reason.when(matches(low, blacklist), "blacklisted")
    if policy_whitelist:
        reason = reason.when(checked["obituary"], "obituary").when(checked["too_short"], "too_short").when(matches(low, POLICY), "passed_policy_whitelist")
    for name, rule in checked.items():
        reason = reason.when(rule, name)
    return reason.otherwise("passed")


def needs_region(title: Column, summary: Column, content: Column) -> Column:
    """Whether region keywords occur in title, summary or the first 500 characters."""
    head = F.concat_ws(" ", title, F.coalesce(summary, F.lit("")), F.substring(F.coalesce(content, F.lit("")), 1, 500))
    return matches(F.lower(head), REGION)


def passes_gate(feed: Column, title: Column, summary: Column, content: Column) -> Column:
    """Whether an article passes the region gate: all of most feeds do, of the listed ones those that need the region's keywords and have them."""
    listed = F.coalesce(feed.isin(REGIONAL_FEEDS), F.lit(False))
    return F.when(listed, F.coalesce(needs_region(title, summary, content), F.lit(False))).otherwise(F.lit(True))


# Fixed values of the import: titles that are left out, tags that leave out or raise, signs of investigations,
# and the score's weights and bounds.
IMPORT_TITLES = [
    r"^obituar(y|ies):", r"\bobituar(y|ies)\b", r"in memoriam",
    r"^school notes?:", r"^dean\'?s list", r"^honor roll", r"^academic (honors?|achievements?)",
    r"^calendar:", r"^events?:", r"^listings?:", r"^week(ly|end) roundup", r"^community calendar", r"^upcoming events?", r"^what\'?s (on|happening)", r"^things to do",
    r"^public notices?", r"^legal notices?", r"^court notices?",
    r"construction report for the week", r"road (construction|work) (report|update)", r"^police (log|report|blotter)", r"^fire (log|report)",
    r"^briefs?:", r"^digest:", r"^quick hits", r"^in brief", r"^news (briefs?|digest)",
    r"^opinion:", r"^commentary:", r"^editorial:", r"^letter to", r"^letters to", r"^guest essay", r"^guest opinion", r"^viewpoint:", r"^my turn:", r"^reader (opinion|commentary)", r"^op-ed:",
    r"^review:", r"\b(book|movie|film|theater|restaurant|album|music|art) review\b", r"^restaurant review", r"^critic\'?s pick",
    r"^sponsored", r"^advertorial", r"^paid post", r"^partner content",
]
EXCLUDE_TAGS = ["routine", "obituary", "obituaries", "calendar", "events", "listings", "briefs", "digest", "public_notice", "legal_notice", "opinion", "editorial", "commentary", "letter_to_editor", "letters", "review", "reviews", "book_review", "restaurant_review", "movie_review", "music_review", "sponsored", "advertorial", "promotional", "school_notes", "honor_roll", "police_log", "fire_log"]
PRIORITY_TAGS = ["government policy", "state government", "federal_politics", "labor strike", "economic development", "legal", "court ruling", "legislation", "election", "controversy", "investigation", "breaking news", "environment", "climate", "public health", "education policy", "housing", "transportation policy"]
INVESTIGATIVE = [r"\binvestigat(e|ion|ing)\b", r"\breport finds\b", r"\bexclusive\b", r"\banalysis\b"]
BASE_SCORE, KEEP_SCORE = 50, 50
IMPORT_CHARS, IMPORT_WORDS = 800, 100


def import_score(title: Column, content: Column, tags: Column) -> Column:
    """0 for what is left out by title, tag, length or words; else 50, 10 for each priority tag, 15 or 10 for
    more than 3000 or 2000 characters, 15 for an investigation, less 10 for a title below 30 characters."""
    clean = F.array_distinct(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))))
    any_tag = lambda names: F.array(*[F.lit(t) for t in names])
    head, n = F.coalesce(title, F.lit("")), F.coalesce(F.char_length(content), F.lit(0))
    words = F.size(F.filter(F.split(F.coalesce(content, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    out = matches(F.lower(head), IMPORT_TITLES) | F.arrays_overlap(clean, any_tag(EXCLUDE_TAGS)) | (n < IMPORT_CHARS) | (words < IMPORT_WORDS)
    tagged = 10 * F.size(F.array_intersect(clean, any_tag(PRIORITY_TAGS)))
    length = F.when(n > 3000, 15).when(n > 2000, 10).otherwise(0)
    score = BASE_SCORE + tagged + length + F.when(matches(F.lower(head), INVESTIGATIVE), 15).otherwise(0) - F.when(F.char_length(head) < 30, 10).otherwise(0)
    return F.when(out, 0).otherwise(score)


# The queries try the rules on the texts at hand: phrases of the news rules put before the titles, the texts' whole first lines, by id.
_PHRASES = ["Obituary notice", "Things to do", "Book review: it", "Hockey game 3-2", "Now hiring", "Winter storm", "Editorial: we", "Dream comes true", "Nashua mayor", "School budget vote", "Monday weather in", "Montpelier council", "Follow us and", "Investigation: a Vermont"]
_EACH = 2 * len(_PHRASES)


def _titled(m: Model) -> DataFrame:
    phrases = F.array(*[F.lit(p) for p in _PHRASES])
    phrase = F.coalesce(F.get(phrases, F.pmod("id", F.lit(_EACH)).cast("int")), F.lit(""))
    return m.texts.withColumn("title", F.trim(F.concat(phrase, F.lit(" "), "title"))).withColumn("summary", F.lit(""))


_TITLED = f"t AS (SELECT doc_id AS id, text AS content, source, trim(coalesce(list_extract([{', '.join(map(repr, _PHRASES))}], CAST(doc_id % {_EACH} AS INTEGER) + 1), '') || ' ' || string_split(text, chr(10))[1]) AS title FROM documents)"
_SQL_TEXT = "lower(title || ' ')"
_HEAD = "lower(title || '  ' || substr(content, 1, 500))"
_NASHUA = r"\bnashua\b"
_INSIDE_WORD = r"\bvermont\b|\bvt\b"


def _sql_match(column: str, patterns: list[str] | str) -> str:
    # Both dialects' ASCII classes: word boundaries are spelt out where letters beyond ASCII may stand.
    escaped = any_of(patterns).replace("'", "''")
    return f"regexp_matches({column}, '{escaped}')"


def _rule_query(key: str, rule: str, sql: str) -> None:
    @query(key, f"WITH {_TITLED} SELECT id, {sql} AS matched FROM t")
    def run(m: Model, rule: str = rule) -> DataFrame:
        return _titled(m).select("id", rules(F.col("title"), F.col("summary"), F.col("content"))[rule].alias("matched"))


_rule_query("f08_out_of_region", "out_of_region", f"({_sql_match('lower(title)', OUTSIDE)} OR ({_sql_match('lower(title)', OUTSIDE_CITIES)} AND NOT {_sql_match(_SQL_TEXT, INSIDE)}))")
_rule_query("f10_event_listing", "event_listing", f"({_sql_match(_SQL_TEXT, EVENT)} OR {_sql_match('lower(title)', EVENT_TITLE)} OR ({_sql_match('lower(title)', EVENT_DATE)} AND {_sql_match('lower(title)', EVENT_WORDS)}))")
_rule_query("f11_review", "review", _sql_match(_SQL_TEXT, REVIEW))
_rule_query("f12_sports_game", "sports_game", f"(({_sql_match(_SQL_TEXT, SPORTS_WORDS)} AND {_sql_match(_SQL_TEXT, SCORE)}) OR {_sql_match(_SQL_TEXT, RECAP)} OR {_sql_match('lower(title)', SPORTS_TITLE)})")
_rule_query("f13_classified_ad", "classified_ad", f"({_sql_match(_SQL_TEXT, CLASSIFIED)} OR ({_sql_match('title', PRICE)} AND {_sql_match('lower(title)', LISTING_WORDS)}))")
_rule_query("f14_weather_alert", "weather_alert", f"({_sql_match(_SQL_TEXT, WEATHER)} OR {_sql_match('lower(title)', WEATHER_TITLE)})")
_rule_query("f15_opinion", "opinion_editorial", f"({_sql_match(_SQL_TEXT, OPINION)} OR {_sql_match('lower(title)', OPINION_TITLE)})")
_rule_query("f16_human_interest", "human_interest_fluff", _sql_match(_SQL_TEXT, HUMAN_INTEREST))
_rule_query("f17_too_short", "too_short", "length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) < 200")
_OBIT_SQL = f"({_sql_match(_SQL_TEXT, OBITUARY)} OR {_sql_match('title', OBITUARY_TITLE)} OR (len(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> '')) BETWEEN 2 AND 4 AND len(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0 AND NOT {_sql_match('lower(title)', NEWS_WORDS)}))"
_rule_query("f09_obituary", "obituary", _OBIT_SQL)


_CASCADE = f"""CASE WHEN coalesce(title, '') = '' THEN 'missing_title'
 WHEN {_sql_match('lower(title)', OUTSIDE)} OR ({_sql_match('lower(title)', OUTSIDE_CITIES)} AND NOT {_sql_match(_SQL_TEXT, INSIDE)}) THEN 'out_of_region'
 WHEN {_OBIT_SQL} THEN 'obituary'
 WHEN {_sql_match(_SQL_TEXT, EVENT)} OR {_sql_match('lower(title)', EVENT_TITLE)} OR ({_sql_match('lower(title)', EVENT_DATE)} AND {_sql_match('lower(title)', EVENT_WORDS)}) THEN 'event_listing'
 WHEN {_sql_match(_SQL_TEXT, REVIEW)} THEN 'review'
 WHEN ({_sql_match(_SQL_TEXT, SPORTS_WORDS)} AND {_sql_match(_SQL_TEXT, SCORE)}) OR {_sql_match(_SQL_TEXT, RECAP)} OR {_sql_match('lower(title)', SPORTS_TITLE)} THEN 'sports_game'
 WHEN {_sql_match(_SQL_TEXT, CLASSIFIED)} OR ({_sql_match('title', PRICE)} AND {_sql_match('lower(title)', LISTING_WORDS)}) THEN 'classified_ad'
 WHEN {_sql_match(_SQL_TEXT, WEATHER)} OR {_sql_match('lower(title)', WEATHER_TITLE)} THEN 'weather_alert'
 WHEN {_sql_match(_SQL_TEXT, OPINION)} OR {_sql_match('lower(title)', OPINION_TITLE)} THEN 'opinion_editorial'
 WHEN {_sql_match(_SQL_TEXT, HUMAN_INTEREST)} THEN 'human_interest_fluff'
 WHEN length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) < 200 THEN 'too_short' ELSE 'passed' END"""


@query("f18_cascade", f"WITH {_TITLED} SELECT id, {_CASCADE} AS reason FROM t")
def f18(m: Model) -> DataFrame:
    return _titled(m).select("id", reject_reason(F.col("title"), F.col("summary"), F.col("content")).alias("reason"))


@query("f19_rejection_counts", f"WITH {_TITLED} SELECT {_CASCADE} AS reason, count(*) AS n FROM t GROUP BY 1")
def f19(m: Model) -> DataFrame:
    return _titled(m).groupBy(reject_reason(F.col("title"), F.col("summary"), F.col("content")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("f27_policy_whitelist", f"WITH {_TITLED} SELECT id, CASE WHEN coalesce(title, '') = '' THEN 'missing_title' WHEN {_sql_match('lower(title)', [_NASHUA])} THEN 'blacklisted' WHEN {_OBIT_SQL} THEN 'obituary' WHEN length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) < 200 THEN 'too_short' WHEN {_sql_match('lower(title)', POLICY)} THEN 'passed_policy_whitelist' ELSE {_CASCADE} END AS reason FROM t")
def f27(m: Model) -> DataFrame:
    reason = reject_reason(F.col("title"), F.col("summary"), F.col("content"), policy_whitelist=True, blacklist=[_NASHUA])
    return _titled(m).select("id", reason.alias("reason"))


_SPORTS = f"(({_sql_match(_SQL_TEXT, SPORTS_WORDS)} AND {_sql_match(_SQL_TEXT, SCORE)}) OR {_sql_match(_SQL_TEXT, RECAP)} OR {_sql_match('lower(title)', SPORTS_TITLE)})"
_WEATHER = f"({_sql_match(_SQL_TEXT, WEATHER)} OR {_sql_match('lower(title)', WEATHER_TITLE)})"


@query("f28_context_rules", f"WITH {_TITLED} SELECT id, ({_sql_match(_SQL_TEXT, OUTSIDE_CONTEXT)} OR {_sql_match(_SQL_TEXT, OUTSIDE_CITIES)}) AND NOT {_sql_match(_SQL_TEXT, _INSIDE_WORD)} AS out_of_region, {_WEATHER} AND NOT {_sql_match(_SQL_TEXT, CLIMATE_POLICY)} AS weather_alert, {_SPORTS} AND NOT {_sql_match(_SQL_TEXT, SPORTS_POLICY)} AS sports_game FROM t")
def f28(m: Model) -> DataFrame:
    checked = planned_rules(F.col("title"), F.col("summary"), F.col("content"))
    return _titled(m).select("id", *[checked[r].alias(r) for r in ("out_of_region", "weather_alert", "sports_game")])


@query("f29_blacklist", f"WITH {_TITLED} SELECT id, {_sql_match('lower(title)', BLACKLIST)} AS blacklisted FROM t")
def f29(m: Model) -> DataFrame:
    return _titled(m).select("id", matches(F.lower("title"), BLACKLIST).alias("blacklisted"))


@query("f07_region_keywords", f"WITH {_TITLED} SELECT id, {_sql_match(_HEAD, REGION)} AS related FROM t")
def f07(m: Model) -> DataFrame:
    return _titled(m).select("id", needs_region(F.col("title"), F.col("summary"), F.col("content")).alias("related"))


_FEEDS = [*REGIONAL_FEEDS, "https://news.example/feed", "https://paper.example/rss"]


@query("f07b_region_gate", f"WITH {_TITLED}, g AS (SELECT *, list_extract({_FEEDS!r}, CAST(id % 7 AS INTEGER) + 1) AS feed FROM t) SELECT feed, count(*) FILTER (WHERE id % 7 >= 5 OR {_sql_match(_HEAD, REGION)}) AS passed, count(*) FILTER (WHERE id % 7 < 5 AND NOT {_sql_match(_HEAD, REGION)}) AS dropped FROM g GROUP BY feed")
def f07b(m: Model) -> DataFrame:
    feed = F.get(F.array(*[F.lit(f) for f in _FEEDS]), F.pmod("id", F.lit(7)).cast("int"))
    passes = passes_gate(F.col("feed"), F.col("title"), F.col("summary"), F.col("content"))
    gated = _titled(m).withColumn("feed", feed).select("feed", passes.alias("passes"))
    return gated.groupBy("feed").agg(F.count_if("passes").alias("passed"), F.count_if(~F.col("passes")).alias("dropped"))


#: Tags for the import, by id: none, one that raises, two that do, one that leaves out.
_TAGS = [[], ["Housing "], ["climate", "legislation", "other"], ["Police_Log", "climate"]]


@query(
    "f20_import_score",
    f"""WITH {_TITLED}, g AS (SELECT *, CAST(id % 4 AS INTEGER) AS tag FROM t)
SELECT id, CAST(CASE WHEN {_sql_match("lower(title)", IMPORT_TITLES)} OR tag = 3 OR length(content) < 800
    OR len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) < 100 THEN 0
  ELSE 50 + [0, 10, 20][tag + 1] + CASE WHEN length(content) > 3000 THEN 15 WHEN length(content) > 2000 THEN 10 ELSE 0 END
    + CASE WHEN {_sql_match("lower(title)", INVESTIGATIVE)} THEN 15 ELSE 0 END - CASE WHEN length(title) < 30 THEN 10 ELSE 0 END END AS INTEGER) AS score FROM g""",
)
def f20(m: Model) -> DataFrame:
    lists = F.array(*[F.array(*[F.lit(x) for x in t]).cast("array<string>") for t in _TAGS])
    tags = F.get(lists, F.pmod("id", F.lit(4)).cast("int"))
    return _titled(m).select("id", import_score(F.col("title"), F.col("content"), tags).cast("int").alias("score"))


@query("f21_confidence_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity / 50 >= 0.6 AND l_discount * 10 >= 0.6 AND (l_quantity / 50 + l_discount * 10) / 2 >= 0.5")
def f21(m: Model) -> DataFrame:
    a, b = F.expr("l_quantity / 50D"), F.expr("l_discount * 10")
    return m.table("lineitem").where((a >= 0.6) & (b >= 0.6) & ((a + b) / 2 >= 0.5)).select("l_orderkey", "l_linenumber", "l_partkey")
