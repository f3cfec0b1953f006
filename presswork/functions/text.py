"""Text expressions that stay in the JVM: tokens, n-grams, set similarities, keys and normal forms.

A null text gives an empty token list and empty keys; similarities of an empty set are 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

HANGUL = "가-힣"
SPACE = r"(?U)\s+"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(c), SPACE, " "))


def compact_spaces(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), SPACE, "")


def compact_key(c: Column) -> Column:
    """Lower case; only digits, latin and Hangul letters, percent signs and dots."""
    return F.regexp_replace(F.lower(text_or_empty(c)), rf"[^0-9a-z{HANGUL}%.]", "")


def title_key(c: Column) -> Column:
    """Lower case letters and digits, for comparing titles."""
    return F.regexp_replace(F.lower(text_or_empty(c)), rf"[^0-9A-Za-z{HANGUL}]+", "")


def signal_length(c: Column) -> Column:
    return F.length(F.regexp_replace(text_or_empty(c), rf"[^0-9A-Za-z{HANGUL}]", ""))


def name_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(text_or_empty(c), r"(?U)\s+|\(주\)|주식회사", ""))


def query_key(c: Column) -> Column:
    return F.lower(collapse(c))


def paragraphs(c: Column) -> Column:
    """Lines collapsed one by one, empty ones dropped."""
    lines = F.transform(F.split(text_or_empty(c), "\n"), collapse)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def news_id(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 12)


def language_flag(c: Column) -> Column:
    return F.when(F.coalesce(c.rlike(f"[{HANGUL}]"), F.lit(False)), "ko").otherwise("en")


def ticker(c: Column) -> Column:
    """Canonical six-character code; null if it isn't one."""
    t = F.upper(F.trim(c))
    t = F.regexp_replace(t, "^(KRX|KOSPI|KOSDAQ|KONEX):", "")
    t = F.regexp_replace(t, r"\.(KS|KQ)$", "")
    t = F.regexp_replace(t, "^A(?=[0-9]{6}$)", "")
    return F.when(t.rlike("^[0-9][0-9A-Z]{5}$"), t)


def title_tokens(c: Column) -> Column:
    """Distinct lower-case letter runs of three or more characters that aren't stop words."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(f"[A-Za-z{HANGUL}]{{3,}}"), F.lit(0))
    return F.array_except(F.transform(found, F.lower), words(L.TITLE_STOPWORDS))


def _stripped(text: Column, suffixes: tuple[str, ...]) -> Column:
    """text, each of its Hangul runs without its longest suffix of the list, if two characters or more are left."""
    some = "|".join(sorted(suffixes, key=len, reverse=True))
    return F.regexp_replace(text, f"(?<![{HANGUL}])([{HANGUL}]{{2,}}?)(?:{some})(?![{HANGUL}])", "$1")


def content_tokens(c: Column) -> Column:
    """Tokens in order, repeats kept: Hangul runs without ending and particle, latin words, numbers."""
    text = _stripped(_stripped(F.lower(text_or_empty(c)), L.ENDINGS), L.PARTICLES)
    number = r"[0-9]{2,}(?:\.[0-9]+)?%?|[0-9](?:\.[0-9]+%?|%)"  # two characters or more, as of the others
    found = F.regexp_extract_all(text, F.lit(rf"[{HANGUL}]{{2,}}|[a-z][a-z0-9+]+|{number}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(list(L.CONTENT_STOPWORDS)))


def bigrams(tokens: Column) -> Column:
    """Distinct adjacent character pairs of each token; short ones and numbers stay whole."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    parts = F.transform(tokens, lambda w: F.when((F.length(w) <= 2) | w.rlike("^[0-9]"), F.array(w)).otherwise(pairs(w)))
    return F.array_distinct(F.flatten(parts))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def dice(a: Column, b: Column) -> Column:
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, 2 * _shared(a, b) / (F.size(a) + F.size(b))).otherwise(0.0)


def containment(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(_shared(part, whole), F.size(part)), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(_shared(a, b), F.least(F.size(a), F.size(b))), F.lit(0.0))


def relation_score(title_a: Column, text_a: Column, title_b: Column, text_b: Column) -> Column:
    join = lambda t, d: F.concat(text_or_empty(t), F.lit(" "), text_or_empty(d))
    return F.round(overlap(title_tokens(join(title_a, text_a)), title_tokens(join(title_b, text_b))), 3)


def contains_phrase(lowered: Column, phrase: str) -> Column:
    """Phrase at ASCII word borders in a lower-case text; a plain search comes before the pattern."""
    escaped = "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in phrase.lower())
    return lowered.contains(phrase.lower()) & lowered.rlike(f"(?<![a-z0-9]){escaped}(?![a-z0-9])")


def grounded(lowered: Column, name: str) -> Column:
    """Whether any spelling of the name is in the lower-case text."""
    return reduce(lambda a, b: a | b, [contains_phrase(lowered, alias) for alias in L.ALIASES.get(name, (name,))])


def rule_keywords(title_words: Column, words_: Column, limit: int = 5) -> Column:
    """Names in the text, those of the title first; both in the vocabulary's order (gazetteer.names_in)."""
    first = F.array_intersect(words_, title_words)
    return F.slice(F.concat(first, F.array_except(words_, first)), 1, limit)


def rule_categories(words_: Column, limit: int = 2) -> Column:
    """Categories by how many of their cues are among the grounded words, ties in the list's order."""
    rows = [
        F.struct((-F.size(F.array_intersect(words_, words(cues_)))).alias("score"), F.lit(i).alias("place"), F.lit(name).alias("name"))
        for i, (name, cues_) in enumerate(L.CATEGORY_CUES.items())
    ]
    some = F.filter(F.array_sort(F.array(*rows)), lambda r: r["score"] < 0)
    return F.slice(F.transform(some, lambda r: r["name"]), 1, limit)


def cues(text: Column, vocabulary: dict[str, str]) -> Column:
    """Keys whose pattern the text matches, case ignored."""
    return F.array_compact(F.array(*[F.when(text_or_empty(text).rlike(f"(?i){p}"), k) for k, p in vocabulary.items()]))


def polarity(text: Column, up: str, down: str) -> Column:
    return cues(text, {"up": up, "down": down})


def direction(text: Column) -> Column:
    """1, -1 or 0: whether a headline tells of a rise or a fall alone."""
    up = text.rlike(f"{L.PRICE_UP}|{L.QUANTITY_UP}|{L.DECISIONS['hike']}")
    down = text.rlike(f"{L.PRICE_DOWN}|{L.QUANTITY_DOWN}|{L.DECISIONS['cut']}")
    return F.when(up & ~down, 1).when(down & ~up, -1).otherwise(0)


def first_sentence(c: Column, limit: int = 140) -> Column:
    return F.substring(F.element_at(F.split(text_or_empty(c), r"(?<=[.!?다])(?U)\s+"), 1), 1, limit)


def search_query(query: Column, label: Column) -> Column:
    has = F.lower(compact_spaces(label)).contains(F.lower(compact_spaces(query)))
    return F.when(has, label).otherwise(F.concat_ws(" ", query, label))


def map_text(title: Column, description: Column) -> Column:
    t, d = F.substring(text_or_empty(title), 1, 500), F.substring(text_or_empty(description), 1, 6000)
    return F.when((t == "") & (d == ""), "").otherwise(F.concat(F.lit("Title: "), t, F.lit("\nDescription: "), d))


def relevant_terms(terms: tuple[str, ...], title: Column, description: Column) -> Column:
    """Whether a term of more than two characters is in title and description."""
    text = F.lower(F.concat(text_or_empty(title), text_or_empty(description)))
    some = [text.contains(t.lower()) for t in terms if len(t) > 2]
    return reduce(lambda a, b: a | b, some, F.lit(False))


def guard_formula(c: Column) -> Column:
    """A leading quote before what a spreadsheet would run."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def lenient_object(c: Column) -> Column:
    """From the first opening to the last closing brace, code fences dropped; null if there is none."""
    bare = F.regexp_replace(text_or_empty(c), r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
