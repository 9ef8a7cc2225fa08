"""Scalar text expressions. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORDS = r"[\p{L}\p{N}_]+"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
# Code points that are or build emoji: pictographs, symbols and dingbats, flag halves, the emoji variation selector, the joiner,
# and the single ones that Unicode's emoji data has outside these ranges.
EMOJI = (
    r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{FE0F}\x{200D}"
    r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}-\x{21AA}\x{231A}-\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}"
    r"\x{24C2}\x{25AA}-\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2934}-\x{2935}\x{2B05}-\x{2B07}\x{2B1B}-\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}"
    r"\x{3297}\x{3299}\x{1F004}\x{1F0CF}\x{1F170}-\x{1F171}\x{1F17E}-\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F201}-\x{1F202}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F250}-\x{1F251}]"
)
# Words without content of their own (a closed list; another may be passed).
STOPWORDS = """
    a about after all also am an and any are as at be been being but by can cant
    could did do does doing done dont for from get gets got had has have having
    he her hers him his how i if in into is it its ive just like me more most much
    my no nor not now of off on once only or other our out over own re same she
    should so some such than that thats the their them then there these they this
    those through to too up us very was we well were what when where which while
    who why will with would you your yours
""".split()
# What is redacted as records come in. Labels of ids that keep standing before them, and the patterns in their order.
ID_LABELS = "order|awb|tracking|docket|invoice|ref|reference|complaint|ticket|txn|transaction|shipment"
COLLECTED = [
    (r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b", "[email]"),
    (rf"(?iU)\b({ID_LABELS})(\s*(?:id|no\.?|number|#)?\s*[:#\-]?\s*)([A-Za-z0-9][A-Za-z0-9/\-]{{5,}})", "$1$2[id]"),
    (r"(?U)(?<!\d)(?:\+?91[\s\-]?)?[6-9]\d{9}(?!\d)", "[phone]"),
    (r"(?U)(?<!\d)\d{10,}(?!\d)", "[id]"),
    (r"(?U)(?<![\w/@.])@([A-Za-z0-9_.]{3,30})\b", "[handle]"),
]
# What is redacted as quotes go out.
SHOWN = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", "[email]"),
    (r"(?i)\border\s*(?:id|no)?\s*[:#]?\s*[a-z0-9-]*\d[a-z0-9-]{4,}", "[order]"),
    (r"@[A-Za-z0-9_]{2,}", "[handle]"),
    (r"\+?[0-9][0-9 ()-]{8,}[0-9]", "[phone]"),
]
# Inline tags that collected text may hold, those that end a line, and invisible characters.
TAGS = "br|p|div|span|b|i|u|strong|em|a|li|ul|ol|small|sub|sup|font"
BREAKS = r"(?i)<(?:br\s*/?|/p|/div|/li)\s*>"
INVISIBLE = r"[\x{200B}\x{2060}\x{FEFF}\x{AD}\x{200E}\x{200F}]"
# Units of "3 days ago" in days, words for now, and the date formats in their order (day before month).
UNITS = {"minute": 1 / 1440, "hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 30.44, "year": 365.25}
NOW = ("today", "just now", "a moment ago")
DATES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "MMM d yyyy")
#: An entity with its semicolon.
CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
#: White space as text processing sees it, line feeds apart.
BLANK = r"[\t\x0B-\x0D\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(html.unescape(t)))


@F.pandas_udf(StringType())
def _closed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else CLOSED.sub(lambda found: html.unescape(found[0]), t))


def casefold(text: Column) -> Column:
    """Compatibility forms, case-folded. Texts of ASCII alone never leave the JVM."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(plain, F.lower(text)).otherwise(_folded(F.when(~plain, text)))


def unescape(text: Column) -> Column:
    """Entities of all kinds as characters, twice, as scraped pages escape twice. Texts without an ampersand never leave the JVM."""
    held = F.contains(text, F.lit("&"))
    return F.when(held, _unescaped(F.when(held, text))).otherwise(text)


def word_count(text: Column) -> Column:
    """Runs of letters, digits and underscores; combining marks are no part of a word."""
    return F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)))


def content_word_count(text: Column, stop: list[str] | None = None) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))
    return F.size(F.filter(words, lambda w: ~w.isin(STOPWORDS if stop is None else stop)))


def keyword_pattern(terms: list[str]) -> str:
    """One alternation, longest term first, between ends of words of any script, in any case."""
    return r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t))) + r")(?![\p{L}\p{N}_])"


def keyword_hits(text: Column, terms: list[str]) -> Column:
    return F.regexp_count(text, F.lit(keyword_pattern(terms)))


def has_emoji(text: Column) -> Column:
    """Whether any code point is of ``EMOJI``. Most texts have none from where these begin, which is told by a class of two ranges."""
    return text.rlike(r"[^\x00-\x{A8}\x{AA}-\x{AD}\x{AF}-\x{200C}]") & text.rlike(EMOJI)


def strip_emoji(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, EMOJI, " "), r"\s+", " "))


def devanagari_is_incidental(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("[A-Za-z]")) >= 24) & (F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}]")) <= 4)


def exclusion_reason(text: Column, lang: Column, *, min_words: int = 3, languages: tuple[str, ...] = ("hi",), language_min_words: int = 8) -> Column:
    """The first reason that holds: too_short, contains_emoji, then the language: by script, else by ``lang``, which is null where a text tells none with
    confidence (``languages.language``); texts under ``language_min_words`` are judged by script alone."""
    script = F.regexp_replace(text, r"@\S+", " ")
    hindi = (script.rlike(r"[\x{0900}-\x{097F}]") & ~devanagari_is_incidental(script)) | (lang.isin(*languages) & (word_count(text) >= language_min_words))
    return (
        F.when(word_count(text) < min_words, "too_short")
        .when(has_emoji(text) & (word_count(strip_emoji(text)) < min_words), "contains_emoji")
        .when(hindi, "hindi_language")
    )


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm(text: Column) -> Column:
    return squeeze(F.lower(text))


def contains_quote(text: Column, quote: Column) -> Column:
    return (norm(quote) != "") & F.contains(norm(text), norm(quote))


def truncate(text: Column, limit: int = 240) -> Column:
    """Squeezed; beyond ``limit`` cut at the last blank, end stops removed, an ellipsis added."""
    flat = squeeze(text)
    head = F.regexp_replace(F.regexp_extract(F.left(flat, F.lit(limit)), r"^(.*)\s\S*$", 1), r"[.,;:]+$", "")
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.when(head == "", F.left(flat, F.lit(limit))).otherwise(head), F.lit("…")))


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda out, rule: F.regexp_replace(out, *rule), rules, text)


def redact_collected(text: Column) -> Column:
    """As records come in: email, labelled ids (the label stays), mobile numbers, long digit runs, handles."""
    return _replaced(text, COLLECTED)


def safe_snippet(text: Column, limit: int = 120) -> Column:
    """One line for a log, of at most ``limit`` characters."""
    flat = squeeze(text)
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…")))


def redact_shown(text: Column) -> Column:
    """As quotes go out: email, order ids, handles, phone numbers."""
    return _replaced(text, SHOWN)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("`"), F.lit("'")), r"^([#>])", r"\\$1")


def unescape_closed(text: Column) -> Column:
    """Entities that end with a semicolon as characters, once, as in the source of a page. What lacks the semicolon was cut off and stays."""
    held = F.contains(text, F.lit("&")) & F.contains(text, F.lit(";"))
    return F.when(held, _closed(F.when(held, text))).otherwise(text)


def clean_text(text: Column, entities: Callable[[Column], Column] = unescape) -> Column:
    """Line ends unified, break tags to line ends, other inline tags and invisible characters away, entities, runs of blanks and of empty lines
    squeezed, lines trimmed. Null is null."""
    lines = [(r"\r\n|[\r\x{85}\x{2028}\x{2029}\x0B\x0C\x{1C}-\x{1E}]", "\n"), (BREAKS, "\n"), (rf"(?i)</?(?:{TAGS})\b[^>]*>", "")]
    ends = [(INVISIBLE, ""), (r"[ \t\x{A0}\x{2000}-\x{200A}]{2,}", " "), (rf"{BLANK}*\n{BLANK}*", "\n"), (r"\n{3,}", "\n\n"), (rf"^(?:\n|{BLANK})+|(?:\n|{BLANK})+$", "")]
    return _replaced(entities(_replaced(text, lines)), ends)


def for_fingerprint(text: Column) -> Column:
    """Quoted lines and URLs dropped, case-folded compatibility forms, words joined by blanks."""
    rules = [(r"(?m)^\s*>.*$", " "), (r"(?i)(?:https?://|www\.)\S+", " ")]
    return F.array_join(F.regexp_extract_all(_replaced(casefold(text), rules), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4)


def truncate_to_tokens(text: Column, tokens: int | Column) -> Column:
    """A prefix of at most ``tokens`` estimated tokens, cut at its last blank where one stands before its last character; of a text that is not
    empty one character at least."""
    room = 4 * (F.lit(tokens) if isinstance(tokens, int) else tokens).cast("int")
    head = F.left(text, room)
    cut = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    one = F.left(text, F.lit(1))
    return F.when(room <= 0, one).when(F.char_length(text) <= room, text).when(~F.contains(F.left(text, room - 1), F.lit(" ")), head).when(cut == "", one).otherwise(cut)


def line_tokens(doc: Column, text: Column) -> Column:
    """Estimated tokens of a document's line in a request."""
    return estimate_tokens(F.concat(F.lit("["), doc.cast("string"), F.lit("] "), text, F.lit("\n")))


def fit_document(doc: Column, text: Column, max_tokens: int) -> tuple[Column, Column]:
    """(text, whether it was cut) so that the line ``[doc] text`` has at most ``max_tokens`` estimated tokens; a long id leaves one token."""
    cut = line_tokens(doc, text) > max_tokens
    room = F.greatest(F.lit(max_tokens) - line_tokens(doc, F.lit("")), F.lit(1))
    return F.when(cut, truncate_to_tokens(text, room)).otherwise(text), cut


def pretty_label(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def rating(text: Column) -> Column:
    """"4 of 5", "3.5/5", else a bare number from 0 to 5."""
    scaled = F.regexp_extract(text, r"(\d(?:\.\d+)?)\s*(?:of|/|out of)\s*5", 1)
    bare = F.regexp_extract(text, r"^\s*(\d(?:\.\d+)?)\s*$", 1)
    value = F.when(scaled != "", scaled).when(bare != "", bare).try_cast("double")
    return F.when(value.between(0, 5), value)


def mojibake_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit("�")) / F.greatest(F.char_length(text), F.lit(1))


def parse_date(value: Column, now: Column) -> Column:
    """Words for now, yesterday, "N units ago" anywhere in the value, then ``DATES`` in order, then what casts; else null."""
    flat = F.trim(F.regexp_replace(value, r"\s+", " "))
    low = F.lower(flat)
    ago = rf"(?:(\d+)|an?)\s+({'|'.join(UNITS)})s?\s+ago"
    unit = F.regexp_extract(low, ago, 2)
    n = F.coalesce(F.regexp_extract(low, ago, 1).try_cast("double"), F.lit(1.0))
    days = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.nullif(unit, F.lit("")))
    then = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) - F.round(n * days * 86400e6).cast("long"))
    plain = F.regexp_replace(F.replace(flat, F.lit("Sept "), F.lit("Sep ")), r"\.+$", "")
    fixed = [F.try_to_timestamp(plain, F.lit(f)) for f in DATES]
    return F.when(low.isin(*NOW), now).when(low == "yesterday", now - F.expr("interval 1 day")).when(unit != "", then).otherwise(F.coalesce(*fixed, plain.try_cast("timestamp")))


def as_bool(value: Column) -> Column:
    return F.when(F.lower(F.trim(value)).isin("true", "1", "yes"), True).when(F.lower(F.trim(value)).isin("false", "0", "no"), False)
