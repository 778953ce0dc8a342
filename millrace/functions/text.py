"""Normal forms of titles, companies, links and texts.

Letters with marks are folded by a translation table inside the JVM, which is built from Unicode's decompositions;
``fold_udf`` decomposes ligatures and the like too, in Arrow batches.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType



def _plain_of(c: str) -> str:
    """What a character decomposes to, without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: All characters of the basic plane beyond ASCII that decompose to one ASCII character, and these, pair by pair.
_MARKED = "".join(c for c in map(chr, (*range(0x80, 0xD800), *range(0xF900, 0x10000))) if len(_plain_of(c)) == 1 and _plain_of(c).isascii())
_PLAIN = "".join(map(_plain_of, _MARKED))

# Endings of company names that name a legal form, as they read after folding.
LEGAL_FORMS = ("srl", "srls", "spa", "sapa", "snc", "sas", "scarl", "gmbh", "ag", "kg", "ug", "ohg", "ltd", "limited", "llc", "llp", "lp", "inc", "incorporated", "corp", "corporation", "co", "company", "plc", "sa", "sl", "slu", "nv", "bv", "ab", "oy", "oyj", "as", "asa", "aps", "sarl", "sro", "zoo", "kft", "pty", "ehf")

# Hosts of boards and feeds, which are not a company's own pages.
BOARD_HOSTS = ("linkedin.com", "himalayas.app", "freehire.me", "whatjobs.com", "jobgether.com", "indeed.com", "glassdoor.com", "adzuna.com", "adzuna.co.uk", "reed.co.uk", "remoteok.com", "weworkremotely.com", "workingnomads.com", "jobicy.com", "remotive.com", "arbeitnow.com", "themuse.com", "ziprecruiter.com", "talent.com", "jooble.org", "careerjet.com", "jobrapido.com", "trovolavoro.it", "infojobs.net", "monster.com", "wellfound.com", "jobs.workable.com", "jobleads.com")


@F.pandas_udf(StringType())
def fold_udf(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, also of what becomes several characters."""
    return texts.map(lambda t: None if t is None else _plain_of(t))


def fold(text: Column) -> Column:
    """The same in the JVM, for all that becomes one character: letters with marks of any language written in Latin, and marks that stand apart."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{Mn}+", "")


def normalize_title(title: Column, full: bool = False) -> Column:
    """Folded, lower-cased words: dots, apostrophes and backticks go, everything else that is no letter or digit parts words."""
    folded = F.lower(fold_udf(title) if full else fold(title))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "[.'’`]", ""), "[^a-z0-9]+", " "))


def normalize_company(name: Column, full: bool = False) -> Column:
    """A title's form without legal forms at the end; one word always stays."""
    return F.regexp_replace(normalize_title(name, full), f"( (?:{'|'.join(LEGAL_FORMS)}))+$", "")


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def board_job_id(url: Column, board: str = "linkedin") -> Column:
    """The digits (5 or more) that end the last path segment of a page of the board's host, in any of its top-level domains, or a host below it; else null."""
    last = F.regexp_extract(F.try_parse_url(F.trim(url), F.lit("PATH")), r"([^/]*)/*$", 1)
    number = F.regexp_extract(last, r"([0-9]{5,})$", 1)
    own = F.coalesce(host_of(F.trim(url)).rlike(rf"(^|\.){re.escape(board)}\."), F.lit(False))
    return F.when(own & (number != ""), number)


def is_company_page(url: Column, boards: tuple[str, ...] = BOARD_HOSTS) -> Column:
    return host_of(url).isNotNull() & ~host_of(url).rlike(rf"(^|\.)({'|'.join(map(re.escape, boards))})$")


def choose_canonical(urls: Column) -> Column:
    """The first link to a company's own page, or else the first."""
    return F.coalesce(F.try_element_at(F.filter(urls, lambda u: is_company_page(u)), F.lit(1)), F.try_element_at(urls, F.lit(1)))


def posting_key(url: Column) -> Column:
    """``linkedin:<id>``, or host and path without a slash at the end."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.coalesce(F.concat(F.lit("linkedin:"), board_job_id(url)), F.concat(host_of(url), F.regexp_replace(path, "/+$", "")))


def note_number(name: Column) -> Column:
    """The number that ends a file name before its extension."""
    digits = F.regexp_extract(name, r"([0-9]+)(?:\.[A-Za-z]+)?$", 1)
    return F.when(digits != "", digits.cast("long"))


def label_uri(uri: Column, scheme: str = "label") -> Column:
    """(label, path) of ``scheme://label/path``; a path that leaves its root is null."""
    m = rf"^{scheme}://([a-z_]+)/(.+)$"
    path = F.url_decode(F.regexp_extract(uri, m, 2))
    safe = uri.rlike(m) & ~path.rlike(r"(^|/)\.\.(/|$)|^/")
    return F.when(safe, F.struct(F.regexp_extract(uri, m, 1).alias("label"), path.alias("path")))


def slugify(text: Column, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", "_"), 1, most)


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@F.pandas_udf(StringType())
def clean_text(texts: pd.Series) -> pd.Series:
    """Text of an HTML fragment: tags out, entities resolved, runs of blanks closed up."""
    tags, blanks = re.compile(r"<[^>]*>"), re.compile(r"\s+")
    return texts.map(lambda t: None if t is None else blanks.sub(" ", html.unescape(tags.sub(" ", t))).strip())


def fingerprint(text: Column, chars: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, chars)


def legacy_key(job_id: Column, url: Column) -> Column:
    return F.coalesce(job_id, F.concat(F.lit("legacy:"), F.md5(url)))


def redact(text: Column) -> Column:
    """Passwords in connection strings and bot tokens masked."""
    return F.regexp_replace(F.regexp_replace(text, r"(\w+://[^:/\s]+):[^@\s]+@", "$1:***@"), r"\b[0-9]{6,}:[A-Za-z0-9_-]{20,}", "***")


def quote_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def quote_found(quote: Column, text: Column, least: int = 4) -> Column:
    """Whether a quote stands in a text, by letters and digits alone."""
    return (F.length(quote_key(quote)) >= least) & F.contains(quote_key(text), quote_key(quote))


def first_keyword(text: Column, words: list[str]) -> Column:
    """The first keyword of the list that stands in the text as a whole word (``+`` counts as a word character)."""
    return F.coalesce(*(F.when(text.rlike(rf"(?i)(?<![\w+]){re.escape(w)}(?![\w+])"), F.lit(w)) for w in words))


def description_budget(batch: Column, total: int = 24_000, low: int = 1500, high: int = 6000) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.lit(total) / batch))).cast("int")


def excerpt(text: str, words: str, budget: int, around: int = 180, intro: int = 200) -> str:
    """An introduction and the surroundings of what ``words`` matches, merged where they touch.

    The radius is halved until all fits; if even the smallest doesn't, every n-th place is taken.
    """
    spans = [m.span() for m in re.finditer(words, text, re.I)]
    radius, places = around, [(0, min(intro, len(text)))]
    while True:
        merged: list[list[int]] = []
        for a, b in sorted([*places, *((max(0, a - radius), min(len(text), b + radius)) for a, b in spans)]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out = " ... ".join(text[a:b] for a, b in merged)
        if len(out) <= budget:
            return out
        if radius > 20:
            radius //= 2
        elif len(spans) > 1:
            spans = spans[::2]
        else:
            return out[:budget]


def policy_excerpt(words: str, budget: int):
    """A pandas UDF for :func:`excerpt`."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else excerpt(t, words, budget))

    return run


def language_passes(text: Column, language: Column, allowed: tuple[str, ...], least: int = 40) -> Column:
    """Whether a text is in an allowed language; short texts and unknown languages pass."""
    return F.coalesce((F.length(text) < least) | language.isNull() | language.isin(*allowed), F.lit(True))


#: Small words that tell languages apart.
SMALL_WORDS = {
    "en": ("the", "and", "of", "to", "with", "for", "is", "that", "are", "you", "was", "this"),
    "es": ("el", "los", "las", "y", "que", "con", "para", "una", "por", "del", "es", "está"),
    "it": ("il", "gli", "che", "di", "e", "con", "per", "una", "della", "sono", "è", "nel"),
    "de": ("der", "die", "das", "und", "ist", "mit", "für", "nicht", "ein", "auf", "den", "von"),
    "fr": ("le", "les", "et", "des", "une", "que", "dans", "pour", "est", "sur", "avec", "du"),
}


def detected_language(text: Column, least: int = 40, words: int = 2) -> Column:
    """The language with most small words; null for short texts, fewer than ``words`` of them, and ties."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-zäöüßàèéìòùáíóúñâêîôûç]+", " "), " ")
    count = lambda small: F.size(F.filter(parts, lambda w: w.isin(*small)))
    found = {lang: count(small) for lang, small in SMALL_WORDS.items()}
    top = F.greatest(*found.values())
    several = sum(((n == top).cast("int") for n in found.values()), F.lit(0)) > 1
    named = F.coalesce(*(F.when(n == top, lang) for lang, n in found.items()))
    return F.when((F.length(F.coalesce(text, F.lit(""))) >= least) & (top >= words) & ~several, named)


def is_title_only(description: Column, title: Column, company: Column) -> Column:
    """Whether a description is nothing but the title and company that stand in for a missing one."""
    return F.coalesce(F.trim(description) == F.concat(title, F.lit(" at "), company), F.lit(False))


def description_status(status: Column, description: Column, title_only: Column) -> Column:
    """An old status as one of the store's: a stand-in, a blank text or an unknown status has failed."""
    blank = F.trim(F.coalesce(description, F.lit(""))) == ""
    return F.when(title_only | blank, "failed").when(status.isNull() | status.isin("ok", "partial"), "ok").otherwise("failed")


def prompt_text(description: Column, found: Column, budget: Column) -> Column:
    """A description cut to its budget; with an excerpt (``found``) at its end, within the same budget, if it doesn't fit."""
    tail = F.concat(F.lit("\n...\n"), found)
    room = F.greatest(budget - F.length(tail), F.lit(0))
    cut = F.when(F.coalesce(found, F.lit("")) == "", F.substring(description, F.lit(1), budget)).otherwise(F.substring(F.concat(F.substring(description, F.lit(1), room), tail), F.lit(1), budget))
    return F.when(F.length(description) <= budget, description).otherwise(cut)


def age_text(seconds: Column) -> Column:
    """``45m`` or ``2h05m``; null for an unknown age."""
    minutes = F.floor(seconds / 60)
    return F.when(minutes >= 60, F.format_string("%dh%02dm", F.floor(minutes / 60), minutes % 60)).when(minutes.isNotNull(), F.format_string("%dm", minutes))


def duration_text(start: Column, end: Column) -> Column:
    """The time between two moments as an age; ``?`` if one is unknown."""
    return F.coalesce(age_text(F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))), F.lit("?"))


def short_model(name: Column) -> Column:
    """The last part of a model's name, without the mark of a free offer."""
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), ":free$", "")


def tokens_text(n: Column) -> Column:
    """Thousands from 1,000 on (halves to even), the number below, ``-`` if unknown."""
    return F.coalesce(F.when(n >= 1000, F.concat(F.bround(n / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(n.cast("string")), F.lit("-"))
