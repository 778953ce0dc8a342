"""Countries of locations and texts, and which tier or scope they fall in. Unknown is kept, known but unwanted is dropped."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The European Union's members, the other members of the economic area, and further countries that are recognised.
EU = ("austria", "belgium", "bulgaria", "croatia", "cyprus", "czechia", "denmark", "estonia", "finland", "france", "germany", "greece", "hungary", "ireland", "italy", "latvia", "lithuania", "luxembourg", "malta", "netherlands", "poland", "portugal", "romania", "slovakia", "slovenia", "spain", "sweden")
EEA = ("norway", "iceland", "liechtenstein")
OTHERS = ("united kingdom", "switzerland", "san marino", "andorra", "monaco", "albania", "belarus", "bosnia and herzegovina", "kosovo", "moldova", "montenegro", "north macedonia", "russia", "serbia", "turkey", "ukraine", "united states", "canada", "india", "australia", "israel")
TIERS = {"italy": 1, "switzerland": 2, "san marino": 2, **{c: 3 for c in (*EU, *EEA) if c != "italy"}, "united kingdom": 4}
KNOWN = (*EU, *EEA, *OTHERS)

# Other names of countries.
ALIASES = {"czech republic": "czechia", "uk": "united kingdom", "great britain": "united kingdom", "england": "united kingdom", "scotland": "united kingdom", "wales": "united kingdom", "northern ireland": "united kingdom", "holland": "netherlands", "the netherlands": "netherlands", "republic of ireland": "ireland", "republic of san marino": "san marino", "swiss confederation": "switzerland", "slovak republic": "slovakia", "united states of america": "united states", "usa": "united states", "us": "united states"}

# Codes of states of the United States, and those that may as well be a country's or canton's.
STATES = ("AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC")
AMBIGUOUS = ("AL", "AR", "DE", "IL", "IN", "MD", "ME", "MT", "NE")

# Names of countries in texts, in the order in which they are told, and how they are shown.
SHOWN = {"united kingdom": "the UK", "great britain": "the UK", "uk": "the UK", "united states": "the US", "usa": "the US", "us": "the US", "the netherlands": "the Netherlands", "netherlands": "the Netherlands", "holland": "the Netherlands", "switzerland": "Switzerland", "germany": "Germany", "france": "France", "spain": "Spain", "portugal": "Portugal", "italy": "Italy", "poland": "Poland", "romania": "Romania", "ireland": "Ireland", "canada": "Canada", "india": "India", "australia": "Australia", "brazil": "Brazil", "latam": "Latin America", "singapore": "Singapore", "japan": "Japan", "china": "China", "israel": "Israel", "turkey": "Turkey", "denmark": "Denmark", "sweden": "Sweden", "norway": "Norway", "finland": "Finland", "austria": "Austria", "belgium": "Belgium", "czechia": "Czechia", "greece": "Greece", "hungary": "Hungary", "luxembourg": "Luxembourg", "malta": "Malta", "cyprus": "Cyprus"}


def _lookup(key: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for item in table.items() for x in item)), key)


def country_of(location: Column, known: tuple[str, ...] = KNOWN) -> Column:
    """The country a location's last part names, by name, other name or state code; null if it names none."""
    name = F.lower(F.trim(F.element_at(F.split(location, ","), -1)))
    resolved = F.coalesce(_lookup(name, ALIASES), name)
    return F.when(resolved.isin(*known), resolved).when(name.isin(*(s.lower() for s in STATES if s not in AMBIGUOUS)), "united states")


def is_country_only(location: Column) -> Column:
    return ~location.contains(",") & country_of(location).isNotNull()


def in_scope(location: Column, allowed: list[str]) -> Column:
    """Whether a location may be in one of the countries; a country that isn't known to us raises."""
    if unknown := [c for c in allowed if c not in KNOWN]:
        raise ValueError(f"unknown countries: {unknown}")
    c = country_of(location)
    return c.isNull() | c.isin(*allowed)


def provisional_tier(country: Column, hint: Column, tiers: dict[str, int] = TIERS) -> Column:
    """The country's tier; the hint's where the country is unknown; null (dropped) for a country without one."""
    return F.when(country.isNull(), hint).otherwise(_lookup(country, tiers))


def countries_of(name: str) -> list[str]:
    """How a country is shown whose name this is, if it is one."""
    shown = SHOWN.get(name.lower(), SHOWN["italy"] if name.lower() == "italia" else None)
    return [shown] if shown else []


_WORD = re.compile(r"[^\W\d_]+|[()]")
_SINGLE = {name for name in SHOWN if len(name) > 2}


def named_countries(text: str) -> list[str]:
    """The countries that a text names, in the order of ``SHOWN``.

    Names count in any case. "uk" counts in capitals, in brackets or after a preposition; "us" is a pronoun as well
    and counts in capitals unless a neighbour is in capitals too, in brackets, after "in the", or before "based".
    """
    raw = _WORD.findall(text)
    words = [w.lower() for w in raw]
    loud = lambda k: 0 <= k < len(raw) and len(raw[k]) > 1 and raw[k].isupper()
    found = {words[k] for k in range(len(words))} & _SINGLE | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} & _SINGLE
    for k, word in enumerate(words):
        if word in ("uk", "us"):
            boxed = words[k - 1 : k] == ["("] and words[k + 1 : k + 2] == [")"]
            before = [w for w in words[max(0, k - 2) : k] if w != "the"][-1:]
            if word == "uk" and (raw[k] == "UK" or boxed or before and before[0] in ("in", "within", "inside", "of", "to", "from")):
                found.add(word)
            if word == "us" and (boxed or raw[k] == "US" and not loud(k - 1) and not loud(k + 1) or words[k + 1 : k + 2] == ["based"] or words[k - 1 : k] == ["the"] and before and before[0] in ("in", "within", "inside")):
                found.add(word)
    return list(dict.fromkeys(shown for name, shown in SHOWN.items() if name in found))


@F.pandas_udf(ArrayType(StringType()))
def countries_in(text: pd.Series) -> pd.Series:
    """The countries that each text names, as they are shown; null texts name none."""
    return text.map(lambda t: named_countries(t or ""))
