"""Pages of HTML: cards of a result page, descriptions, and what kind of application a page asks for."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import host_of

CARDS = "array<struct<job_id:string,url:string,title:string,company:string,location:string,posted_at:string>>"
DESCRIPTION = "struct<text:string,status:string,posted:string>"
# Class names of a result page's parts.
_PARTS = {"base-search-card__title": "title", "base-search-card__subtitle": "company", "job-search-card__location": "location"}
_VOID = {"br", "img", "hr", "input", "meta", "link"}


class _Cards(HTMLParser):
    """Collects one record per list item."""

    def __init__(self) -> None:
        super().__init__()
        self.out: list[dict] = []
        self.now: dict | None = None
        self.into: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "li":
            self.now = {}
            self.out.append(self.now)
        if self.now is None:
            return
        if (urn := a.get("data-entity-urn")) and (m := re.search(r"(\d+)$", urn)):
            self.now["job_id"] = m[1]
        classes = a.get("class", "").split()
        if tag == "a" and "base-card__full-link" in classes:
            self.now["url"] = a.get("href", "")
        if tag == "time" and "datetime" in a:
            self.now["posted_at"] = a["datetime"]
        for name, part in _PARTS.items():
            if name in classes:
                self.into = part

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h3", "h4", "span"):
            self.into = None
        if tag == "li":
            self.now = None

    def handle_data(self, data: str) -> None:
        if self.now is not None and self.into:
            self.now[self.into] = self.now.get(self.into, "") + data


def parse_cards(page: str) -> list[dict]:
    """Cards with title, link and identifier; NUL characters go."""
    parser = _Cards()
    parser.feed((page or "").replace("\0", ""))
    names = ("job_id", "url", "title", "company", "location", "posted_at")
    found = [{n: " ".join(c[n].split()) if c.get(n) else None for n in names} for c in parser.out]
    return [c for c in found if c["job_id"] and c["url"] and c["title"]]


#: Elements that a paragraph can't hold.
_BLOCKS = frozenset(("address", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"))


class _Text(HTMLParser):
    """Text of the whole page, of its first paragraphs, of marked parts, and the description in its head."""

    def __init__(self) -> None:
        super().__init__()
        self.main, self.posted, self.meta, self.paragraphs, self.depth, self.where, self.skip = "", "", None, [], 0, None, 0
        #: Whether text belongs to the last paragraph: not before one, and not behind its end.
        self.open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "meta" and a.get("name") == "description":
            self.meta = self.meta or a.get("content")
        if self.where and tag not in _VOID:
            self.depth += 1
        elif "show-more-less-html__markup" in classes:
            self.where, self.depth = "main", 1
        elif any(c.startswith("posted-time-ago__text") for c in classes):
            self.where, self.depth = "posted", 1
        if tag in ("p", "article"):
            self.paragraphs.append("")
            self.open = True
        elif tag in _BLOCKS:
            self.open = False  # a paragraph without an end tag ends where a block begins

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if self.where and tag not in _VOID:
            self.depth -= 1
            if not self.depth:
                self.where = None
        if tag in ("p", "article") or tag in _BLOCKS:
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.where:
            setattr(self, self.where, getattr(self, self.where) + " " + data)
        if self.open:
            self.paragraphs[-1] += " " + data


def describe(page: str, title: str = "", company: str = "", least: int = 50) -> tuple[str, str, str | None]:
    """(text, status, posted): the marked part, or else the head's description, a first long paragraph, or title and company."""
    parser = _Text()
    parser.feed(page or "")
    clean = lambda t: " ".join((t or "").split())
    posted = clean(parser.posted) or None
    if main := clean(parser.main):
        return main, "ok", posted
    for text in (clean(parser.meta), next((c for p in parser.paragraphs if len(c := clean(p)) > least), ""), f"{title} at {company}"):
        if text:
            return text, "partial", posted
    return "", "partial", posted


def cards_udf():
    @F.pandas_udf(CARDS)
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(parse_cards)

    return run


def description_udf():
    @F.pandas_udf("text string, status string, posted string")
    def run(pages: pd.Series, titles: pd.Series, companies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(*x) for x in zip(pages, titles.fillna(""), companies.fillna(""), strict=True)], columns=["text", "status", "posted"])

    return run


# Hosts of application systems, and what a challenge page says.
SYSTEMS = ("ashbyhq.com", "bamboohr.com", "greenhouse.io", "icims.com", "lever.co", "myworkdayjobs.com", "personio.com", "recruitee.com", "smartrecruiters.com", "successfactors.com", "teamtailor.com", "workable.com")
CHALLENGES = ("captcha", "are you a robot", "unusual traffic", "verify you are human", "security check")


def application_channel(url: Column, page: Column) -> Column:
    """external_ats, easy_apply, email or unknown, by the final host and the page's marks."""
    host = host_of(url)
    return (
        F.when(host.rlike(rf"(^|\.)({'|'.join(map(re.escape, SYSTEMS))})$"), "external_ats")
        .when(F.lower(page).contains("easy apply"), "easy_apply")
        .when(page.rlike(r"(?i)href=.mailto:"), "email")
        .otherwise("unknown")
    )


def is_challenge(page: Column) -> Column:
    return F.lower(page).rlike("|".join(CHALLENGES))
