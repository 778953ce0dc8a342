"""Known answers of scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.functions import geo, stats, text, timeutil


def value(spark, column, **fields):
    return spark.createDataFrame([Row(**fields)] if fields else [Row(x=1)]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("name", "want"),
    [("Nordlicht Werke GmbH & Co. KG", "nordlicht werke"), ("Vela Marina S.r.l.s.", "vela marina"), ("Café Élan SARL", "cafe elan"), ("D'Amico Tools Pty. Ltd.", "damico tools"), ("R&D", "r d"), ("AS", "as"), ("Company Town", "company town"), ("Fjord Oyj", "fjord"), ("Kiln Incorporated", "kiln"), ("", "")],
)
def test_company(spark, name, want):
    assert value(spark, text.normalize_company(F.lit(name))) == want
    assert value(spark, text.normalize_company(F.col("n"), full=True), n=name) == want


@pytest.mark.parametrize(("title", "want"), [("Data/Platform Lead (f/m/x)", "data platform lead f m x"), ("Développeur Éolien", "developpeur eolien"), ("  Sr. Op's  Manager -- Nights ", "sr ops manager nights")])
def test_title(spark, title, want):
    assert value(spark, text.normalize_title(F.lit(title))) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://it.linkedin.com/jobs/view/plant-keeper-7654321?y=2", "7654321"), ("https://www.linkedin.com/jobs/view/7654321/", "7654321"), ("https://example.org/jobs/view/7654321", None), ("https://www.linkedin.com/company/7654321", "7654321"), ("https://linkedin.cn/x/y-7654321/", "7654321"), ("https://linkedin.com/7654321/about", None), ("https://linkedin.com/jobs/1234", None), ("https://notlinkedin.com/jobs/view/7654321", None)],
)
def test_job_id(spark, url, want):
    assert value(spark, text.board_job_id(F.lit(url))) == want


def test_posting_key(spark):
    assert value(spark, text.posting_key(F.lit("https://Jobs.Example.org/open/b//?ref=2#top"))) == "jobs.example.org/open/b"


@pytest.mark.parametrize(("url", "want"), [("https://careers.fjord.fi/x", True), ("https://www.reed.co.uk/x", False), ("https://de.indeed.com/x", False), ("https://myindeed.com/x", True), ("no link", False)])
def test_company_page(spark, url, want):
    assert value(spark, text.is_company_page(F.lit(url))) is want


@pytest.mark.parametrize(
    ("place", "want"),
    [("Atlanta, GA", "united states"), ("Denver, co", "united states"), ("Munich, DE", None), ("Neuchâtel, NE", None), ("Kyiv, Ukraine", "ukraine"), ("Ankara, Turkey", "turkey"), ("Geneva Metropolitan Area", None), ("Utrecht, The Netherlands", "netherlands"), ("Leeds, UK", "united kingdom"), ("Brno, Czech Republic", "czechia"), ("", None)],
)
def test_country(spark, place, want):
    assert value(spark, geo.country_of(F.lit(place))) == want


def test_scope_keeps_the_unknown_and_drops_the_known(spark):
    keep = lambda place: value(spark, geo.in_scope(F.lit(place), ["italy", "spain"]))
    assert keep("Turin, Italy") and keep("Somewhere") and keep("Basel Area")
    assert not keep("Belgrade, Serbia") and not keep("Austin, TX")


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("We hire in Spain, Portugal or the United Kingdom.", ["the UK", "Spain", "Portugal"]),
        ("Join us! Most of us love US cinema.", ["the US"]),
        ("ALL ABOUT US AND OUR TEAM", []),
        ("tell us more about us", []),
        ("US-based or (uk) citizens", ["the UK", "the US"]),
        ("people in the us and in uk", ["the UK", "the US"]),
        ("Ukraine, Indiana and Swedenborg", []),
        ("HOLLAND and the Netherlands", ["the Netherlands"]),
        ("", []),
    ],
)
def test_named_countries(said, want):
    assert geo.named_countries(said) == want


@pytest.mark.parametrize(("country", "hint", "want"), [("italy", 2, 1), ("norway", 1, 3), ("san marino", None, 2), (None, 4, 4), (None, None, None), ("ukraine", 3, None)])
def test_tier(spark, country, hint, want):
    assert value(spark, geo.provisional_tier(F.lit(country).cast("string"), F.lit(hint).cast("int"))) == want


def test_scope_rejects_a_typo():
    with pytest.raises(ValueError, match="itly"):
        geo.in_scope(None, ["itly"])


@pytest.mark.parametrize(("title", "want"), [("Kiosk Developer (C++)", "C++"), ("Lead Java Person", "Java"), ("Javanese Teacher", None), ("Understaffed Bakery", None), ("staff cook", "Staff")])
def test_keyword(spark, title, want):
    assert value(spark, text.first_keyword(F.lit(title), ["C++", "Java", "Staff"])) == want


@pytest.mark.parametrize(
    ("base", "now", "stop", "empties", "want"),
    [(48, 48, "cap_hit", 0, 24), (48, 12, "cap_hit", 0, 12), (48, 40, "known_page", 0, 48), (48, 1, "error", 0, 12), (12, 12, "end_of_results", 5, 24), (48, 12, "area_cap", 0, 24), (48, 24, "stopped", 3, 24)],
)
def test_next_interval(spark, base, now, stop, empties, want):
    assert value(spark, timeutil.next_interval(F.lit(base), F.lit(now), F.lit(stop), F.lit(empties))) == want


@pytest.mark.parametrize(("ago", "want"), [(None, 86_400), (4 * 3600, 6 * 3600), (30 * 86_400, 7 * 86_400), (-3600, 7200)])
def test_window(spark, ago, want):
    now = dt.datetime(2026, 10, 1, 12)
    last = F.lit(None).cast("timestamp_ntz") if ago is None else timeutil.at(now - dt.timedelta(seconds=ago))
    assert value(spark, timeutil.window_seconds(last, timeutil.at(now))) == want


def test_days_of_the_zone(spark):
    day = lambda t: value(spark, timeutil.local_day(timeutil.at(t), "Europe/Rome"))
    assert [day(f"2026-10-23 {h}:30:00") for h in (21, 22)] == [dt.date(2026, 10, 23), dt.date(2026, 10, 24)]
    assert [day(f"2026-10-25 {h}:30:00") for h in (22, 23)] == [dt.date(2026, 10, 25), dt.date(2026, 10, 26)]


def test_open_seconds_over_a_clock_change(spark):
    # the day the clocks go back has 25 hours in Rome, of which 02:00 to 03:00 comes twice
    whole = value(spark, timeutil.open_seconds(timeutil.at("2026-10-24 22:00:00"), timeutil.at("2026-10-25 23:00:00"), 4 * 3600, 6 * 3600, "Europe/Rome"))
    assert whole == (25 - 2) * 3600


def test_backoff(spark):
    waits = [value(spark, timeutil.backoff(F.lit(n), 1800, 12 * 3600)) / 3600 for n in range(1, 8)]
    assert waits == [0.5, 1, 2, 4, 8, 12, 12]


def test_retry_after(spark):
    now = timeutil.at("2026-10-14 11:45:00")
    assert value(spark, timeutil.retry_after(F.lit("120"), now)) == 120
    assert value(spark, timeutil.retry_after(F.lit("Wed, 14 Oct 2026 11:46:30 GMT"), now)) == 90
    assert value(spark, timeutil.retry_after(F.lit("-5"), now)) == 0


def test_wilson(spark):
    bound = lambda a, n: value(spark, stats.wilson_upper(F.lit(a), F.lit(n)))
    assert bound(0, 200) < 0.02
    assert bound(10, 200) < 0.12 < bound(18, 200)
    assert bound(0, 0) == 1.0


def test_levels(spark):
    spacings = F.array(*(F.lit(float(x)) for x in (75, 50, 37.5, 30, 25, 18.75, 15, 10.7)))
    assert [round(x) if x > 2.6 else x for x in value(spark, stats.speeds(spacings))] == [1, 1.5, 2, 2.5, 3, 4, 5, 7]
    assert value(spark, stats.hold_level(spacings)) == 5
    assert value(spark, stats.run_cap(F.lit(0.75))) == 3


def test_texts(spark):
    assert value(spark, text.slugify(F.lit("AI & ML  Engineer!"), 12)) == "ai_ml_engine"
    assert value(spark, text.escape_html(F.lit("a<b>&c"))) == "a&lt;b&gt;&amp;c"
    assert value(spark, text.clean_text(F.col("t")), t="<p>a&amp;b</p> <b> c</b>") == "a&b c"
    assert value(spark, text.redact(F.lit("postgres://u:secret@h/db"))) == "postgres://u:***@h/db"
    assert value(spark, text.quote_found(F.lit("Fully-Remote role"), F.lit("a fully remote role!")))
    assert not value(spark, text.quote_found(F.lit("a"), F.lit("a")))
    assert value(spark, text.note_number(F.lit("acme_role_17.md"))) == 17
    assert value(spark, text.label_uri(F.lit("label://golden/2026/a%20b.md"))) == Row(label="golden", path="2026/a b.md")
    assert value(spark, text.label_uri(F.lit("label://golden/../x"))) is None
    assert value(spark, text.choose_canonical(F.array(F.lit("https://www.linkedin.com/jobs/view/12345"), F.lit("https://acme.com/j")))) == "https://acme.com/j"
    long = "x" * 500 + " remote work " + "y" * 500
    found = text.excerpt(long, "remote", 400)
    assert "remote" in found and len(found) <= 400
