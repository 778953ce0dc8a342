"""Feeds of postings as JSON, and walks over their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import clean_text

FIRST = "struct<public_slug:string,source:string,external_id:string,url:string,title:string,company:string,location:string,description:string,countries:array<string>,regions:array<string>,work_mode:string,posted_at:string,created_at:string,closed_at:string,reality:struct<class:string>>"
SECOND = "struct<guid:string,title:string,companyName:string,locationRestrictions:array<string>,timezoneRestrictions:array<double>,description:string,excerpt:string,pubDate:string,expiryDate:string,applicationLink:string>"


def moment(text: Column) -> Column:
    """A time from epoch seconds or ISO text; null if it is neither."""
    return F.coalesce(F.timestamp_seconds(text.try_cast("bigint")), F.try_to_timestamp(text))


def first_feed(raw: DataFrame, column: str = "json", skip: tuple[str, ...] = ("evergreen",)) -> DataFrame:
    """Cards of the first feed's items: closed, evergreen and incomplete ones are left out, malformed ones too."""
    i = raw.select(F.from_json(column, FIRST).alias("i")).select("i.*")
    whole = F.col("public_slug").isNotNull() & F.col("url").isNotNull() & F.col("title").isNotNull() & F.col("company").isNotNull()
    live = F.col("closed_at").isNull() & ~F.coalesce(F.col("reality.class").isin(*skip), F.lit(False))
    return i.filter(whole & live).select(
        F.lit("first").alias("source"), F.col("public_slug").alias("job_id"), "url", clean_text("title").alias("title"), clean_text("company").alias("company"),
        F.coalesce("location", F.lit("N/A")).alias("location"), F.try_element_at("countries", F.lit(1)).alias("country_code"), F.col("work_mode").alias("remote_hint"),
        F.coalesce(moment(F.col("posted_at")), moment(F.col("created_at"))).alias("posted_at"), clean_text("description").alias("description"),
    )


def second_feed(raw: DataFrame, now: Column, countries: list[str], offsets: list[float], column: str = "json") -> DataFrame:
    """Cards of the second feed's items that are not expired and open to one of the countries or UTC offsets; no restriction is open to all."""
    i = raw.select(F.from_json(column, SECOND).alias("i")).select("i.*")
    whole = F.col("guid").isNotNull() & F.col("title").isNotNull() & F.col("companyName").isNotNull() & F.col("applicationLink").isNotNull()
    free = lambda c: F.coalesce(F.size(c) == 0, F.lit(True))
    open_to = (free("locationRestrictions") | F.arrays_overlap("locationRestrictions", F.array(*map(F.lit, countries)))) & (free("timezoneRestrictions") | F.arrays_overlap("timezoneRestrictions", F.array(*(F.lit(float(x)) for x in offsets))))
    live = F.coalesce(moment(F.col("expiryDate")) > now, F.lit(True))
    return i.filter(whole & live & open_to).select(
        F.lit("second").alias("source"), F.col("guid").alias("job_id"), F.col("applicationLink").alias("url"), clean_text("title").alias("title"), clean_text("companyName").alias("company"),
        F.coalesce(F.array_join("locationRestrictions", ", "), F.lit("")).alias("location"), moment(F.col("pubDate")).alias("posted_at"), F.coalesce(clean_text("description"), clean_text("excerpt")).alias("description"),
    )


def walk_stops(pages: DataFrame, cap: int, known_row: int = 3, refused_row: int = 3) -> DataFrame:
    """Per walk: pages until its stop and why it stops, from a log of its pages in order.

    pages: walk, n, cards, known, outcome (ok, refused, error), area_cap (or null). A page counts as known if all
    its cards are and it is as wide as the widest so far; refused pages are no pages.
    """
    w = Window.partitionBy("walk").orderBy("n")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("outcome") == "ok"
    p = pages.withColumns({"page": F.count_if(ok).over(so_far), "widest": F.max(F.when(ok, F.col("cards"))).over(so_far)})
    known = ok & (F.col("known") == F.col("cards")) & (F.col("cards") >= F.col("widest")) & (F.col("cards") > 0)
    # a run: how many there have been, less how many there were where it last broke off; all windows have one order
    p = p.withColumns({"_known": F.count_if(known).over(so_far), "_refused": F.count_if(F.col("outcome") == "refused").over(so_far)})
    run = lambda flag, n, end: F.when(flag, F.col(n) - F.coalesce(F.max(F.when(end, F.col(n))).over(so_far), F.lit(0))).otherwise(0)
    p = p.withColumns({"known_run": run(known, "_known", ok & ~known), "refused_run": run(F.col("outcome") == "refused", "_refused", F.col("outcome") != "refused")})
    limit = F.least(F.coalesce("area_cap", F.lit(cap)), F.lit(cap))
    at_cap = ok & (F.col("page") >= limit)
    stop = (
        F.when(F.col("outcome") == "error", "error")
        .when(F.col("refused_run") >= refused_row, F.when(F.col("widest").isNull(), "throttled_empty").otherwise("rate_limited"))
        .when(ok & (F.col("cards") == 0), "end_of_results")
        .when(F.col("known_run") >= known_row, "known_page")
        .when(at_cap & (F.col("cards") < F.col("widest")), "end_of_results")
        .when(at_cap & (F.coalesce("area_cap", F.lit(cap)) < cap), "area_cap")
        .when(at_cap, "cap_hit")
    )
    found = p.withColumn("stop", stop).groupBy("walk").agg(F.count_if(ok).alias("pages"), F.min(F.when(F.col("stop").isNotNull(), F.struct("n", "stop", "page"))).alias("s"))
    return found.select("walk", F.coalesce("s.page", "pages").alias("pages"), F.coalesce("s.stop", F.lit("stopped")).alias("stop_reason"))
