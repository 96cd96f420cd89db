"""Browser activity and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as tx
from caseloom.functions import times, urls
from caseloom.functions.core import blank_to_null, first_present, text
from caseloom.operators.filters import ActivityFilter, Page
from caseloom.plans.common import HOST, overview_row, union_all
from caseloom.sources.raw import SCAN_TIES

# Rows shown in the insight cards, the preview size, referral markers.
TOP_ROWS = 8
PREVIEW_BASE64 = 768 * 1024
REFERRAL_MARKERS = ["utm_source=chatgpt.com", "utm_source=gemini", "utm_source=claude"]


def browser_activity(cache: DataFrame, history_urls: DataFrame, downloads: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Cache responses, visits and downloads in one table. History tables carry their ``account`` from the file name."""
    extra = [*keys, *SCAN_TIES]
    seen = first_present("response_time", "creation_time")
    cached = cache.withColumn("_ts", seen).filter(F.col("_ts").isNotNull() & (text("url") != ""))
    size = first_present("content_length", "body_size")
    count = lambda c: F.when(~text(c).isin("", "0"), F.col(c))
    target, source = first_present("target_path", "current_path"), first_present("tab_url", "referrer", "site_url")
    amount = first_present("total_bytes", "received_bytes")
    return union_all([
        overview_row(
            cached, "BrowserActivity", extra, account=blank_to_null("account"), kind="cache", timestamp=F.col("_ts"),
            title=F.coalesce(blank_to_null(tx.last_segment("url")), F.col("url")), url=F.col("url"), mime=blank_to_null("content_type"),
            size=size, size_bytes=size, status=blank_to_null("status"), cache_key=blank_to_null("cache_key"),
            cache_body_recovered=F.when(text("body_b64") != "", "1"),
        ),
        overview_row(
            history_urls, "BrowserActivity", extra, account=F.col("account"), kind="visit",
            timestamp=times.chrome_time("last_visit_time"), title=blank_to_null("title"), url=blank_to_null(urls.url_decode("url")),
            url_raw=blank_to_null("url"), visit_count=count("visit_count"), typed_count=count("typed_count"),
        ),
        overview_row(
            downloads, "BrowserActivity", extra, account=F.col("account"), kind="download", timestamp=times.chrome_time("start_time"),
            title=blank_to_null(tx.last_segment(urls.url_decode(target))), detail=urls.url_decode(target), url=urls.url_decode(source),
            url_raw=source, source_url=urls.url_decode(source), size=tx.human_bytes(amount), size_bytes=amount,
            mime=blank_to_null("mime_type"), danger=blank_to_null("danger_type"),
        ),
    ])


def summary(activity: DataFrame, where: ActivityFilter) -> DataFrame:
    """Total, accounts and days from one grouping pass; the total is the sum over accounts, 0 without rows."""
    rows = activity.filter(where.condition()).withColumn("day", F.substring("timestamp", 1, 10))
    sets = rows.groupingSets([[F.col("account")], [F.col("day")]], F.col("account"), F.col("day"))
    counted = sets.agg(F.count(F.lit(1)).alias("count"), F.grouping("day").alias("by_account"))
    by_account = F.col("by_account") == 1
    parts = counted.select(
        F.when(by_account, "account").otherwise("day").alias("part"), F.when(by_account, F.col("account")).otherwise(F.col("day")).alias("value"), "count"
    )
    total = counted.filter(by_account).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    return parts.unionByName(total.select(F.lit("total").alias("part"), F.lit(None).cast("string").alias("value"), "count"))


def visited_domains(activity: DataFrame, account: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Visits per host. The first level groups by exact address, so each address is parsed once; kind and day filters do not apply."""
    where = ActivityFilter(account=account, start=start, end=end).condition()
    visits = activity.filter(where & (F.col("kind") == "visit") & (text("url") != ""))
    per_url = visits.groupBy("url").agg(
        F.min("_rowid").alias("r"), F.coalesce(F.sum(F.col("visit_count").try_cast("bigint")), F.lit(0)).alias("v")
    )
    return (
        per_url.withColumn("domain", urls.url_domain("url")).filter(F.col("domain").isNotNull())
        .groupBy("domain").agg(F.min("r").alias("row_id"), F.sum("v").alias("visit_count"), F.count(F.lit(1)).alias("url_count"))
    )


def domain_order() -> list[Column]:
    return [F.desc("visit_count"), F.asc("domain")]


def insights(activity: DataFrame, account: str | None = None, start: str | None = None, end: str | None = None) -> dict[str, DataFrame]:
    domains = visited_domains(activity, account, start, end)
    downloads = activity.filter(ActivityFilter(account=account, start=start, end=end).condition() & (F.col("kind") == "download"))
    return {
        "visit_total": domains.agg(F.coalesce(F.sum("visit_count"), F.lit(0)).alias("visit_total")),
        "top_domains": domains.orderBy(*domain_order()).limit(TOP_ROWS),
        "download_total": downloads.agg(F.count(F.lit(1)).alias("download_total")),
        "downloads": downloads.orderBy(F.desc("timestamp"), "_rowid").limit(TOP_ROWS),
    }


def activity_page(activity: DataFrame, where: ActivityFilter, page: Page, descending: bool = False) -> DataFrame:
    ts = F.col("timestamp")
    order = ts.desc_nulls_last() if descending else ts.asc_nulls_first()
    return page.apply(activity.filter(where.condition()), [order, F.col("_source_file"), F.col("_rowid")])


def assistant_referrals(activity: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Visits that came from a shared assistant link."""
    where = ActivityFilter(start=start, end=end).condition()
    low = F.lower(text("url"))
    hit = F.lit(False)
    for marker in REFERRAL_MARKERS:
        hit = hit | low.contains(marker)
    return activity.filter(where & hit)


def cache_list(cache: DataFrame, limit: int | None = None) -> DataFrame:
    """Cache entries with a stored body, without the body; the first ``limit`` in scan order if that is given."""
    columns = ["account", "url", "content_type", "status", "response_time", "body_size", "cache_key"]
    stored = cache.filter(text("body_b64") != "")
    return (stored if limit is None else stored.orderBy(*SCAN_TIES).limit(limit)).select(*columns)


def body_preview(cache: DataFrame, wanted: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Bounded body of exactly the wanted cache records; an empty key matches nothing."""
    ask = wanted.filter(F.trim(text("cache_key")) != "").select(*keys, "account", "url", "cache_key").distinct()
    found = cache.filter(text("body_b64") != "").join(ask, [*keys, "account", "url", "cache_key"], "left_semi")
    body = F.col("body_b64")
    shown = found.select(
        *keys, "account", "url", "cache_key", *SCAN_TIES, F.substring(body, 1, PREVIEW_BASE64).alias("body_b64"),
        urls.base64_decoded_size(F.length(body).cast("bigint"), F.right(body, F.lit(2))).alias("decoded_size"),
        (F.length(body) > PREVIEW_BASE64).alias("truncated"),
    )
    one = shown.groupBy(*keys, "account", "url", "cache_key").agg(
        F.min_by(F.struct("body_b64", "decoded_size", "truncated"), F.struct(*SCAN_TIES)).alias("b")
    )
    return one.select(*keys, "account", "url", "cache_key", "b.*")
