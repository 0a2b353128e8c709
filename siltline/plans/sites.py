"""Signals of web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import html
from ..sources.tables import table
from .registry import query

PRICE = r"[$£€₹]\s?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?"
MARKERS = (("just a moment", "challenge"), ("checking your browser", "browser check"), ("verifying you are human", "bot check"), ("access to this page has been denied", "denial page"))


@query("page_links", r"""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS href FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.parsed(table(spark, sf_dir, "pages")).select("page_id", F.explode(F.array_distinct("links")).alias("href"))


@query("page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, main text digest and labels by a real parse: script strings hold end tags here."""
    p = html.parsed(table(spark, sf_dir, "pages"))
    return p.select("page_id", "title", F.length("text").alias("n"), F.sha2("text", 256).alias("fingerprint"), F.array_join("labels", "|").alias("labels"))


@query("price_signals", f"SELECT page_id, len(regexp_extract_all(html, '{PRICE}')) AS n, coalesce(regexp_extract_all(html, '{PRICE}')[1], '') AS first FROM pages")
def price_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(f"({PRICE})"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first"))


_marks = " ".join(f"WHEN contains(lower(html[1:200000]), '{m}') THEN '{r}'" for m, r in MARKERS)


@query("block_verdicts", f"SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'hard' {_marks} WHEN NOT contains(html, '<article') THEN 'empty' ELSE 'none' END AS verdict FROM pages")
def block_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status first, then soft markers in the page's start, then missing content."""
    low = F.lower(F.substring("html", 1, 200000))
    verdict = F.when(F.col("page_id") % 17 == 0, "hard")
    for marker, reason in MARKERS:
        verdict = verdict.when(F.contains(low, F.lit(marker)), reason)
    return table(spark, sf_dir, "pages").select("page_id", verdict.when(~F.contains("html", F.lit("<article")), "empty").otherwise("none").alias("verdict"))


@query("site_identity", "SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) AS site FROM pages")
def site_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]+)", 1)).alias("site"))


@query("site_bundle", "SELECT lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) AS site, count(*) AS pages, count(DISTINCT md5(html)) AS versions, CAST(sum(len(regexp_extract_all(html, '<a '))) AS BIGINT) AS anchors FROM pages GROUP BY 1")
def site_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.lower(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]+)", 1))
    return table(spark, sf_dir, "pages").groupBy(site.alias("site")).agg(
        F.count("*").alias("pages"), F.countDistinct(F.md5("html")).alias("versions"), F.sum(F.regexp_count("html", F.lit("<a "))).alias("anchors")
    )
