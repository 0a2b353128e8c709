"""Sites: checked addresses, links worth a request, joined texts, cached bodies and threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.latest import running
from ..sources import html, threads
from ..sources.shared import written
from ..sources.tables import table
from .listings import _text
from .registry import query
from .replies import _flat

#: Addresses as people type them: bare hosts, other schemes, capitals and fragments among them.
_TYPED = """CASE page_id % 6 WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN concat('ftp', substr(url, 5)) WHEN 3 THEN concat(' ', upper(substr(url, 1, 12)), substr(url, 13), '#x ')
 WHEN 4 THEN '   ' WHEN 5 THEN 'https:///nohost' ELSE url END"""


def checked_url(raw: Column) -> Column:
    """http or https address with a lower-case host, a path and no fragment; https where no scheme
    is given, null for other schemes and addresses without a host."""
    t = F.btrim(raw)
    t = F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), t).otherwise(F.concat(F.lit("https://"), t))
    scheme = F.lower(F.regexp_extract(t, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    net = F.lower(F.regexp_extract(t, "^[^:]*://([^/?#]*)", 1))
    path, ask = F.regexp_extract(t, "^[^:]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(t, "^[^?#]*([?][^#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(net, "^.*@", ""), ":[0-9]*$", "")
    good = (F.btrim(raw) != "") & scheme.isin("http", "https") & (host != "")
    return F.when(good, F.concat(scheme, F.lit("://"), net, F.when(path == "", "/").otherwise(path), F.when(ask == "?", "").otherwise(ask)))


@query(
    "checked_urls",
    f"""WITH r AS (SELECT page_id, trim({_TYPED}) AS raw FROM pages), t AS (SELECT page_id, raw, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN raw ELSE 'https://' || raw END AS t FROM r),
p AS (SELECT page_id, raw, lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(t, '^[^:]*://([^/?#]*)', 1)) AS net, regexp_extract(t, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(t, '^[^?#]*([?][^#]*)', 1) AS ask FROM t)
SELECT page_id, CASE WHEN raw <> '' AND scheme IN ('http', 'https') AND net <> '' THEN scheme || '://' || net || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN ask = '?' THEN '' ELSE ask END END AS url FROM p""",
)
def checked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", checked_url(F.expr(_TYPED)).alias("url"))


#: Anchors that the given pages lack, by an arithmetic of the page's id.
_ANCHORS = """concat('<a href="/pricing', CASE page_id % 3 WHEN 0 THEN '?ref=nav' WHEN 1 THEN '#plans' ELSE '/enterprise' END, '">p</a><a href="/about-us">a</a><a href="/about-us#team">a</a>',
 CASE WHEN page_id % 4 = 1 THEN '<a href="https://elsewhere.example/features">x</a><a href="/features">f</a>' ELSE '<a href="mailto:a@b.c">m</a><a href="/blog/pricing">b</a>' END)"""
MOST_LINKS = 3
_rank = "CASE " + " ".join(f"WHEN p = '{p}' OR starts_with(p, '{p}/') OR starts_with(p, '{p}-') THEN {i}" for i, p in enumerate(html.PRIORITY_PATHS)) + " END"


@query(
    "priority_links",
    f"""WITH h AS (SELECT page_id, url AS base, unnest(regexp_extract_all(concat(html, {_ANCHORS}), '<a href="([^"]*)"', 1)) AS href FROM pages),
b AS (SELECT page_id, base, href, regexp_extract(base, '^[a-z]+://[^/?#]+', 0) AS site FROM h WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)')),
r AS (SELECT page_id, base, site, CASE WHEN starts_with(href, '/') THEN site || href ELSE href END AS url FROM b),
c AS (SELECT DISTINCT page_id, regexp_extract(url, '^[^?#]*', 0) AS url, base, lower(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/')) AS p FROM r WHERE starts_with(url, site)),
k AS (SELECT page_id, url, {_rank} AS rank FROM c WHERE rtrim(url, '/') <> rtrim(base, '/'))
SELECT page_id, url, CAST(place AS BIGINT) AS place FROM (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY rank, url) AS place FROM k WHERE rank IS NOT NULL) WHERE place <= {MOST_LINKS}""",
)
def priority_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the page's own host whose path starts like one worth reading, the best three."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", F.expr(_ANCHORS)).alias("html"))
    links = html.own_links(pages).select("page_id", F.explode("links").alias("url"), "base").distinct()
    path = F.lower(F.rtrim(F.regexp_extract("url", "^[a-z]+://[^/?#]+(.*)$", 1), F.lit("/")))
    ranks = [F.when((path == p) | path.startswith(p + "/") | path.startswith(p + "-"), i) for i, p in enumerate(html.PRIORITY_PATHS)]
    links = links.withColumn("rank", F.coalesce(*ranks)).where(F.col("rank").isNotNull() & (F.rtrim("url", F.lit("/")) != F.rtrim("base", F.lit("/"))))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("rank", "url"))  # one page's links
    return links.select("page_id", "url", place.cast("long").alias("place")).where(F.col("place") <= MOST_LINKS)


MOST_CHARS = 20_000


@query("site_texts")
def site_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's page texts in page order, joined by an empty line and cut at 20,000 characters."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]+)", 1)).alias("site"))
    texts = html.parsed(table(spark, sf_dir, "pages")).where("text <> ''").join(pages, "page_id").select("site", "page_id", "text")
    return joined_texts(written(texts, "page_texts"), MOST_CHARS).select("site", F.length("text").alias("n"), F.sha2("text", 256).alias("fingerprint"))


def joined_texts(texts: DataFrame, most: int) -> DataFrame:
    """(site, text): only pages that begin within the first characters are gathered. Where a page begins
    is found in two levels, within 4,096 page ids and over a site's such ranges, so no task orders a large site."""
    size = F.length("text") + 2
    placed = running(texts, ["site"], F.floor(F.col("page_id") / 4096), ["page_id"], end=size)
    used = placed.where(F.col("end") - size < most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_id", F.substring("text", 1, most).alias("text")))), lambda x: x.text)
    return used.groupBy("site").agg(F.substring(F.array_join(parts, "\n\n"), 1, most).alias("text"))


@query(
    "http_cache",
    """WITH b AS (SELECT md5(regexp_replace(url, '[?#].*$', '')) AS key, page_id AS stored_at, md5(html) AS body FROM pages), l AS (SELECT key, max(stored_at) AS stored_at, arg_max(body, stored_at) AS body, count(*) - 1 AS replaced FROM b GROUP BY key)
SELECT key, body, replaced, stored_at + 100 > (SELECT max(page_id) FROM pages) AS alive FROM l""",
)
def http_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest body of each address, how many it replaced, and whether it is still within its time."""
    rows = table(spark, sf_dir, "pages").select(F.md5(F.regexp_replace("url", "[?#].*$", "")).alias("key"), F.col("page_id").alias("at"), F.md5("html").alias("body"))
    newest = rows.groupBy("key").agg(F.max("at").alias("at"), F.max_by("body", "at").alias("body"), (F.count("*") - 1).alias("replaced"))
    now = rows.agg(F.max("at").alias("now"))  # one row
    return newest.join(F.broadcast(now), F.lit(True)).select("key", "body", "replaced", (F.col("at") + 100 > F.col("now")).alias("alive"))


@query(
    "snapshot_reuse",
    """WITH s AS (SELECT lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) AS site, max(page_id) FILTER (page_id % 2 = 0) AS stored, max(page_id) AS asked FROM pages GROUP BY 1)
SELECT site, CASE WHEN stored IS NULL THEN 'missing' WHEN asked - stored > 500 THEN 'expired' ELSE 'reused' END AS verdict FROM s""",
)
def snapshot_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a site's newest stored snapshot (even pages) may stand for its newest page."""
    site = F.lower(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]+)", 1))
    s = table(spark, sf_dir, "pages").groupBy(site.alias("site")).agg(F.max(F.when(F.col("page_id") % 2 == 0, F.col("page_id"))).alias("stored"), F.max("page_id").alias("asked"))
    verdict = F.when(F.col("stored").isNull(), "missing").when(F.col("asked") - F.col("stored") > 500, "expired").otherwise("reused")
    return s.select("site", verdict.alias("verdict"))


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, html): every conversation turn as the page of a post with one comment and a reply to it."""
    score = F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.concat(F.lit('<span class="score unvoted">'), (F.col("turn") - 2).cast("string"), F.lit(" points</span>")))
    author = F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.concat(F.lit('<a class="author may-blank" href="#"> '), _text("role"), F.lit(" </a>")))
    page = F.concat(
        F.lit('<div class="titlebox"><div class="usertext-body"><div class="md"> About '), "conv_id", F.lit(' </div></div></div><span class="subscribers"><span class="number">'),
        F.when(F.col("conv_id") % 3 == 0, "many").otherwise(F.format_number(F.col("conv_id") * 1001, 0)), F.lit('</span></span><div class="link thing" data-score="'),
        F.when(F.col("conv_id") % 7 == 0, "•").otherwise((F.col("turn") - 1).cast("string")), F.lit('" data-comments-count="'), F.col("turn").cast("string"),
        F.lit('"></div><div class="comment thing">'), author, score, F.lit('<div class="usertext"><div class="md"><p>'), _text("text"),
        F.lit('</p></div></div><div class="child"><div class="comment"><a class="author">reply</a><div class="usertext"><div class="md"> re: '), "turn", F.lit("</div></div></div></div></div>"),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", page.alias("html"))


_said = _flat("text")


@query(
    "thread_comments",
    f"""SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'reply' ELSE trim({_flat("role")}) END AS author, md5({_said}) AS body, CASE WHEN conv_id % 4 = 0 THEN 0 ELSE turn - 2 END AS score FROM conversations WHERE {_said} <> ''
UNION ALL SELECT conv_id, turn, 'reply', md5('re: ' || turn), 0 FROM conversations""",
)
def thread_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with a body; the first author and votes inside a comment are its own, nested ones included."""
    found = threads.read(_threads(spark, sf_dir)).select("conv_id", "turn", F.inline("comments"))
    return found.select("conv_id", "turn", "author", F.md5("body").alias("body"), "score")


@query(
    "thread_metrics",
    """SELECT conv_id, turn, CASE WHEN conv_id % 7 <> 0 THEN turn - 1 END AS score, turn AS num_comments, 'About ' || conv_id AS about, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id * 1001 END AS subscribers FROM conversations""",
)
def thread_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes and comments of a post's own page, null where unknown, and its community's box."""
    return threads.read(_threads(spark, sf_dir)).select("conv_id", "turn", "score", "num_comments", "about", "subscribers")
