"""Communities, tools and linked data of pages.

The given pages hold none of these, so every page is extended by an arithmetic of its id (SOCIAL,
SCRIPTS and LINKED below), spelled alike for Spark and for the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import markup
from ..sources.tables import table
from .registry import query

_ID = "CAST(page_id % 50 AS VARCHAR(20))"
_SOCIAL = f"""concat(CASE WHEN page_id % 3 = 0 THEN concat('<a href="https://www.linkedin.com/company/', {_ID}, '">in</a>') ELSE '<a>none</a>' END,
 CASE page_id % 4 WHEN 1 THEN concat('<a class="s" href=" https://X.com/p', {_ID}, ' ">x</a><a href=" https://X.com/p', {_ID}, ' ">again</a>') WHEN 2 THEN '<a href="https://notx.com/a">no</a>' ELSE '' END,
 CASE WHEN page_id % 5 = 2 THEN '<a href="//gist.github.com/a/b?c=x.com">g</a><a href="/x.com">no</a>' ELSE '' END)"""
_SCRIPTS = """concat(CASE page_id % 6 WHEN 0 THEN '<script src="https://js.stripe.com/v3/"></script><script async src="//www.googletagmanager.com/gtag.js"></script><script src="https://api.stripe.com/x"></script>'
 WHEN 1 THEN '<script src="/local/stripe.com.js"></script>' WHEN 2 THEN '<script src="https://cdn.segment.io/a.js"></script><script src="https://cdn.segment.com/b.js"></script>' ELSE '' END,
 CASE WHEN page_id % 7 < 3 THEN concat('<meta name="Generator" content=" Press ', CAST(page_id % 7 AS VARCHAR(20)), ' ">') ELSE '' END)"""
_LINKED = f"""concat('<script type="application/ld+json">', CASE page_id % 5
 WHEN 0 THEN concat('{{"@type": "Organization", "name": "o', {_ID}, '"}}')
 WHEN 1 THEN concat('{{"@graph": [{{"@type": "BreadcrumbList", "itemListElement": [{{"@type": ["Thing", "Product"], "name": "p', {_ID}, '", "offers": {{"@type": "Offer", "name": "f"}}}}]}}, {{"@type": "Organization", "name": "g"}}]}}')
 WHEN 2 THEN '{{"@type": "Organization", "name": ' WHEN 3 THEN concat('[[{{"@type": "Offer", "name": "</p>', {_ID}, '"}}], {{"@type": 7}}, "Offer", null]') ELSE '{{"@type": "Article", "about": {{"@type": "Product"}}}}' END, '</script>')"""


def _extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.expr(f"concat(coalesce(html, ''), {_SOCIAL}, {_SCRIPTS}, {_LINKED})")
    return markup.marks(table(spark, sf_dir, "pages").select("page_id", html.alias("html")))


@query(
    "social_links",
    f"""WITH h AS (SELECT page_id, trim(unnest(regexp_extract_all(concat(coalesce(html, ''), {_SOCIAL}), '<a [^>]*href="([^"]*)"', 1))) AS url FROM pages),
w AS (SELECT page_id, url, regexp_replace({markup.HOST.format("url")}, '^www[.]', '') AS host FROM h),
p AS (SELECT DISTINCT page_id, {markup.named_host("host", markup.SOCIAL)} AS platform, url FROM w)
SELECT * FROM p WHERE platform IS NOT NULL""",
)
def social_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each community a page links to, once, by the anchors' hosts; made within the page's row."""
    links = _extended(spark, sf_dir).select("page_id", F.explode(F.array_distinct("anchors")).alias("url"))
    return links.select("page_id", markup.platform("url").alias("platform"), "url").where("platform IS NOT NULL")


@query(
    "tech_markers",
    f"""WITH m AS (SELECT page_id, concat(coalesce(html, ''), {_SCRIPTS}) AS html FROM pages),
s AS (SELECT page_id, regexp_extract_all(html, '<script [^>]*src="([^"]*)"', 1) AS srcs, trim(regexp_extract(html, '<meta name="[gG]enerator" content="([^"]*)"', 1)) AS generator FROM m),
x AS (SELECT page_id, unnest(srcs) AS src, unnest(range(1, len(srcs) + 1)) AS i FROM s),
t AS (SELECT page_id, i, {markup.named_host(markup.HOST.format("src"), markup.TOOLS)} AS tool FROM x UNION ALL SELECT page_id, 1000000, nullif(generator, '') FROM s),
f AS (SELECT page_id, tool, min(i) AS i FROM t WHERE tool IS NOT NULL GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place, tool FROM f""",
)
def tech_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools by the hosts scripts come from, then the named generator, in the order first seen."""
    found = _extended(spark, sf_dir).select("page_id", F.posexplode(markup.tools("scripts", "generator")).alias("place", "tool"))
    return found.select("page_id", (F.col("place") + 1).cast("long").alias("place"), "tool")


@query(
    "structured_data",
    f"""SELECT page_id, CAST(place AS BIGINT) AS place, kinds, name FROM (
 SELECT page_id, 1 AS place, 'Organization' AS kinds, concat('o', {_ID}) AS name FROM pages WHERE page_id % 5 = 0
 UNION ALL SELECT page_id, 1, '["Thing","Product"]', concat('p', {_ID}) FROM pages WHERE page_id % 5 = 1
 UNION ALL SELECT page_id, 2, 'Offer', 'f' FROM pages WHERE page_id % 5 = 1
 UNION ALL SELECT page_id, 3, 'Organization', 'g' FROM pages WHERE page_id % 5 = 1
 UNION ALL SELECT page_id, 1, 'Offer', concat('</p>', {_ID}) FROM pages WHERE page_id % 5 = 3)""",
)
def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business nodes of embedded JSON: graphs, lists and offers are walked, broken blocks skipped."""
    n = _extended(spark, sf_dir).select("page_id", F.posexplode("nodes").alias("place", "node"))
    return n.select("page_id", (F.col("place") + 1).cast("long").alias("place"), F.get_json_object("node", "$.@type").alias("kinds"), F.get_json_object("node", "$.name").alias("name"))
