"""Listing and search pages read back, feed addresses and waits between tries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import listing
from ..sources.tables import LEADS_SQL, NOW, events, leads, table
from .registry import query
from .replies import _CONTROL, _flat

_CREATED = f"strftime(TIMESTAMP '{NOW}' - to_hours(CAST(age_hours AS INTEGER)), '%Y-%m-%d %H:%M:%S')"


def _text(name: str) -> Column:
    """A column as markup text: white space and control characters are one space."""
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), _CONTROL, " "))
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        flat = F.replace(flat, F.lit(raw), F.lit(shown))
    return flat


def _attr(name: str, value: Column) -> Column:
    """An attribute, left out where the value is null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), value, F.lit('"')), F.lit(""))


def _digested(posts: DataFrame) -> DataFrame:
    return posts.select("id", F.md5("title").alias("title"), "author", "subreddit", "url", F.md5("body").alias("body"), "created", "score", "num_comments", "next_url")


@query(
    "listing_posts",
    f"""WITH {LEADS_SQL} SELECT 't3_' || id AS id, md5({_flat("title")}) AS title, coalesce(author, '[deleted]') AS author, coalesce(subreddit, '') AS subreddit,
 'https://www.reddit.com/r/x/comments/' || id AS url, md5(substr({_flat("body")}, 1, 5000)) AS body, {_CREATED} AS created, score,
 CASE WHEN num_comments % 4 = 1 THEN 0 ELSE num_comments END AS num_comments, CASE WHEN id % 3 > 0 THEN 'https://old.reddit.com/r/x/?after=t3_' || id END AS next_url
 FROM leads WHERE id % 13 <> 0""",
)
def listing_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post as a listing page and read back: rows without id, votes, author or count among them."""
    stamp = F.expr(f"CAST(unix_millis(CAST(timestampadd(HOUR, CAST(-age_hours AS INT), TIMESTAMP'{NOW} UTC') AS TIMESTAMP)) AS STRING)")
    n = F.when(F.col("num_comments") % 4 == 1, "comment").otherwise(F.concat(F.col("num_comments").cast("string"), F.lit(" comments")))
    html = F.concat(
        F.lit('<div class="spacer"><div class="link id thing"'), _attr("data-fullname", F.when(F.col("id") % 13 > 0, F.concat(F.lit("t3_"), "id"))),
        _attr("data-author", F.col("author")), _attr("data-subreddit", _text("subreddit")), _attr("data-score", F.col("score").cast("string")), _attr("data-timestamp", stamp),
        F.lit('><p class="title"><a class="title may-blank" href="/r/x/comments/'), F.col("id").cast("string"), F.lit('">'), _text("title"), F.lit("</a></p>"),
        F.coalesce(F.concat(F.lit('<br><a class="comments" href="#">'), n, F.lit("</a>")), F.lit("")),
        F.lit('<div class="expando"><div class="md"><p>'), _text("body"), F.lit('</p></div></div></div></div><a rel="next" href="/elsewhere">next</a>'),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit('<span class="nextprev"><a rel="nofollow next" href="/r/x/?after=t3_'), "id", F.lit('">next</a></span>'))).otherwise(""),
    )
    return _digested(listing.posts(leads(spark, sf_dir).select(F.col("id").alias("page"), html.alias("html")), listing.LISTING))


@query(
    "search_posts",
    f"""WITH {LEADS_SQL} SELECT 't3_' || id AS id, md5({_flat("title")}) AS title, coalesce(author, '[deleted]') AS author, replace(coalesce(subreddit, ''), 'r/', '') AS subreddit,
 'https://www.reddit.com/r/x/comments/' || id AS url, md5(substr({_flat("body")}, 1, 5000)) AS body, {_CREATED} AS created, CASE WHEN id % 2 = 0 THEN score END AS score,
 coalesce(num_comments, 0) AS num_comments, CASE WHEN id % 3 > 0 THEN 'https://old.reddit.com/search?after=t3_' || id END AS next_url FROM leads""",
)
def search_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post as a search page and read back; the group of communities has a pager of its own,
    and a page without groups is continued only after a post."""
    stamp = F.expr(f"date_format(timestampadd(HOUR, CAST(-age_hours AS INT), TIMESTAMP_NTZ'{NOW}'), \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\")")

    def anchor(kind: str, value: Column, href: Column | None = None) -> Column:
        return F.coalesce(F.concat(F.lit(f'<a class="{kind}" href="'), F.lit("#") if href is None else href, F.lit('">'), value, F.lit("</a>")), F.lit(""))

    row = F.concat(
        F.lit('<div class="search-result search-result-link" data-fullname="t3_'), F.col("id").cast("string"), F.lit('"'),
        _attr("data-score", F.when(F.col("id") % 2 == 0, F.col("score").cast("string"))), F.lit(">"),
        anchor("search-title may-blank", _text("title"), F.concat(F.lit("/r/x/comments/"), "id")), anchor("search-comments", F.concat(F.col("num_comments").cast("string"), F.lit(" comments"))),
        anchor("author", F.col("author")), F.lit('<time datetime="'), stamp, F.lit('">then</time>'), anchor("search-subreddit-link", F.concat(F.lit("r/"), _text("subreddit"))),
        F.lit('<div class="search-result-body"><div class="md">'), _text("body"), F.lit("</div></div></div>"),
    )
    pager = F.concat(F.lit('<a rel="nofollow next" href="/search?after=t3_'), F.col("id").cast("string"), F.lit('">next</a>'))
    others = F.lit('<div class="search-result-group"><div class="nav-buttons"><a rel="next" href="/search?after=t5_1">next</a></div></div>')
    html = (
        F.when(F.col("id") % 3 == 1, F.concat(others, F.lit('<div class="search-result-group">'), row, F.lit('<div class="nav-buttons">'), pager, F.lit("</div></div>")))
        .when(F.col("id") % 3 == 2, F.concat(row, F.lit('<a rel="next" href="?after=t5_2">more</a>'), pager))
        .otherwise(F.concat(others, row))
    )
    return _digested(listing.posts(leads(spark, sf_dir).select(F.col("id").alias("page"), html.alias("html")), listing.SEARCH))


# Bounds of the waits between tries, in seconds.
TRIES, FIRST_WAIT, LONGEST_WAIT, ROTATION_WAIT, SPREAD, LONGEST_HINT = 5, 1.0, 60.0, 5.0, 0.3, 300.0
_HEADERS = {
    "standard": "CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN '30' WHEN 2 THEN '0' WHEN 3 THEN 'soon' WHEN 4 THEN '9999' ELSE '-3' END",
    "reset": "CASE id % 4 WHEN 0 THEN '17' WHEN 1 THEN NULL WHEN 2 THEN 'x' ELSE '120.5' END",
    "class": "CASE id % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'fatal' WHEN 2 THEN 'rotate' WHEN 3 THEN 'rotate' ELSE 'backoff' END",
    "attempt": "1 + id % 7",
}


@query(
    "retry_waits",
    f"""WITH e AS (SELECT event_id AS id, {", ".join(f"{v.replace('id %', 'event_id %')} AS {k}" for k, v in _HEADERS.items())} FROM events),
h AS (SELECT *, coalesce(try_cast(standard AS DOUBLE), try_cast(reset AS DOUBLE)) AS v FROM e),
w AS (SELECT id, class, attempt, CASE WHEN v > 0 THEN least(v, 300.0) END AS hint FROM h),
d AS (SELECT *, class = 'backoff' AND hint IS NOT NULL AS told,
 CASE WHEN class = 'backoff' AND hint IS NOT NULL THEN least(hint, 60.0) WHEN class = 'rotate' THEN least(attempt, 5.0) ELSE least(power(2, attempt - 1), 60.0) END AS wait FROM w)
SELECT id AS event_id, CAST(hint AS DOUBLE) AS hint, class NOT IN ('none', 'fatal') AND attempt < 5 AS again, CAST(wait AS DOUBLE) AS wait,
 round(CAST(wait AS DOUBLE) * CASE WHEN told THEN 1.0 ELSE 0.7 END, 6) AS least, round(CAST(wait AS DOUBLE) * CASE WHEN told THEN 1.0 ELSE 1.3 END, 6) AS most FROM d""",
)
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wait before the next try and the bounds its random spread keeps to: a server's readable
    hint wins for rate limits, a changed exit waits little, everything else doubles."""
    e = events(spark, sf_dir).select("id", *(F.expr(v).alias(k) for k, v in _HEADERS.items()))
    said = F.coalesce(F.expr("try_cast(standard AS DOUBLE)"), F.expr("try_cast(reset AS DOUBLE)"))
    e = e.withColumn("hint", F.when(said > 0, F.least(said, F.lit(LONGEST_HINT))))
    told = (F.col("class") == "backoff") & F.col("hint").isNotNull()
    wait = (
        F.when(told, F.least("hint", F.lit(LONGEST_WAIT)))
        .when(F.col("class") == "rotate", F.least(FIRST_WAIT * F.col("attempt"), F.lit(ROTATION_WAIT)))
        .otherwise(F.least(FIRST_WAIT * F.pow(F.lit(2.0), F.col("attempt") - 1), F.lit(LONGEST_WAIT)))
    )
    spread = F.when(told, 0.0).otherwise(SPREAD)
    again = ~F.col("class").isin("none", "fatal") & (F.col("attempt") < TRIES)
    out = e.select("id", "hint", again.alias("again"), wait.alias("wait"), spread.alias("spread"))
    return out.select(F.col("id").alias("event_id"), "hint", "again", "wait", F.round(F.col("wait") * (1 - F.col("spread")), 6).alias("least"), F.round(F.col("wait") * (1 + F.col("spread")), 6).alias("most"))


@query(
    "feed_urls",
    """WITH s AS (SELECT DISTINCT lang, regexp_replace(trim(trim(source), '/'), '^[rR]/', '') AS name FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
g AS (SELECT lang, list(name ORDER BY name) AS names FROM s WHERE name <> '' GROUP BY lang)
SELECT lang, 'https://www.reddit.com/r/' || array_to_string(names, '+') || '/new/.rss?limit=100' AS listing,
 'https://www.reddit.com/search.rss?q=' || replace(url_encode('(' || array_to_string(list_transform(names, lambda n: 'subreddit:' || n), ' OR ') || ') AND "R&D #1 ' || lang || '"'), '%20', '+') || '&sort=new&limit=100' AS search FROM g""",
)
def feed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing and one boolean search address for all channels of a language."""
    name = F.regexp_replace(F.btrim(F.trim("source"), F.lit("/")), "^[rR]/", "")
    s = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("lang", name.alias("name")).where("name <> ''").distinct()
    g = s.groupBy("lang").agg(F.array_sort(F.collect_set("name")).alias("names"))
    asked = F.concat(F.lit("("), F.array_join(F.transform("names", lambda n: F.concat(F.lit("subreddit:"), n)), " OR "), F.lit(') AND "R&D #1 '), "lang", F.lit('"'))
    return g.select(
        "lang",
        F.concat(F.lit("https://www.reddit.com/r/"), F.array_join("names", "+"), F.lit("/new/.rss?limit=100")).alias("listing"),
        F.concat(F.lit("https://www.reddit.com/search.rss?q="), F.url_encode(asked), F.lit("&sort=new&limit=100")).alias("search"),
    )
