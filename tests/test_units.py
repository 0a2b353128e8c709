"""Vocabulary and edge cases that the tables do not hold, on literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltline.functions import text
from siltline.operators import features, latest, rules, sketch
from siltline.sources import html, listing, markup


def value(spark, column, **row):
    names = list(row) or ["x"]
    schema = ", ".join(f"{n} {'string' if isinstance(v, (str, type(None))) else 'double'}" for n, v in row.items()) or "x int"
    return spark.createDataFrame([tuple(row.values()) or (1,)], schema).select(column.alias("v")).first().v if names else None


def test_edit_lines_and_hash(spark):
    f = text.dedup_normal(F.col("t"))
    assert value(spark, f, t="Hello  *World*\nEDIT: typo\nmore") == "hello world"
    assert value(spark, f, t="Update on my CRM") == ""
    assert value(spark, f, t="Straße") == "strasse"
    assert value(spark, f, t=None) == ""
    h = text.content_hash(F.col("a"), F.col("b"))
    assert value(spark, h, a="ab", b="c") != value(spark, h, a="a", b="bc")


def test_shingles(spark):
    f = text.shingles(F.col("t"))
    assert value(spark, f, t="") == [] and value(spark, f, t="abc") == ["abc"]
    assert sorted(value(spark, f, t="abcdefé")) == ["abcde", "bcdef", "cdefé"]


def test_redaction(spark):
    f = text.redact(F.col("t"))
    assert value(spark, f, t='api_key = "abcdef123"') == 'api_key = "[REDACTED]"'
    assert value(spark, f, t="Bearer abcdefghijklmnopqrst") == "Bearer [REDACTED]"
    assert value(spark, f, t="plain words") == "plain words"


def test_rules(spark):
    author, title = rules.check_author(F.col("a")), rules.check_structural(F.col("t"))
    for a, want in (("[deleted]", "deleted"), ("AutoModerator", "known_bot"), ("XyzBot", "bot_suffix"), ("a_bot", "bot_suffix"), ("robot", None), (None, None), (" ", None)):
        assert value(spark, author, a=a) == want
    for t, want in (("[Hiring] dev", "hiring"), ("Our hiring process is broken", None), ("AMA: me", "ama"), ("Amazon tools", None), ("use code X1", "promo")):
        assert value(spark, title, t=t) == want
    assert value(spark, title, t=" " * 100000) is None
    assert value(spark, rules.check_negative(F.col("t"), ("free trial", "spam")), t="a FREE-trial!") == "free trial"


def test_features(spark):
    q = features.question(F.col("t"))
    assert [value(spark, q, t=t) for t in ("How do I", "so?", "however")] == [1.0, 1.0, 0.0]
    e = features.engagement(F.col("s"), F.col("c"))
    df = spark.createDataFrame([(None, None), (50, None), (None, 100), (100, 0)], "s int, c int")
    assert [r.v for r in df.select(e.alias("v")).collect()] == [0.0, 0.5, 1.0, 0.5]
    assert value(spark, text.unit(F.lit(float("nan")))) == 0.0


def test_questions_end_at_whole_words(spark):
    import duckdb

    from siltline.plans.scoring import FEATURES_SQL

    pattern = FEATURES_SQL.split("regexp_matches(title, ")[1].split(") THEN")[0]
    cases = {"Doías adomi": 0.0, "do it": 1.0, "Do": 1.0, "do_it": 0.0, "do²": 0.0, "do-it": 1.0, "\u3000how so": 1.0, "\x0bhow so": 1.0, "\u017fhould we": 1.0, "looking\xa0for advice": 1.0, "é?": 1.0, "is漢": 0.0}
    q = features.question(F.col("t"))
    assert {t: value(spark, q, t=t) for t in cases} == cases
    assert {t: float(duckdb.execute(f"SELECT regexp_matches(?, {pattern})", [t]).fetchone()[0]) for t in cases} == cases


def test_signatures():
    orders = sketch.probe_orders()
    a, b = sketch.signature("the quick brown fox jumps", orders), sketch.signature("the quick brown fox jumped", orders)
    assert sketch.signature("", orders) is None and len(a) == 128 and min(a) >= 0
    assert np.mean(np.array(a) == np.array(b)) > 0.5 and sketch.choose_bands(128, 0.85) == 8


def test_pages():
    title, body, links, labels = html.read_page('<title>A &amp; b</title><script>var t="</p>";</script><nav><a href="/x">Home</a></nav><p>One<br>two')
    assert (title, body, links, labels) == ("A & b", "One two", ["/x"], ["Home"])
    assert html.read_page(None) == ("", "", [], [])
    assert html.priority_rank("/pricing/x") == 0 and html.priority_rank("/blog") is None


def test_first_wins_and_new_rows(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "id int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "id int, v string")
    assert sorted(map(tuple, latest.first_wins(a, b, "id").collect())) == [(1, "a"), (2, "a"), (3, "b")]
    assert [r.id for r in latest.new_rows(b, a, "id", F.col("v")).collect()] == [3]


FEED = '<feed xmlns="http://www.w3.org/2005/Atom">{}</feed>'


def test_feed_entries():
    from siltline.sources import atom

    good = (
        '<entry><author><name>/u/ann</name></author><content type="html">&lt;div class="md"&gt;&lt;p&gt; a &amp;amp; b&lt;/p&gt;'
        "&lt;p&gt;c &lt;/p&gt;&lt;/div&gt;submitted by ann</content><id>t3_Ab1</id>"
        '<link href="https://old.reddit.com/r/SaaS/x?y=1"/><updated>2026-01-01T00:00:00Z</updated><published>2026-08-08T11:20:00+02:00</published><title>T</title></entry>'
    )
    bare = "<entry><id>t3_z</id></entry>"
    rows = atom.read_feed(FEED.format(good + "<entry><id>none</id></entry>" + bare))
    assert [r["id"] for r in rows] == ["t3_Ab1", "t3_z"]
    assert rows[0]["body"] == "a & bc" and rows[0]["author"] == "ann" and rows[0]["subreddit"] == "SaaS"
    assert rows[0]["url"] == "https://www.reddit.com/r/SaaS/x?y=1" and rows[0]["created"] == "2026-08-08 09:20:00"
    assert (rows[1]["author"], rows[1]["body"], rows[1]["created"], rows[1]["url"]) == ("[deleted]", "", None, "")
    assert atom.read_feed(FEED.format("")) == []
    for bad in ("<feed", "<rss/>", "<!DOCTYPE x><feed/>"):
        with pytest.raises(atom.FeedError):
            atom.read_feed(bad)


def test_json_object():
    from siltline.operators.replies import json_object

    assert json_object('{"a": "}"}') == '{"a": "}"}'
    assert json_object('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert json_object('so: {"a": {"b": 2}} and {more') == '{"a": {"b": 2}}'
    for none in (None, "", "no", '{"a": 1', "{a}"):
        assert json_object(none) is None


def test_listing_rows():
    page = """<div class="thing link" data-fullname="t3_a" data-score="-7" data-timestamp="1000"><a class="title" href="/r/x/1"> A <b>b</b></a>
      <a class="comments">12 comments</a><div class="expando"><div class="md"> one <p>two</p></div></div><div class="md">no</div></div>
      <div class="thing link" data-fullname="t3_b" data-score="x" data-author=""><a class="comments">comment</a><time datetime="2026-01-02T03:04:05+01:00">t</time></div>
      <div class="thing link"><a class="title">no id</a></div><div class="thing">no row</div><div class="thing link" data-fullname="t3_c">
      <span class="nextprev"><a rel="prev" href="/p"></a><a rel="nofollow next" href="?after=t3_c">next</a></span>"""
    a, b, c = listing.read_rows(page, listing.LISTING)
    assert (a["title"], a["url"], a["score"], a["num_comments"], a["body"], a["created"]) == ("Ab", "https://www.reddit.com/r/x/1", -7, 12, "onetwo", "1970-01-01 00:00:01")
    assert (b["author"], b["score"], b["num_comments"], b["created"]) == ("", None, 0, "2026-01-02 02:04:05")
    assert (c["author"], c["num_comments"], c["created"], c["title"]) == ("[deleted]", None, None, "")
    assert {r["next_url"] for r in (a, b, c)} == {"https://old.reddit.com?after=t3_c"}
    assert listing.read_rows(None, listing.LISTING) == listing.read_rows("<div class='thing link'", listing.LISTING) == []


def test_search_rows():
    row = '<div class="search-result-link" data-fullname="t3_a"><a class="search-title" href="https://h/x">T</a><a class="search-subreddit-link">r/y</a></div>'
    other = '<div class="search-result-group"><div class="nav-buttons"><a rel="next" href="/s?after=t5_1"></a></div></div>'
    (a,) = listing.read_rows(other + row, listing.SEARCH)
    assert (a["author"], a["subreddit"], a["num_comments"], a["score"], a["url"], a["next_url"]) == ("[deleted]", "y", 0, None, "https://h/x", None)
    (a,) = listing.read_rows(f'{other}<div class="search-result-group">{row}<div class="nav-buttons"><a rel="next" href="/s?count=9"></a></div></div>', listing.SEARCH)
    assert a["next_url"] == "https://old.reddit.com/s?count=9"
    (a,) = listing.read_rows(f'{row}<a rel="next" href="?after=t5_1"></a><a rel="next" href="/q?after=t3_9"></a>', listing.SEARCH)
    assert a["next_url"] == "https://old.reddit.com/q?after=t3_9"


def test_business_nodes():
    deep = '{"@graph": ' * 400 + '{"@type": "Offer"}' + "}" * 400
    assert markup.business_nodes(["{", "", "[1, null]", '{"@type": ["X", "Offer"]}', '{"about": {"@type": "Offer"}}']) == ['{"@type": ["X", "Offer"]}']
    assert markup.business_nodes([deep]) == ['{"@type": "Offer"}']


def test_marks(spark):
    rows = [(1, None), (2, ""), (3, "<script type='application/LD+json'>{\"@type\": \"Offer\"}</script><a href=' https://m.youtube.com/c '>y</a><script src='//x.segment.io/a'></script>")]
    got = markup.marks(spark.createDataFrame(rows, "page_id long, html string"))
    got = got.select("page_id", F.transform("anchors", lambda a: a).alias("a"), markup.tools("scripts", "generator").alias("t"), "nodes")
    assert [tuple(r) for r in got.orderBy("page_id").collect()] == [(1, [], [], []), (2, [], [], []), (3, ["https://m.youtube.com/c"], ["Segment"], ['{"@type": "Offer"}'])]
    urls = spark.createDataFrame([("https://m.youtube.com/c",), ("https://notyoutube.com",), ("HTTPS://WWW.X.COM",), ("/x.com",), (None,)], "url string")
    assert [r[0] for r in urls.select(markup.platform("url")).collect()] == ["youtube", None, "twitter", None, None]
