"""What a page's markup says about its site: script hosts, generator and linked data.

Prose is not searched: tools are known by where scripts come from, communities by where anchors
lead, and business nodes by the JSON blocks that pages embed for machines.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hosts, each with its subdomains, and what they stand for.
SOCIAL = {
    "github.com": "github",
    "twitter.com": "twitter",
    "x.com": "twitter",
    "linkedin.com": "linkedin",
    "youtube.com": "youtube",
    "reddit.com": "reddit",
    "discord.gg": "discord",
    "discord.com": "discord",
    "slack.com": "slack",
    "facebook.com": "facebook",
    "instagram.com": "instagram",
    "news.ycombinator.com": "hackernews",
    "producthunt.com": "producthunt",
    "mastodon.social": "mastodon",
}
TOOLS = {
    "google-analytics.com": "Google Analytics",
    "googletagmanager.com": "Google Tag Manager",
    "segment.com": "Segment",
    "segment.io": "Segment",
    "mixpanel.com": "Mixpanel",
    "amplitude.com": "Amplitude",
    "hotjar.com": "Hotjar",
    "posthog.com": "PostHog",
    "plausible.io": "Plausible",
    "hubspot.com": "HubSpot",
    "hs-scripts.com": "HubSpot",
    "salesforce.com": "Salesforce",
    "pardot.com": "Pardot",
    "marketo.net": "Marketo",
    "intercom.io": "Intercom",
    "intercomcdn.com": "Intercom",
    "zendesk.com": "Zendesk",
    "drift.com": "Drift",
    "crisp.chat": "Crisp",
    "stripe.com": "Stripe",
    "paddle.com": "Paddle",
    "chargebee.com": "Chargebee",
    "shopify.com": "Shopify",
    "typeform.com": "Typeform",
    "calendly.com": "Calendly",
    "sentry.io": "Sentry",
    "cloudflareinsights.com": "Cloudflare Analytics",
    "vercel.com": "Vercel",
    "netlify.app": "Netlify",
}
NODE_TYPES = ("Organization", "Product", "Offer")
NESTED = ("@graph", "hasOfferCatalog", "offers", "itemListElement")

#: SQL of the host of an address {0}, in Spark and DuckDB alike; no host gives ''.
HOST = "lower(regexp_extract(trim({0}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"


def named_host(host: str, names: dict[str, str]) -> str:
    """SQL of what a host or its parent domain stands for; null for others."""
    return "CASE " + " ".join(f"WHEN {host} = '{d}' OR {host} LIKE '%.{d}' THEN '{n}'" for d, n in names.items()) + " END"


class _Marks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.anchors, self.scripts, self.blocks = [], [], []
        self.generator: str | None = None
        self.linked = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = {k: v or "" for k, v in attrs}
        if tag == "a" and "href" in at:
            self.anchors.append(at["href"].strip())
        elif tag == "script":
            if "src" in at:
                self.scripts.append(at["src"])
            self.linked = "ld+json" in at.get("type", "").lower()
            if self.linked:
                self.blocks.append("")
        elif tag == "meta" and at.get("name", "").lower() == "generator" and self.generator is None:
            self.generator = at.get("content", "").strip()

    def handle_endtag(self, tag: str) -> None:
        self.linked &= tag != "script"

    def handle_data(self, data: str) -> None:
        if self.linked:
            self.blocks[-1] += data


def business_nodes(blocks: Iterable[str]) -> list[str]:
    """Nodes of NODE_TYPES as JSON with sorted keys, a node before those nested in it, however deep;
    blocks that are no JSON give none."""
    out = []
    for block in blocks:
        try:
            todo = [json.loads(block)]
        except (ValueError, RecursionError):
            continue
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += reversed(node)
            elif isinstance(node, dict):
                kinds = node.get("@type")
                if any(k in NODE_TYPES for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)):
                    out.append(json.dumps(node, sort_keys=True, ensure_ascii=False))
                todo += [node[k] for k in reversed(NESTED) if k in node]
    return out


def marks(pages: DataFrame) -> DataFrame:
    """page_id, anchors, scripts, generator and nodes of every page (page_id, html); null has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b["page_id"], b["html"]):
                m = _Marks()
                m.feed(html or "")
                m.close()
                rows.append((page, m.anchors, m.scripts, m.generator or None, business_nodes(m.blocks)))
            yield pd.DataFrame(rows, columns=["page_id", "anchors", "scripts", "generator", "nodes"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, anchors array<string>, scripts array<string>, generator string, nodes array<string>")


def platform(url: str) -> Column:
    """The community a URL column leads to; null for other hosts."""
    return F.expr(named_host(f"regexp_replace({HOST.format(url)}, '^www[.]', '')", SOCIAL))


def tools(scripts: str, generator: str) -> Column:
    """Distinct tools of script addresses, then the generator, in the order first seen."""
    by_host = F.expr(f"filter(transform({scripts}, s -> {named_host(HOST.format('s'), TOOLS)}), t -> t IS NOT NULL)")
    return F.array_distinct(F.concat(by_host, F.filter(F.array(generator), lambda g: g.isNotNull())))
