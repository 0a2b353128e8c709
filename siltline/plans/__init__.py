"""Plans of the analytics engine."""

# every module registers its queries when it is imported
from . import cascade, channels, crawl, desk, files, intake, labels, listings, markup, mentions, polling, prompts, records, replies, reports, runs, scoring, sections, sites, stores, streams  # noqa: F401
