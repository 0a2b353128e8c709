"""Prompt templates as rows: segments parsed as columns, the newest version of a stage, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import query

#: What a template must hold, and where its changing half starts (fixed values).
SECTIONS, BOUNDARY = ("# Role", "# Task", "# Rules", "# JSON Shape"), "\n# User\n"
SLOT = r"\{\{\s*(\w+)\s*\}\}"

_HEAD = "# Role\nReader of {{source}}.\n# Task\nRate it.\n# Rules\nOne answer.\n# JSON Shape\n```json\n{\"rate\": 1}\n```"
#: Stage, version and text of the templates at hand.
TEMPLATES = (
    ("rate", 1, f"{_HEAD}{BOUNDARY}Text {{{{doc_id}}}}: {{{{text}}}}"),
    ("rate", 2, f"{_HEAD}{BOUNDARY}Text {{{{doc_id}}}} of {{{{n_chars}}}} characters: {{{{text}}}}"),
    ("label", 9, f"{_HEAD}{BOUNDARY}{{{{text}}}}"),
    ("label", 10, f"{_HEAD}{BOUNDARY}Language {{{{lang}}}}: {{{{text}}}}"),
)


def newest(templates: DataFrame) -> DataFrame:
    """(stage, version, template) of each stage's newest version; versions are numbers."""
    return templates.groupBy("stage").agg(F.max("version").alias("version"), F.max_by("template", "version").alias("template"))


def halves(template: Column) -> tuple[Column, Column]:
    """The frozen and the changing half; without a boundary all is frozen."""
    parts = F.split(template, BOUNDARY, 2)
    space = F.lit(" \t\n\r\x0b\x0c")
    return F.trim(F.get(parts, F.lit(0)), space), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), space)


def filled(half: Column, values: Column) -> Column:
    """half with every slot's value, from a map of strings; null where one has none."""
    texts, names = F.split(half, SLOT, -1), F.regexp_extract_all(half, F.lit(SLOT), 1)
    given = F.concat(F.transform(names, lambda n: F.try_element_at(values, n)), F.array(F.lit("")))
    pieces = F.zip_with(texts, given, lambda t, v: F.concat(t, v))
    return F.when(~F.exists(given, lambda v: v.isNull()), F.array_join(pieces, ""))


def missing(template: Column, values: Column) -> Column:
    """The slots without a value, in order."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(SLOT), 1))
    return F.array_sort(F.filter(names, lambda n: F.try_element_at(values, n).isNull()))


def findings(template: Column) -> Column:
    """What is wrong with a template, as an array; empty if nothing is."""
    system, _ = halves(template)
    has = lambda text: F.contains(template, F.lit(text))
    found = [F.when(~has(s), F.lit(f"missing section {s}")) for s in SECTIONS]
    found += [F.when(~F.contains(F.lower(template), F.lit("json")), F.lit("no json")), F.when(~has("```"), F.lit("no fenced example"))]
    found += [F.when(~has(BOUNDARY), F.lit("no boundary")).when(system == "", F.lit("empty system half"))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


_rows = ", ".join(f"('{s}', {v}, '{t}')" for s, v, t in TEMPLATES)
_fill = "@"
for _name in ("source", "doc_id", "n_chars", "lang", "text"):
    _fill = f"replace({_fill}, '{{{{{_name}}}}}', coalesce(CAST({_name} AS VARCHAR), ''))"


@query(
    "rendered_prompts",
    f"""WITH t AS (SELECT stage, max(version) AS version, arg_max(template, version) AS template FROM (VALUES {_rows}) AS x(stage, version, template) GROUP BY stage),
h AS (SELECT *, trim(string_split(template, chr(10) || '# User' || chr(10))[1], chr(10) || ' ') AS s, trim(string_split(template, chr(10) || '# User' || chr(10))[2], chr(10) || ' ') AS u FROM t),
j AS (SELECT d.*, h.*, array_to_string(list_filter(['doc_id', 'lang', 'n_chars', 'source', 'text'], lambda n: contains(template, '{{{{' || n || '}}}}') AND CASE n WHEN 'doc_id' THEN doc_id IS NULL WHEN 'lang' THEN lang IS NULL WHEN 'n_chars' THEN n_chars IS NULL WHEN 'source' THEN source IS NULL ELSE text IS NULL END), ',') AS gaps
 FROM documents d JOIN h ON h.stage = CASE WHEN d.doc_id % 2 = 0 THEN 'rate' ELSE 'label' END)
SELECT doc_id, stage, version, CASE WHEN gaps = '' THEN {_fill.replace("@", "s")} END AS system, CASE WHEN gaps = '' THEN sha256({_fill.replace("@", "u")}) END AS user_sha256, CASE WHEN gaps <> '' THEN 'no value for ' || gaps END AS error FROM j""",
)
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in the newest template of its stage; one without a value for a slot is an error row."""
    templates = newest(spark.createDataFrame(TEMPLATES, "stage string, version int, template string"))
    docs = table(spark, sf_dir, "documents").withColumn("stage", F.when(F.col("doc_id") % 2 == 0, "rate").otherwise("label"))
    values = F.map_from_entries(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in ("source", "doc_id", "n_chars", "lang", "text"))))
    rows = docs.join(F.broadcast(templates), "stage").withColumn("values", values)  # a row a stage
    system, user = halves(F.col("template"))
    gaps = missing(F.col("template"), F.col("values"))
    ok = F.size(gaps) == 0
    error = F.when(~ok, F.concat(F.lit("no value for "), F.array_join(gaps, ",")))
    return rows.select("doc_id", "stage", "version", F.when(ok, filled(system, F.col("values"))).alias("system"), F.when(ok, F.sha2(filled(user, F.col("values")), 256)).alias("user_sha256"), error.alias("error"))


_lint = ", ".join(f"CASE WHEN NOT contains(t, '{s}') THEN 'missing section {s}' END" for s in SECTIONS)


@query(
    "prompt_lint",
    f"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# Role' || chr(10) || coalesce(text, '') ELSE '# Task' || chr(10) || '# Rules' || chr(10) || coalesce(text, '') || chr(10) || '# User' || chr(10) END AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([{_lint}, CASE WHEN NOT contains(lower(t), 'json') THEN 'no json' END, CASE WHEN NOT contains(t, '```') THEN 'no fenced example' END,
 CASE WHEN NOT contains(t, chr(10) || '# User' || chr(10)) THEN 'no boundary' END], lambda x: x IS NOT NULL), '; ') AS findings FROM d""",
)
def prompt_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each document's text, with one of two heads, from being a sound template."""
    text = F.coalesce("text", F.lit(""))
    template = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Role\n"), text)).otherwise(F.concat(F.lit("# Task\n# Rules\n"), text, F.lit(BOUNDARY)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(findings(template), "; ").alias("findings"))
