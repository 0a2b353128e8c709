"""Files: item files with faults, CSV that reads back as it was written, the schema that tables have."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_dir
from ..sources.tables import LEADS_SQL, leads, table
from .registry import query

_ITEM = "id string, title string, body string, score string"


def item_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, title, body, score, fault) of lines that each hold an item or an array of items as JSON.

    A missing text is empty, a missing or odd score null; a line that is no JSON, and an item
    without a whole number as its id, is a row with its fault and nothing else. Blank lines are none.
    """
    raw = F.btrim(F.col(column))
    listed = F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    items = F.from_json(listed, T.ArrayType(T.StructType.fromDDL(_ITEM)), {"mode": "PERMISSIVE"})
    # an array of numbers or a broken text parses to null or to items without any field
    rows = lines.where(raw != "").select(raw.alias("raw"), F.explode_outer(items).alias("i"))
    number = F.col("i.id").try_cast("long")
    fault = F.when(F.col("i").isNull() & (F.col("raw") != "[]"), "no items").when(F.col("i").isNotNull() & number.isNull(), "no id")
    kept = rows.where("i is not null or raw <> '[]'").withColumns({"fault": fault, "number": number})
    good = F.col("fault").isNull()
    text = lambda c: F.when(good, F.coalesce(F.col(f"i.{c}"), F.lit(""))).alias(c)
    return kept.select(F.when(good, F.col("number")).alias("id"), text("title"), text("body"), F.when(good, F.col("i.score").try_cast("long")).alias("score"), "fault")


@query(
    "item_files",
    f"""WITH {LEADS_SQL} SELECT CASE WHEN id % 13 <> 5 THEN id END AS id, CASE WHEN id % 13 <> 5 THEN title END AS title, CASE WHEN id % 13 <> 5 THEN coalesce(body, '') END AS body,
 CASE WHEN id % 13 <> 5 THEN score END AS score, CASE WHEN id % 13 = 5 THEN 'no id' END AS fault FROM leads WHERE title IS NOT NULL
UNION ALL SELECT NULL, NULL, NULL, NULL, 'no items' FROM leads WHERE id % 29 = 3 AND title IS NOT NULL""",
)
def item_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as JSON files of items and of arrays, some without ids and some lines cut off, read back."""
    path = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
    posts = leads(spark, sf_dir).where("title is not null")
    item = F.struct(F.when(F.col("id") % 13 != 5, F.col("id")).alias("id"), "title", "body", "score")
    one = posts.where("id % 2 = 0").select(F.to_json(item).alias("value"))
    arrays = posts.where("id % 2 = 1").groupBy(F.floor(F.col("id") / 16)).agg(F.to_json(F.collect_list(item)).alias("value")).select("value")
    broken = posts.where("id % 29 = 3").select(F.lit('{"id": 1, "title": ').alias("value"))
    one.union(arrays).union(broken).write.text(path)
    return item_lines(spark.read.text(path))


#: How CSV is written and read, so that every text but a null one comes back (null is told by a mark).
CSV = {"header": True, "quote": '"', "escape": '"', "quoteAll": True, "multiLine": True, "lineSep": "\n", "nullValue": "\\N", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def csv_round_trip(rows: DataFrame, path: str) -> DataFrame:
    """rows written as CSV under path, read back by their schema."""
    rows.write.options(**CSV).csv(path)
    return rows.sparkSession.read.schema(rows.schema).options(**CSV, maxCharsPerColumn=-1).csv(path)


@query(
    "csv_files",
    f"""WITH {LEADS_SQL} SELECT id, subreddit, author, title, '"' || chr(10) || coalesce(author, '') || ',' || chr(92) || '"x' AS hard, sha256(body) AS body_sha256, score FROM leads""",
)
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as CSV files and back, with line ends, quotes, commas, backslashes and nulls in them."""
    hard = F.concat(F.lit('"\n'), F.coalesce("author", F.lit("")), F.lit(',\\"x'))
    rows = leads(spark, sf_dir).select("id", "subreddit", "author", "title", hard.alias("hard"), "body", "score")
    back = csv_round_trip(rows, f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}")
    return back.select("id", "subreddit", "author", "title", "hard", F.sha2("body", 256).alias("body_sha256"), "score")


#: The columns that the tables must have (fixed values).
EXPECTED = {
    "documents": "doc_id text lang source n_chars", "labels": "doc_id quality toxic", "pages": "page_id url html", "conversations": "conv_id turn role text",
    "embeddings": "vec_id embedding label", "benchmark": "item_id text", "events": "event_id ts user_id event_type value props", "nation": "n_nationkey n_name n_regionkey",
}


def schema_faults(found: DataFrame, expected: DataFrame, optional: str) -> DataFrame:
    """(tbl, col, fault) where found and expected, both (tbl, col), differ: tables missing or not
    expected (those that start with optional may be there), and columns of tables that are in both."""
    tables = [df.select("tbl").distinct() for df in (found, expected)]
    lone = lambda a, b, fault, keys: a.join(b, keys, "left_anti").select("tbl", ("col" if "col" in keys else F.lit(None).cast("string").alias("col")), F.lit(fault).alias("fault"))
    both = lambda df: df.join(tables[0], "tbl", "left_semi").join(tables[1], "tbl", "left_semi")
    faults = [
        lone(tables[1], tables[0], "missing table", ["tbl"]), lone(tables[0], tables[1], "unexpected table", ["tbl"]).where(~F.startswith("tbl", F.lit(optional))),
        lone(both(expected), found, "missing column", ["tbl", "col"]), lone(both(found), expected, "unexpected column", ["tbl", "col"]),
    ]
    out = faults[0]
    for f in faults[1:]:
        out = out.unionByName(f)
    return out


def columns_of(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(tbl, col) of the tables' own metadata: what the catalogue's analyser finds, not a list of ours."""
    rows = [(n, f.name) for n in names for f in table(spark, sf_dir, n).schema]
    return spark.createDataFrame(rows, "tbl string, col string")


#: What the check is held against here: a table and a column that are not there, a column left out.
PLANTED = EXPECTED | {"labels": "doc_id quality toxic reviewer", "archive": "id", "pages": "page_id url"}
_tables = "documents labels pages conversations embeddings benchmark events nation region".split()
_want = ", ".join(f"('{t}', '{c}')" for t, cols in PLANTED.items() for c in cols.split())
_have = " UNION ALL ".join(f"SELECT '{t}' AS tbl, column_name AS col FROM (DESCRIBE {t})" for t in _tables)


@query(
    "schema_check",
    f"""WITH f AS ({_have}), e AS (SELECT * FROM (VALUES {_want}) AS x(tbl, col))
SELECT DISTINCT tbl, CAST(NULL AS VARCHAR) AS col, 'missing table' AS fault FROM e WHERE tbl NOT IN (SELECT tbl FROM f)
UNION ALL SELECT DISTINCT tbl, NULL, 'unexpected table' FROM f WHERE tbl NOT IN (SELECT tbl FROM e) AND NOT starts_with(tbl, 'nation')
UNION ALL SELECT tbl, col, 'missing column' FROM e WHERE tbl IN (SELECT tbl FROM f) AND (tbl, col) NOT IN (SELECT (tbl, col) FROM f)
UNION ALL SELECT tbl, col, 'unexpected column' FROM f WHERE tbl IN (SELECT tbl FROM e) AND (tbl, col) NOT IN (SELECT (tbl, col) FROM e)""",
)
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tables differ from a list of expected columns with planted differences."""
    expected = spark.createDataFrame([(t, c) for t, cols in PLANTED.items() for c in cols.split()], "tbl string, col string")
    return schema_faults(columns_of(spark, sf_dir, _tables), expected, "nation")
