"""Sinks, membership, item and CSV files, templates and the schema check on literals."""

import pytest
from pyspark.sql import functions as F

from siltline.plans import files, prompts
from siltline.sources import runs


def test_a_run_that_ends_between_tables_is_not_seen(spark, tmp_path):
    base = str(tmp_path)
    one, two = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(3,)], "id long")
    assert runs.write_run(spark, base, "a", {"groups": one, "members": two}) == {"groups": 2, "members": 1}
    broken = two.withColumn("id", F.raise_error(F.lit("lost")).cast("long"))
    for run in ("a", "b"):
        with pytest.raises(Exception, match="lost"):
            runs.write_run(spark, base, run, {"groups": two, "members": broken})
    seen = lambda name: sorted((r.run, r.id) for r in runs.read_run(spark, base, name).collect())
    assert seen("groups") == [("a", 1), ("a", 2)] and seen("members") == [("a", 3)]
    runs.write_run(spark, base, "a", {"groups": two, "members": one})
    runs.write_run(spark, base, "b", {"groups": two.limit(0), "members": one})
    assert seen("groups") == [("a", 3)] and seen("members") == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_a_member_of_two_groups_stops_the_job(spark):
    good = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "grp long, id long")
    assert runs.one_group_each(good, "id", "grp").count() == 3
    assert runs.one_group_each(good.limit(0), "id", "grp").count() == 0
    with pytest.raises(ValueError, match="1 members are in several groups, such as 3"):
        runs.one_group_each(good.union(spark.createDataFrame([(1, 3)], good.schema)), "id", "grp")


def test_item_lines(spark):
    lines = [
        '{"id": 1, "title": "a", "score": 4}', ' [{"id": "2", "body": "x"}, {"title": "no id"}, {"id": 3, "score": "many"}]', "", "  ", "[]", "{", '{"id": 1.5}', "plain", '[{"id": 4}',
    ]
    got = files.item_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    rows = sorted(((r.id, r.title, r.body, r.score, r.fault) for r in got), key=str)
    good = [(1, "a", "", 4, None), (2, "", "x", None, None), (3, "", "", None, None)]
    assert [r for r in rows if r[0]] == good
    # "no id" and 1.5 have no whole number; "{", "plain" and the array without its end are no items
    assert sorted(r[4] for r in rows if not r[0]) == ["no id"] * 2 + ["no items"] * 3
    assert all(r[:4] == (None,) * 4 for r in rows if r[4])


def test_csv_comes_back(spark, tmp_path):
    hard = ["", " a ", 'say "x"', '"', '""', "a,b", "line\nend", "\n", "\\", '\\"', "\\\\N", "tab\t", "é漢🎈", "#", None, '",\n"', "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(hard)), "i int, t string")
    assert {r.i: r.t for r in files.csv_round_trip(df, f"{tmp_path}/c").collect()} == dict(enumerate(hard))


def test_templates(spark):
    rows = [("a", 2, "two"), ("a", 10, "ten {{ x }}{{y}}\n# User\n {{x}}"), ("b", 1, "all {{z}}")]
    new = {r.stage: r for r in prompts.newest(spark.createDataFrame(rows, "stage string, version int, template string")).collect()}
    assert (new["a"].version, new["b"].version) == (10, 1)
    df = spark.createDataFrame([(rows[1][2], {"x": "$1 {{y}}", "y": "\\"}), (rows[2][2], {"x": "1"}), ("plain", {})], "t string, v map<string,string>")
    system, user = prompts.halves(F.col("t"))
    got = df.select(prompts.filled(system, F.col("v")).alias("s"), prompts.filled(user, F.col("v")).alias("u"), prompts.missing(F.col("t"), F.col("v")).alias("m")).collect()
    assert [(r.s, r.u, r.m) for r in got] == [("ten $1 {{y}}\\", "$1 {{y}}", []), (None, "", ["z"]), ("plain", "", [])]


def test_template_findings(spark):
    whole = "# Role\n# Task\n# Rules\n# JSON Shape\n```\n# User\nx"
    texts = [whole, "# Role", "\n# User\njson ```", ""]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(prompts.findings(F.col("t")).alias("f")).collect()]
    assert got[0] == [] and got[1] == ["missing section # Task", "missing section # Rules", "missing section # JSON Shape", "no json", "no fenced example", "no boundary"]
    assert got[2][-1] == "empty system half" and len(got[3]) == 7


def test_schema_faults(spark):
    of = lambda text: spark.createDataFrame([tuple(x.split(".")) for x in text.split()], "tbl string, col string")
    got = files.schema_faults(of("a.x a.y b.x vec_1.x new.x"), of("a.x a.z b.x gone.x"), "vec_")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("gone", None, "missing table"), ("new", None, "unexpected table"), ("a", "z", "missing column"), ("a", "y", "unexpected column")], key=str)
