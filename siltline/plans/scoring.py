"""Rules, features, pre-score, funnel and audit over the leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SECRETS, SPACE, SPACE_RE2, keyword_normal, redact, stable_hash
from ..operators import features, rules
from ..sources.tables import LEADS_SQL, leads, table
from .registry import query

#: The vocabulary of the queries: words that the tables hold.
TIERS = {"high": ("with", "this is"), "medium": ("from", "that", "and the")}
NEGATIVE = ("license", "all rights")
LEAST, WINDOW, FLOOR = 80, 30, 40.0


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[\x00-\x2F\x3A-\x5E\x60\x7B-\x7F]+', ' ', 'g'))"


def _structural_sql(patterns: tuple, text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_quoted('(?i)' + p)}) THEN {_quoted(k)}" for p, k in patterns) + " END"


_low = "lower(trim(coalesce(author, '')))"
AUTHOR_SQL = f"""CASE WHEN {_low} IN ('[deleted]', '[removed]') THEN 'deleted'
 WHEN {_low} IN ({", ".join(map(_quoted, rules.BOT_AUTHORS))}) THEN 'known_bot'
 WHEN suffix(trim(coalesce(author, '')), 'Bot') OR suffix({_low}, '_bot') OR suffix({_low}, '-bot') OR suffix({_low}, '.bot') THEN 'bot_suffix' END"""
_text = "CASE WHEN title = '' THEN body WHEN body = '' THEN title ELSE title || chr(10) || body END"
NEGATIVE_SQL = "CASE " + " ".join(f"WHEN contains({_norm('title || chr(10) || txt')}, {_quoted(t)}) THEN {_quoted(t)}" for t in NEGATIVE) + " END"
JUDGED_SQL = f"""{LEADS_SQL}, texts AS (SELECT *, {_text} AS txt FROM leads),
checks AS (SELECT *, CASE WHEN age_hours > 24 * {WINDOW} THEN 'age' END AS c1, {AUTHOR_SQL} AS c2,
  {_structural_sql(rules.STRUCTURAL, "title")} AS c3, {NEGATIVE_SQL} AS c4,
  CASE WHEN length(txt) < {LEAST} THEN length(txt) || ' < {LEAST}' END AS c5 FROM texts),
judged AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN 'out_of_window' WHEN c2 IS NOT NULL THEN 'bot_or_deleted'
  WHEN c3 IS NOT NULL THEN 'structural_noise' WHEN c4 IS NOT NULL THEN 'negative_term' WHEN c5 IS NOT NULL THEN 'too_short' END AS reason,
  coalesce(c1, c2, c3, c4, c5) AS detail FROM checks)"""


def judged(df: DataFrame) -> DataFrame:
    df = df.withColumn("verdict", rules.hard_filter(LEAST, NEGATIVE, WINDOW))
    return df.withColumn("reason", F.col("verdict.reason")).withColumn("detail", F.col("verdict.detail"))


@query("rule_author", f"WITH {LEADS_SQL} SELECT id, {AUTHOR_SQL} AS detail FROM leads")
def rule_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("id", rules.check_author(F.col("author")).alias("detail"))


@query("rule_structural", f"WITH {LEADS_SQL} SELECT id, {_structural_sql(rules.STRUCTURAL, 'title')} AS kind, {_structural_sql(rules.TRIAGE, 'title')} AS triage_kind FROM leads")
def rule_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [rules.check_structural(F.col("title"), p).alias(n) for p, n in ((rules.STRUCTURAL, "kind"), (rules.TRIAGE, "triage_kind"))]
    return leads(spark, sf_dir).select("id", *kinds)


@query("rule_cascade", f"WITH {JUDGED_SQL} SELECT id, reason, detail FROM judged")
def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(leads(spark, sf_dir)).select("id", "reason", "detail")


_hits = {t: "list_filter([" + ", ".join(_quoted(p) for p in ps) + "], lambda p: contains(norm, p))" for t, ps in TIERS.items()}


@query("keyword_tiers", f"WITH {LEADS_SQL}, n AS (SELECT id, {_norm('title || chr(10) || body')} AS norm FROM leads) SELECT id, array_to_string({_hits['high']}, ',') AS high, array_to_string({_hits['medium']}, ',') AS medium FROM n")
def keyword_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = features.tier_hits(F.concat_ws("\n", "title", "body"), TIERS)
    return leads(spark, sf_dir).select("id", *(F.array_join(h, ",").alias(t) for t, h in hits.items()))


_unit = "least(greatest({0}, 0.0), 1.0)"
FEATURES_SQL = f"""n AS (SELECT *, {_norm("title || chr(10) || body")} AS norm FROM judged),
h AS (SELECT *, len({_hits["high"]}) AS nh, len({_hits["medium"]}) AS nm FROM n),
f AS (SELECT *, CASE WHEN nh > 0 THEN 1.0 WHEN nm > 0 THEN 0.5 ELSE 0.0 END AS tier, least((nh + nm) / 3.0, 1.0) AS density,
  CASE WHEN regexp_matches(title, {_quoted("(?i)" + features.QUESTION.replace(SPACE, SPACE_RE2))}) THEN 1.0 ELSE 0.0 END AS question,
  power(0.5, age_hours / 24.0 / {WINDOW / 2}) AS recency,
  CASE WHEN score IS NULL AND num_comments IS NULL THEN 0.0 ELSE
   (CASE WHEN score IS NULL THEN 0.0 ELSE {_unit.format("score / 100.0")} END + CASE WHEN num_comments IS NULL THEN 0.0 ELSE {_unit.format("num_comments / 50.0")} END)
   / ((score IS NOT NULL)::INT + (num_comments IS NOT NULL)::INT) END AS engagement,
  CASE WHEN length(title || body) < {LEAST} THEN 0.0 ELSE {_unit.format(f"(length(title || body) - {LEAST}) / {1500 - LEAST}.0")} END AS length FROM h),
scored AS (SELECT *, 100.0 * (tier * 0.05 + density * 0.05 + question * 0.03 + recency * 0.07 + engagement * 0.05 + length * 0.03) / 0.28 AS total FROM f)"""
FEATURES_SQL = FEATURES_SQL.replace("1.0 WHEN nm", "1.0::DOUBLE WHEN nm").replace("(nh + nm) / 3.0", "(nh + nm) / 3.0::DOUBLE").replace("100.0 * (tier", "100.0::DOUBLE * (tier").replace("score / 100.0", "score / 100.0::DOUBLE").replace("num_comments / 50.0", "num_comments / 50.0::DOUBLE").replace(f"{1500 - LEAST}.0", f"{1500 - LEAST}.0::DOUBLE").replace("age_hours / 24.0", "age_hours / 24.0::DOUBLE")
_names = ("tier", "density", "question", "recency", "engagement", "length")


def scored(df: DataFrame) -> DataFrame:
    parts = features.components(TIERS, LEAST, WINDOW, "norm")
    df = df.withColumn("norm", keyword_normal(F.concat_ws("\n", "title", "body"))).withColumns(parts)
    return df.withColumn("total", features.prescore({k: F.col(k) for k in parts}))


@query("features", f"WITH {JUDGED_SQL}, {FEATURES_SQL} SELECT id, " + ", ".join(f"CAST(round({n}, 6) AS DOUBLE) AS {n}" for n in _names) + " FROM scored")
def feature_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(leads(spark, sf_dir)).select("id", *(F.round(n, 6).alias(n) for n in _names))


@query("prescore", f"WITH {JUDGED_SQL}, {FEATURES_SQL} SELECT id, CAST(round(total, 4) AS DOUBLE) AS total, reason, CASE WHEN reason IS NOT NULL THEN 'reject' WHEN total < {FLOOR} THEN 'below' ELSE 'admit' END AS decision FROM scored")
def prescores(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("reason").isNotNull(), "reject").when(F.col("total") < FLOOR, "below").otherwise("admit")
    return scored(judged(leads(spark, sf_dir))).select("id", F.round("total", 4).alias("total"), "reason", decision.alias("decision"))


_kw = lambda ks: " + ".join(f"contains(t, {_quoted(k)})::INT" for k in ks)


@query(
    "intent_score",
    f"""WITH {LEADS_SQL}, x AS (SELECT *, lower(title || ' ' || body) AS t FROM leads)
SELECT id, CAST(round(({_kw(TIERS["high"])}) * 20.0 + ({_kw(TIERS["medium"])}) * 10.0 + least(coalesce(score, 0), 100) * 0.1
 + least(coalesce(num_comments, 0), 50) * 0.2 + greatest(0, 100 - age_hours) * 5.0 / 100, 2) AS DOUBLE) AS intent FROM x""",
)
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("id", F.round(features.intent_score(TIERS["high"], TIERS["medium"]), 2).alias("intent"))


TRIAGE_SQL = f"""triaged AS (SELECT *, CASE WHEN trim(title) = '' THEN 'no_title' WHEN {_low} IN ({", ".join(map(_quoted, rules.BOT_AUTHORS))}) THEN 'bot_author'
 ELSE coalesce({_structural_sql(rules.TRIAGE, "trim(title)")}, CASE WHEN age_hours > 24 * {WINDOW} THEN 'out_of_window'
 {" ".join(f"WHEN contains(lower(trim(title)), {_quoted(t)}) THEN 'negative_term'" for t in NEGATIVE)} END) END AS t_reason FROM leads)"""


def triaged(df: DataFrame) -> DataFrame:
    reason, points = rules.triage(NEGATIVE, TIERS["high"] + TIERS["medium"], WINDOW)
    return df.withColumn("t_reason", reason).withColumn("points", points)


@query(
    "triage",
    f"""WITH {LEADS_SQL}, {TRIAGE_SQL} SELECT id, t_reason, CAST(CASE WHEN t_reason IS NULL THEN least({" + ".join(f"contains(lower(title), {_quoted(k)})::INT" for k in TIERS["high"] + TIERS["medium"])}, 5) * 20.0 ELSE 0.0 END AS DOUBLE) AS points FROM triaged""",
)
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triaged(leads(spark, sf_dir)).select("id", "t_reason", "points")


_gate = "CASE t_reason " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in rules.TO_GATE.items()) + " ELSE t_reason END"
FUNNEL_SQL = f"""WITH {JUDGED_SQL}, {FEATURES_SQL}, {TRIAGE_SQL},
stages AS (SELECT 'metadata' AS stage, {_gate} AS reason FROM triaged
 UNION ALL SELECT 'full', CASE WHEN reason IS NULL AND total < {FLOOR} THEN 'below_prescore' ELSE reason END FROM scored)
"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, reason) of every lead in the metadata and the full stage; null is admitted."""
    rows = scored(judged(triaged(leads(spark, sf_dir))))
    below = F.when(F.col("reason").isNull() & (F.col("total") < FLOOR), "below_prescore").otherwise(F.col("reason"))
    both = [F.struct(F.lit(n).alias("stage"), r.alias("reason")) for n, r in (("metadata", rules.to_gate(F.col("t_reason"))), ("full", below))]
    return rows.select(F.inline(F.array(*both)))


@query(
    "funnel_full",
    FUNNEL_SQL
    + """SELECT stage, count(*) AS collected, count(*) FILTER (reason IS NULL) AS admitted, count(reason) AS rejected,
 CAST(round((count(reason) - count(*) FILTER (reason = 'below_prescore')) / nullif(count(*), 0)::DOUBLE, 4) AS DOUBLE) AS hard_filter_rate FROM stages GROUP BY stage""",
)
def funnel_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = F.count_if(F.col("reason") == "below_prescore")
    return stages(spark, sf_dir).groupBy("stage").agg(
        F.count("*").alias("collected"),
        F.count_if(F.col("reason").isNull()).alias("admitted"),
        F.count("reason").alias("rejected"),
        F.round(F.try_divide(F.count("reason") - below, F.count("*")), 4).alias("hard_filter_rate"),
    )


REASONS = ("out_of_window", "bot_or_deleted", "structural_noise", "negative_term", "too_short", "below_prescore", "duplicate_exact", "duplicate_near", "already_analyzed", "budget_exhausted", "low_confidence")


@query(
    "gate_report",
    FUNNEL_SQL
    + f"""SELECT s.stage, r.reason, count(x.reason) AS n FROM (SELECT DISTINCT stage FROM stages) s CROSS JOIN (SELECT unnest([{", ".join(map(_quoted, REASONS))}]) AS reason) r
 LEFT JOIN stages x ON x.stage = s.stage AND x.reason = r.reason GROUP BY ALL""",
)
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every gate reason in every stage, zeros included."""
    counts = stages(spark, sf_dir).groupBy("stage").pivot("reason", list(REASONS)).count()
    return counts.unpivot("stage", list(REASONS), "reason", "n").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("funnel_rollup", FUNNEL_SQL + "SELECT coalesce(stage, '*') AS stage, CASE WHEN grouping(reason) = 1 THEN '*' ELSE coalesce(reason, 'admitted') END AS reason, count(*) AS n FROM stages GROUP BY ROLLUP (stage, reason)")
def funnel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = stages(spark, sf_dir).rollup("stage", "reason").agg(F.count("*").alias("n"), F.grouping("reason").alias("g"))
    reason = F.when(F.col("g") == 1, "*").otherwise(F.coalesce("reason", F.lit("admitted")))
    return rolled.select(F.coalesce("stage", F.lit("*")).alias("stage"), reason.alias("reason"), "n")


SAMPLE_SQL = "('0x' || substr(sha256('lead:' || id), 1, 16))::UBIGINT % 50 = 0"


def sampled(key, rate: float):
    """Whether a stable share of about rate of all keys has this key; none below 0, all from 1 on."""
    if rate <= 0:
        return F.lit(False)
    return F.lit(True) if rate >= 1 else stable_hash(key) % round(1 / rate) == 0


@query("holdout_sample", f"WITH {LEADS_SQL}, {TRIAGE_SQL} SELECT id, t_reason FROM triaged WHERE t_reason IS NOT NULL AND t_reason <> 'no_title' AND {SAMPLE_SQL}")
def holdout_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = triaged(leads(spark, sf_dir)).where(F.col("t_reason").isNotNull() & ~F.col("t_reason").isin(*rules.NEVER_SAMPLED))
    return rejected.where(sampled(F.concat(F.lit("lead:"), F.col("id").cast("string")), 0.02)).select("id", "t_reason")


@query(
    "miss_rate",
    f"""WITH {JUDGED_SQL}, {FEATURES_SQL}, {TRIAGE_SQL},
a AS (SELECT t.t_reason AS reason, (s.reason IS NULL AND s.total >= {FLOOR}) AS good FROM triaged t JOIN scored s ON s.id = t.id
 WHERE t.t_reason IS NOT NULL AND t.t_reason <> 'no_title' AND ('0x' || substr(sha256('lead:' || t.id), 1, 16))::UBIGINT % 5 = 0)
SELECT reason, count(*) AS sampled, count(*) FILTER (good) AS would_qualify, CAST(round(count(*) FILTER (good) / count(*)::DOUBLE, 4) AS DOUBLE) AS miss_rate FROM a GROUP BY reason""",
)
def miss_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a stable sample of metadata rejections, how many the full stage would admit."""
    both = scored(judged(triaged(leads(spark, sf_dir)))).where(F.col("t_reason").isNotNull() & ~F.col("t_reason").isin(*rules.NEVER_SAMPLED))
    both = both.where(sampled(F.concat(F.lit("lead:"), F.col("id").cast("string")), 0.2))
    good = F.count_if(F.col("reason").isNull() & (F.col("total") >= FLOOR))
    return both.groupBy(F.col("t_reason").alias("reason")).agg(
        F.count("*").alias("sampled"), good.alias("would_qualify"), F.round(good / F.count("*"), 4).alias("miss_rate")
    )


def _redact_sql(x: str) -> str:
    for p, to in SECRETS:
        to = to.replace("$", "\\")
        x = f"regexp_replace({x}, {_quoted(p)}, {_quoted(to)}, 'g')"
    return x


@query("redact", f"SELECT doc_id, md5(r) AS digest, r <> text AS changed FROM (SELECT doc_id, text, {_redact_sql('text')} AS r FROM documents)")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").withColumn("r", redact(F.col("text")))
    return df.select("doc_id", F.md5("r").alias("digest"), (F.col("r") != F.col("text")).alias("changed"))


@query(
    "plan_fetches",
    f"""WITH {JUDGED_SQL}, {FEATURES_SQL} SELECT id, CASE WHEN total < {FLOOR} THEN 'below_floor' WHEN id % 13 = 0 THEN 'covered' WHEN num_comments < 5 THEN 'few' ELSE 'eligible' END AS plan,
 CASE WHEN total >= {FLOOR} AND id % 13 <> 0 AND coalesce(num_comments, 5) >= 5 THEN rank() OVER (PARTITION BY total >= {FLOOR} AND id % 13 <> 0 AND coalesce(num_comments, 5) >= 5
  ORDER BY CAST(round(total, 4) AS DECIMAL(10,4)) DESC, coalesce(num_comments, 0) DESC, id) <= 100 ELSE false END AS selected FROM scored""",
)
def plan_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which leads' comments to fetch: floor, then coverage, then size; the best 100 are selected."""
    rows = scored(judged(leads(spark, sf_dir)))
    plan = (
        F.when(F.col("total") < FLOOR, "below_floor").when(F.col("id") % 13 == 0, "covered").when(F.col("num_comments") < 5, "few").otherwise("eligible")
    )
    rows = rows.withColumn("plan", plan)
    order = [F.round("total", 4).cast("decimal(10,4)").desc(), F.coalesce("num_comments", F.lit(0)).desc(), F.col("id")]
    best = rows.where("plan = 'eligible'").orderBy(*order).limit(100).select("id", F.lit(True).alias("selected"))
    return rows.select("id", "plan").join(F.broadcast(best), "id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
