"""The duplicate cascade: exact hashes, character sketches, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dedup_normal, normal_hash, shingles
from ..operators import linkage, overlap, sketch, sphere
from ..operators.sphere import COSINE
from ..sources.hashed import HASHED_SQL, hashed, norm_sql
from ..sources.runs import one_group_each
from ..sources.shared import written
from ..sources.tables import LEADS_SQL, leads, table
from .registry import query

@query("content_hash", f"WITH {HASHED_SQL} SELECT id, hash FROM hashed")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).select("id", "hash")


@query("exact_groups", f"WITH {HASHED_SQL} SELECT hash, count(*) AS n, min(id) AS first, max(id) AS last FROM hashed GROUP BY hash HAVING count(*) > 1")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = hashed(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    return groups.where("n > 1")


@query(
    "representatives",
    f"""WITH {HASHED_SQL}, r AS (SELECT hash, id, row_number() OVER (PARTITION BY hash ORDER BY score DESC NULLS LAST, age_hours, id DESC) AS n, count(*) OVER (PARTITION BY hash) AS size FROM hashed)
SELECT hash, id, size FROM r WHERE n = 1 AND size > 1""",
)
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member that stands for its group: best votes, then newest, then the larger id."""
    rank = F.struct(F.col("score").isNotNull(), F.coalesce("score", F.lit(0)), -F.col("age_hours"), F.col("id"))
    groups = hashed(spark, sf_dir).groupBy("hash").agg(F.max_by("id", rank).alias("id"), F.count("*").alias("size"))
    return groups.where("size > 1")


@query(
    "duplicate_reasons",
    f"WITH {HASHED_SQL}, r AS (SELECT id, row_number() OVER (PARTITION BY hash ORDER BY id) AS n FROM hashed) SELECT CASE WHEN n > 1 THEN 'duplicate_exact' ELSE 'unique' END AS reason, count(*) AS n, CAST(round(count(*) / (SELECT count(*) FROM leads)::DOUBLE, 4) AS DOUBLE) AS rate FROM r GROUP BY 1",
)
def duplicate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapse counts from one pass: a group's further members are duplicates."""
    sizes = hashed(spark, sf_dir).groupBy("hash").count()
    total = sizes.agg(F.count("*").alias("u"), F.sum("count").alias("t"))
    rows = total.select(F.inline(F.array(
        F.struct(F.lit("unique").alias("reason"), F.col("u").alias("n"), F.round(F.col("u") / F.col("t"), 4).alias("rate")),
        F.struct(F.lit("duplicate_exact").alias("reason"), (F.col("t") - F.col("u")).alias("n"), F.round((F.col("t") - F.col("u")) / F.col("t"), 4).alias("rate")),
    )))
    return rows.where("n > 0")


@query("title_shingles", f"WITH {LEADS_SQL}, t AS (SELECT id, {norm_sql('title')} AS t FROM leads) SELECT id, CAST(CASE WHEN t = '' THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(length(t) - 4, 1) + 1), lambda i: substr(t, i, 5)))) END AS BIGINT) AS n FROM t")
def title_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads(spark, sf_dir).select("id", F.size(shingles(dedup_normal(F.col("title")))).cast("long").alias("n"))


JACCARD = 0.8


@query(
    "jaccard_pairs",
    f"""WITH {LEADS_SQL}, t AS (SELECT id, {norm_sql("title")} AS t FROM leads),
d AS (SELECT min(id) AS id, t FROM t WHERE t <> '' GROUP BY t),
s AS (SELECT id, unnest(list_distinct(list_transform(range(1, greatest(length(t) - 4, 1) + 1), lambda i: substr(t, i, 5)))) AS g FROM d),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT a, b, CAST(round(shared / (x.n + y.n - shared)::DOUBLE, 6) AS DOUBLE) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE shared / (x.n + y.n - shared)::DOUBLE >= {JACCARD}""",
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """title_pairs over whole titles."""
    return title_pairs(leads(spark, sf_dir))


def title_pairs(posts: DataFrame) -> DataFrame:
    """Distinct titles whose shingle sets have an exact Jaccard similarity of 0.8 or more.

    A pair must share one of each set's rarest shingles (the prefix filter), so frequent shingles
    never join; candidates are then measured exactly.
    """
    titles = posts.select("id", dedup_normal(F.col("title")).alias("t")).where("t <> ''")
    one = titles.groupBy("t").agg(F.min("id").alias("id"))
    # sets are far larger than texts, so texts are dealt to all tasks, however few bytes they are
    one = written(one.repartition(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id"), "titles")
    prefix = written(overlap.prefixes(one, overlap.bucket_counts(one), JACCARD), "prefix")
    pairs = overlap.candidates(prefix, JACCARD)
    texts = pairs.join(one.select(F.col("id").alias("a"), F.col("t").alias("x")), "a").join(one.select(F.col("id").alias("b"), F.col("t").alias("y")), "b")
    return overlap.measured(texts, JACCARD).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, text): one row for each distinct normalised text, keyed by its smallest id."""
    text = F.concat_ws("\n", dedup_normal(F.col("title")), dedup_normal(F.col("body")))
    return leads(spark, sf_dir).select("id", text.alias("text")).groupBy("text").agg(F.min("id").alias("key"))


@query("minhash_bands")
def minhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.band_rows(sketch.signatures(sketched(spark, sf_dir)))


@query("minhash_groups")
def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near tier alone: (key, head) of distinct texts in groups of several."""
    return linkage.near_groups(sketched(spark, sf_dir)).where("size > 1").select("key", "head")


def cascade(posts: DataFrame, cosines: DataFrame | None = None) -> DataFrame:
    """(id, grp, joined, method, similarity) of every member of a duplicate group of the three tiers.

    posts: id, title, body. Equal hashes are an exact group; single texts join groups, or open
    them, by MinHash similarity and then by cosines (a, b, cosine; ids), each only if similar to
    all members. grp is the group's smallest id, similarity the best one measured, null for
    groups that are exact only. A title and body without text take part in the exact tier alone.
    """
    normal = posts.select("id", dedup_normal(F.col("title")).alias("t"), dedup_normal(F.col("body")).alias("b"))
    text = F.concat_ws("\n", F.nullif("t", F.lit("")), F.nullif("b", F.lit("")))
    # texts are normalised once; row tells which one stands for its hash, as an id may come twice
    rows = written(normal.select("id", normal_hash("t", "b").alias("hash"), text.alias("text"), F.monotonically_increasing_id().alias("row")), "normal")
    keys = written(rows.groupBy("hash").agg(F.min("id").alias("key"), F.min_by("row", "id").alias("row"), (F.count("*") > 1).alias("held")), "keys")
    ids = written(rows.select("id", "hash").join(keys, "hash").select("id", "key", "held"), "ids")
    texts = rows.select("row", "text").join(keys.select("row", "key", "held").hint("shuffle_hash"), "row")
    if cosines is not None:
        a, b = ids.select(F.col("id").alias("a"), F.col("key").alias("x")), ids.select(F.col("id").alias("b"), F.col("key").alias("y"))
        cosines = cosines.join(a, "a").join(b, "b").where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("cosine").alias("cosine"))
        cosines = written(cosines, "cosines")  # every round of the semantic tier reads them
    near = linkage.near_groups(texts.select("key", "text", "held"), cosines=cosines)
    joined = F.when(F.col("held"), linkage.EXACT).otherwise(F.col("joined"))
    return ids.join(near, "key").select("id", F.col("head").alias("grp"), joined.alias("joined"), "method", "similarity")


def _cascaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = leads(spark, sf_dir)
    rank = F.struct(F.col("score").isNotNull(), F.coalesce("score", F.lit(0)), -F.col("age_hours"), F.col("id"))
    return cascade(posts, sphere.near_vectors(table(spark, sf_dir, "embeddings"))).join(posts.select("id", rank.alias("rank")), "id")


@query("duplicate_groups")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a group of the cascade: representative, size, method and similarity. An embedding
    counts as that of the post with its number."""
    return _cascaded(spark, sf_dir).groupBy("grp", "method", "similarity").agg(F.max_by("id", "rank").alias("representative"), F.count("*").alias("member_count"))


@query("duplicate_members")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of a group, whether it stands for it, and by which reason others are rejected."""
    rows = one_group_each(_cascaded(spark, sf_dir), "id", "grp")
    best = rows.groupBy("grp").agg(F.max_by("id", "rank").alias("representative"))
    mine = F.col("id") == F.col("representative")
    reason = F.when(mine, None).when(F.col("joined") == linkage.EXACT, "duplicate_exact").otherwise("duplicate_near")
    return rows.join(best, "grp").select("id", "grp", mine.alias("is_representative"), "joined", reason.alias("reason"))


@query(
    "cosine_pairs",
    f"""WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0)
SELECT q.vec_id AS query, v.vec_id AS other, CAST(round(list_cosine_similarity(q.e::DOUBLE[], v.embedding::DOUBLE[]), 6) AS DOUBLE) AS cosine FROM q JOIN embeddings v ON v.vec_id <> q.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) <= 3""",
)
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search, not the similarity join (cosine_near): the three nearest vectors of each query
    vector (ids divisible by 50) among all vectors, as the SQL has it."""
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return sphere.nearest(vecs.where("id % 50 = 0"), vecs, 3)


@query(
    "cosine_near",
    f"""WITH v AS (SELECT min(vec_id) AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY embedding)
SELECT x.id AS a, y.id AS b, CAST(round(list_cosine_similarity(x.e, y.e), 6) AS DOUBLE) AS cosine FROM v x JOIN v y ON x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= {COSINE}""",
)
def cosine_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_vectors of all vectors; cosine_pairs is a search for the three nearest only."""
    return sphere.near_vectors(table(spark, sf_dir, "embeddings"))
