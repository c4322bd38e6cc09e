"""Schema, defaults, files and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.catalog.common import PURCHASES_SQL, mix_sql, purchases, table, vectors
from kindred.functions.labels import none_if_missing
from kindred.functions.schema import (
    align_key,
    join_all_strings,
    join_text,
    pin_feedback,
    pin_items,
    resolve_roles,
)
from kindred.operators.corpus import table_shape
from kindred.operators.neighbors import first_by_name
from kindred.operators.recommendations import recommended_for_user, recommended_items, user_list
from kindred.session import scratch_path
from kindred.sources.stores import read_vectors, run_stamp, write_results, write_vectors
from kindred.sources.tables import (
    read_csv,
    read_pairs,
    read_recommendations,
    read_token_set,
)

QUERIES = {}
SQL = {}


def alias_rename(spark: SparkSession, folder: str) -> DataFrame:
    loose = table(spark, folder, "part").select(
        F.col("p_partkey").alias(" Hotel-ID "),
        F.col("p_name").alias("NAME"),
        F.col("p_brand").alias("Hotel  Address"),
        F.col("p_type").alias("Description"),
        F.col("p_size").alias(" Stars"),
        F.col("p_retailprice").alias("Total Score"),
    )
    return pin_items(loose).select(
        "item_id", "item_name", "address", "description", "rank", "score"
    )


QUERIES["alias_rename"] = alias_rename
SQL["alias_rename"] = """
SELECT p_partkey AS item_id, p_name AS item_name, p_brand AS address,
       p_type AS description, p_size AS rank, p_retailprice AS score
FROM part"""


def role_columns(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "part").select(
        F.col("p_partkey").alias("Hotel_ID"),
        F.col("p_name").alias("hotel_name"),
        F.col("p_type").alias("HOTEL_DESCRIPTION"),
    )
    feedback = purchases(spark, folder).select(
        F.col("user_key").alias("Reviewer Name"),
        F.col("item_id").alias("Hotel_ID"),
        F.col("rating").alias("Score"),
    )
    roles = resolve_roles(items, feedback)
    named = items.select(
        F.col(roles.item_id).alias("item_id"),
        F.col(roles.item_name).alias("item_name"),
        join_text(roles.text).alias("text"),
    )
    said = feedback.select(
        F.col(roles.feedback_item).alias("item_id"),
        F.col(roles.user).alias("user_key"),
        F.col(roles.rating).alias("rating"),
    )
    totals = said.groupBy("item_id").agg(
        F.countDistinct("user_key").alias("n_users"),
        F.round(F.avg("rating"), 6).alias("mean_rating"),
    )
    return named.join(totals, "item_id")


QUERIES["role_columns"] = role_columns
SQL["role_columns"] = f"""
WITH {PURCHASES_SQL}
SELECT p_partkey AS item_id, any_value(p_name) AS item_name, any_value(p_type) AS text,
       count(DISTINCT user_key) AS n_users, round(avg(rating), 6) AS mean_rating
FROM part JOIN purchases ON p_partkey = item_id
GROUP BY p_partkey"""


def default_fill(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    bare = table(spark, folder, "part").select(
        F.col("p_partkey").alias("hotel_id"),
        F.col("p_name").alias("name"),
        F.when(size % 4 != 0, F.col("p_brand")).alias("address"),
        F.when(size % 5 == 0, F.lit(" No info "))
        .when(size % 5 == 1, F.lit("N/A"))
        .otherwise(size.cast("string"))
        .alias("stars"),
    )
    return pin_items(bare, null_text="nan").select(
        "item_id", "description", "score", none_if_missing(F.col("rank")).alias("rank")
    )


QUERIES["default_fill"] = default_fill
SQL["default_fill"] = f"""
SELECT p_partkey AS item_id,
       p_name || ' ' || CASE WHEN p_size % 4 <> 0 THEN p_brand ELSE 'nan' END AS description,
       round(7.5 + 2.3 * (({mix_sql('p_partkey')}) / 2147483648.0::DOUBLE), 1) AS score,
       CASE WHEN p_size % 5 NOT IN (0, 1) THEN CAST(p_size AS VARCHAR) END AS rank
FROM part"""


def row_text(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(
        "p_partkey",
        join_text(["p_name", "p_brand"]).alias("chosen"),
        join_all_strings(part).alias("every_string"),
    )


QUERIES["row_text"] = row_text
SQL["row_text"] = """
SELECT p_partkey, p_name || ' ' || p_brand AS chosen,
       p_name || ' ' || p_brand || ' ' || p_type AS every_string
FROM part"""


def key_align(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("x"), F.col("l_partkey")))
        .otherwise(F.col("l_partkey").cast("string"))
        .alias("p_partkey"),
    )
    return align_key(lines, "p_partkey", part, "p_partkey").join(part, "p_partkey")


QUERIES["key_align"] = key_align
SQL["key_align"] = """
SELECT l_orderkey, l_linenumber, p_partkey, p_name
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 7"""


def shape(spark: SparkSession, folder: str) -> DataFrame:
    return table_shape(table(spark, folder, "lineitem"))


QUERIES["table_shape"] = shape
SQL["table_shape"] = """
SELECT count(*) AS n_rows,
       (SELECT count(*) FROM (DESCRIBE lineitem)) AS n_columns
FROM lineitem"""


def users(spark: SparkSession, folder: str) -> DataFrame:
    feedback = purchases(spark, folder).select(
        F.col("user_key").alias("Reviewer Name"), F.col("item_id").alias("Hotel ID")
    )
    return user_list(pin_feedback(feedback), "user_key")


QUERIES["user_list"] = users
SQL["user_list"] = f"""
WITH {PURCHASES_SQL}
SELECT DISTINCT CAST(user_key AS VARCHAR) AS user_key FROM purchases"""


def _named_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name")
    )


def seed_lookup(spark: SparkSession, folder: str) -> DataFrame:
    parts = _named_parts(spark, folder)
    seeds = first_by_name(parts, parts.select("item_name").distinct())
    known = vectors(spark, folder).select(F.col("item_id").alias("seed_id"), F.lit(1).alias("k"))
    return seeds.join(known, "seed_id", "left").select(
        "item_name", "seed_id", F.coalesce("k", F.lit(0)).cast("bigint").alias("is_known")
    )


QUERIES["seed_lookup"] = seed_lookup
SQL["seed_lookup"] = """
WITH first_id AS (SELECT p_name AS item_name, min(p_partkey) AS seed_id FROM part GROUP BY p_name)
SELECT item_name, seed_id,
       CAST(seed_id IN (SELECT vec_id FROM embeddings) AS BIGINT) AS is_known
FROM first_id"""


def _stored_recommendations(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """Each user's best-rated purchase, written as recommendations and read back."""
    best = (
        purchases(spark, folder)
        .groupBy("user_key")
        .agg(F.max_by("item_id", F.struct("rating", -F.col("row_id"), -F.col("item_id"))).alias("item_id"))
    )
    names = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_key"), F.col("c_name").alias("UserName")
    )
    stored = (
        best.join(names, "user_key")
        .join(parts, "item_id")
        .select("UserName", F.col("item_name").alias("RecommendedHotel"))
    )
    path = scratch_path(spark, "recommendations")
    stored.write.option("header", True).csv(path)
    return read_recommendations(spark, path)


def recs_by_user(spark: SparkSession, folder: str) -> DataFrame:
    """The stored recommendations of everyone, looked up by name."""
    parts = _named_parts(spark, folder)
    recommended = _stored_recommendations(spark, folder, parts)
    everyone = recommended.select("UserName").distinct()
    return recommended_items(recommended, parts, everyone).select(
        "UserName", "RecommendedHotel", "item_id"
    )


QUERIES["recs_by_user"] = recs_by_user
_STORED_SQL = f"""
{PURCHASES_SQL},
best AS (
  SELECT user_key, item_id FROM (
    SELECT user_key, item_id,
           row_number() OVER (PARTITION BY user_key ORDER BY rating DESC, row_id, item_id) AS n
    FROM purchases) WHERE n = 1
),
details AS (
  SELECT c_name AS UserName, a.p_name AS RecommendedHotel, b.p_partkey AS item_id
  FROM best JOIN customer ON c_custkey = user_key
  JOIN part a ON a.p_partkey = best.item_id
  JOIN part b ON b.p_name = a.p_name
)"""
SQL["recs_by_user"] = f"WITH {_STORED_SQL} SELECT * FROM details"


def recs_of_one(spark: SparkSession, folder: str) -> DataFrame:
    """The stored recommendations of the user whose name comes last."""
    parts = _named_parts(spark, folder)
    recommended = _stored_recommendations(spark, folder, parts)
    user = recommended.agg(F.max("UserName")).first()[0]
    return recommended_for_user(recommended, parts, user).select(
        "UserName", "RecommendedHotel", "item_id"
    )


QUERIES["recs_of_one"] = recs_of_one
SQL["recs_of_one"] = f"""
WITH {_STORED_SQL} SELECT * FROM details WHERE UserName = (SELECT max(UserName) FROM details)"""


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    path = write_results(
        part, scratch_path(spark, "results"), "part", run_stamp(spark)
    )
    back = read_csv(spark, path, multi_line=False)
    return back.select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"),
        "p_name",
        "p_brand",
        "p_type",
        F.col("p_size").cast("bigint").alias("p_size"),
        F.round("p_retailprice", 6).alias("p_retailprice"),
    )


QUERIES["csv_roundtrip"] = csv_roundtrip
SQL["csv_roundtrip"] = """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size,
       round(p_retailprice, 6) AS p_retailprice
FROM part"""


def dict_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as a dictionary file, one line per part; the last brand wins."""
    path = scratch_path(spark, "dictionary")
    table(spark, folder, "part").orderBy("p_partkey").select(
        F.concat_ws("\t", "p_name", "p_brand")
    ).write.text(path)
    return read_pairs(spark, path).select("key", "value")


QUERIES["dict_scan"] = dict_scan
SQL["dict_scan"] = """
SELECT p_name AS key, arg_max(p_brand, p_partkey) AS value FROM part GROUP BY p_name"""


def dict_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line numbers over two files of unequal size: a third of the parts, then the others."""
    path = scratch_path(spark, "dictionary")
    part = table(spark, folder, "part")
    middle = part.agg((F.max("p_partkey") / 3).cast("bigint")).scalar()
    for name, wanted in (("a", F.col("p_partkey") <= middle), ("b", F.col("p_partkey") > middle)):
        part.where(wanted).orderBy("p_partkey").select(
            F.concat_ws("\t", F.concat_ws(" ", "p_name", "p_partkey"), "p_brand")
        ).write.text(f"{path}/{name}")
    return read_pairs(spark, f"{path}/*").select("key", "value", "line_no")


QUERIES["dict_lines"] = dict_lines
SQL["dict_lines"] = """
SELECT p_name || ' ' || p_partkey AS key, p_brand AS value,
       row_number() OVER (ORDER BY p_partkey) AS line_no
FROM part"""


def token_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Brands as a file of tokens, one line per part: blank lines go, repeated tokens count once."""
    path = scratch_path(spark, "tokens")
    table(spark, folder, "part").select(
        F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_brand"))
    ).write.text(path)
    return read_token_set(spark, path)


QUERIES["token_scan"] = token_scan
SQL["token_scan"] = "SELECT DISTINCT p_brand AS token FROM part WHERE p_size % 3 <> 0"


def vector_store(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    write_vectors(vectors(spark, folder), path)
    dims = F.col("embedding").cast("array<double>")
    return read_vectors(spark, path).select(
        "item_id",
        F.size("embedding").cast("bigint").alias("n_dims"),
        F.round(F.aggregate(dims, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


QUERIES["vector_store"] = vector_store
SQL["vector_store"] = """
SELECT vec_id AS item_id, CAST(len(embedding) AS BIGINT) AS n_dims,
       round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
FROM embeddings"""
