"""What several queries share: reading tables, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Who bought what, as stand-in for who reviewed what."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("user_key"),
        F.col("l_partkey").alias("item_id"),
        (F.col("l_quantity") / 5).alias("rating"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
    )


PURCHASES_SQL = """
purchases AS (
  SELECT o_custkey AS user_key, l_partkey AS item_id, l_quantity / 5 AS rating,
         l_orderkey * 10 + l_linenumber AS row_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), "embedding"
    )


def mix_sql(key: str, seed: int = 42) -> str:
    """``kindred.functions.hashing.mix`` in SQL."""

    def step(state: str) -> str:
        return f"(({state}) * 1103515245 + 12345) % 2147483648"

    first = step(f"({key}) % 2147483647 + {seed * 7919}")
    return step(f"xor(({first}) >> 15, {first})")


def term_ctes(source: str, id_col: str, text: str, max_features: int, prefix: str = "") -> str:
    """Term counts, vocabulary and unit-length weights of one text per item."""
    p = prefix
    return rf"""
{p}toks AS (
  SELECT {id_col} AS item_id,
         regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}') AS t
  FROM {source}
),
{p}pos AS (
  SELECT item_id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS p FROM {p}toks
),
{p}pairs AS (
  SELECT item_id, tok, lead(tok) OVER (PARTITION BY item_id ORDER BY p) AS nxt FROM {p}pos
),
{p}counts AS (
  SELECT item_id, term, count(*) AS tf
  FROM (SELECT item_id, tok AS term FROM {p}pos
        UNION ALL
        SELECT item_id, tok || ' ' || nxt FROM {p}pairs WHERE nxt IS NOT NULL)
  GROUP BY item_id, term
),
{p}vocab AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf
  FROM {p}counts GROUP BY term HAVING count(*) >= 2
  ORDER BY ctf DESC, term LIMIT {max_features}
),
{p}idf AS (
  SELECT term, df, ctf,
         ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + df)) + 1.0 AS idf
  FROM {p}vocab
)"""


def weight_ctes(counts: str, idf: str, out: str) -> str:
    """Unit-length weights ``out(item_id, term, weight)``."""
    return f"""
{out}_raw AS (SELECT item_id, term, tf * idf AS x FROM {counts} JOIN {idf} USING (term)),
{out}_norm AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM {out}_raw GROUP BY item_id),
{out} AS (
  SELECT item_id, term, x / norm AS weight FROM {out}_raw JOIN {out}_norm USING (item_id)
)"""


LIGHT_DOCUMENTS_SQL = r"""
light AS (
  SELECT doc_id, trim(regexp_replace(nfc_normalize(lower(text)),
                                     '[^\p{L}\p{N}_]+', ' ', 'g')) AS text
  FROM documents
)"""
