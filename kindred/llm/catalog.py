"""The operators applied to their whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import (
    decontamination,
    hard_negatives,
    knn_join,
    lexical,
    line_dedup,
    mixing,
    near_dedup,
    pii,
    ppm,
    pu_quality,
    secrets,
    toxicity,
    url_filter,
)
from kindred.llm.words import fold

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def in_fold(number: int, folds: int = 5) -> Column:
    """Whether a document is of one fold; without an id it is of none."""
    return F.coalesce(fold(F.col("doc_id"), folds) == number, F.lit(False))


def toxic_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity labels that may be learned from."""
    labels = table(spark, folder, "labels")
    return labels.where(fold(F.col("doc_id")) != 0).select("doc_id", F.col("toxic").alias("label"))


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate of a secret in all texts; the values themselves are hashed."""
    found = secrets.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "start",
        "end",
        F.sha2("value", 256).alias("value_sha256"),
        F.round("probability", 6).alias("probability"),
        "is_secret",
    )


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(toxicity.labelled_sample(docs, toxic_labels(spark, folder)))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", in_fold(0).alias("held_out"), "score", "predicted"
    )


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Every text under a model of those outside fold 1; texts without an id are not held out."""
    docs = table(spark, folder, "documents")
    held_out = in_fold(1)
    scored = ppm.scores(docs, ~held_out, chunk=ppm.file_chunk())
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op2_knn_join(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector."""
    vectors = knn_join.whole_numbers(table(spark, folder, "embeddings"))
    return knn_join.search(vectors, F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH f AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS f
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
v AS (
  SELECT vec_id, min(list_transform(f, lambda x: TRY_CAST(x AS BIGINT))) AS v
  FROM f WHERE list_sum(list_transform(f, lambda x: x * x)) < 9.0e18
  GROUP BY vec_id
),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents overlap which benchmark items; clean documents have no row."""
    return decontamination.overlaps(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every text: counts and hash of strict spans, and all spans."""
    found = pii.find(table(spark, folder, "documents"))
    counts = [
        F.regexp_count("base_spans", F.lit(f"{k}:")).cast("bigint").alias(f"n_{k}")
        for k in pii.KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with later repeated runs deleted."""
    cleaned = line_dedup.remove(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "removed_words", "removed_spans", "n_chars", "text")


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact class and near-duplicate group of every document."""
    return near_dedup.groups(table(spark, folder, "documents"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's verdict; a page is good if the row of its id in labels has quality 1."""
    outcomes = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), F.col("quality").alias("good")
    )
    return url_filter.judge(table(spark, folder, "pages"), outcomes)


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        "source",
    )


def op11_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's score; good texts are trusted outside fold 2 of 4, all others are unlabelled."""
    labels = table(spark, folder, "labels").where(fold(F.col("doc_id"), 4) != 2)
    scored = pu_quality.classify(
        table(spark, folder, "documents"), labels.select("doc_id", F.col("quality").alias("label"))
    )
    return scored.select("doc_id", in_fold(2, 4).alias("held_out"), "score", "predicted")


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh one's label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(hard_negatives.candidates(vectors), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_knn_join": op2_knn_join,
    "op3_decontamination": op3_decontamination,
    "op4_near_dedup": op4_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_line_dedup": op8_line_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op2_knn_join": OP2_SQL,
    "op5_url_filter": url_filter.sql(),
    "op12_lexical_search": lexical.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
