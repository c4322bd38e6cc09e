"""Relevance by shared users, and the ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.catalog.common import (
    PURCHASES_SQL,
    mix_sql,
    purchases,
    table,
    term_ctes,
    vectors,
    weight_ctes,
)
from kindred.catalog.similarity_queries import COSINE_SQL, similar_sql
from kindred.operators.ranking import METRICS, N_RECOMMENDED, summarize
from kindred.operators.relevance import (
    MIN_RELEVANT,
    MOST_RELEVANT,
    N_SEEDS,
    distinct_pairs,
    evaluation_candidates,
    sample_seeds,
)
from kindred.operators.terms import FULL_CORPUS_FEATURES
from kindred.plans.content import (
    Judgement,
    evaluate_content,
    index_texts,
    judge_by_users,
    store_evaluation,
)
from kindred.session import cut, scratch_path
from kindred.sources.stores import run_stamp
from kindred.sources.tables import read_csv

QUERIES = {}
SQL = {}


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("item_id"))


def _judgement(spark: SparkSession, folder: str) -> Judgement:
    return judge_by_users(purchases(spark, folder), _items(spark, folder), N_SEEDS)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cut(distinct_pairs(purchases(spark, folder)))
    return evaluation_candidates(pairs, _items(spark, folder))


_CANDIDATES_SQL = f"""
{PURCHASES_SQL},
pairs AS (SELECT DISTINCT user_key, item_id FROM purchases),
candidates AS (
  SELECT a.item_id FROM pairs a JOIN pairs b USING (user_key)
  WHERE a.item_id <> b.item_id AND a.item_id IN (SELECT p_partkey FROM part)
  GROUP BY a.item_id HAVING count(DISTINCT b.item_id) >= {MIN_RELEVANT}
)"""
QUERIES["eval_candidates"] = candidates
SQL["eval_candidates"] = f"WITH {_CANDIDATES_SQL} SELECT item_id FROM candidates"


def eval_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return sample_seeds(candidates(spark, folder))


_SEEDS_SQL = f"""
{_CANDIDATES_SQL},
seeds AS (
  SELECT item_id AS seed_id FROM candidates
  ORDER BY {mix_sql('item_id')}, item_id LIMIT {N_SEEDS}
)"""
QUERIES["eval_seeds"] = eval_seeds
SQL["eval_seeds"] = f"WITH {_SEEDS_SQL} SELECT seed_id FROM seeds"

_RELEVANCE_SQL = f"""
{_SEEDS_SQL},
holders AS (SELECT item_id, count(*) AS n FROM pairs GROUP BY item_id),
shared AS (
  SELECT a.item_id AS seed_id, b.item_id, count(*) AS n
  FROM pairs a JOIN pairs b USING (user_key)
  WHERE a.item_id IN (SELECT seed_id FROM seeds) AND a.item_id <> b.item_id
  GROUP BY a.item_id, b.item_id
),
relevance AS (
  SELECT * FROM (
    SELECT seed_id, item_id, gain,
           row_number() OVER (PARTITION BY seed_id ORDER BY gain DESC, item_id) AS rank
    FROM (SELECT s.seed_id, s.item_id,
                 CAST(s.n AS DOUBLE) / CAST(a.n + b.n - s.n AS DOUBLE) AS gain
          FROM shared s JOIN holders a ON a.item_id = s.seed_id
          JOIN holders b ON b.item_id = s.item_id)
  ) WHERE rank <= {MOST_RELEVANT}
)"""


def jaccard_items(spark: SparkSession, folder: str) -> DataFrame:
    return _judgement(spark, folder).relevance.select(
        "seed_id", "item_id", F.round("gain", 6).alias("gain"), "rank"
    )


QUERIES["jaccard_items"] = jaccard_items
SQL["jaccard_items"] = f"""
WITH {_RELEVANCE_SQL} SELECT seed_id, item_id, round(gain, 6) AS gain, rank FROM relevance"""


def _metrics_sql(asked: str) -> str:
    """Per-seed metrics of ``recs(method, seed_id, item_id, rank)``."""
    return f"""
asked AS ({asked}),
cutoffs(k) AS (VALUES (5), (10), (20)),
judged AS (
  SELECT r.method, r.seed_id, r.rank, r.item_id, coalesce(gain, 0.0) AS gain,
         CASE WHEN gain IS NULL THEN 0 ELSE 1 END AS hit
  FROM recs r LEFT JOIN relevance v ON v.seed_id = r.seed_id AND v.item_id = r.item_id
),
running AS (
  SELECT *, sum(hit) OVER (PARTITION BY method, seed_id ORDER BY rank) AS hits FROM judged
),
reached AS (
  SELECT method, seed_id, k, sum(hit) AS n_hits, sum(hit * hits / CAST(rank AS DOUBLE)) AS ap,
         sum(hit / log2(rank + 1)) AS dcg_bin,
         sum((pow(2.0, gain) - 1) / log2(rank + 1)) AS dcg_grd
  FROM running JOIN cutoffs ON rank <= k GROUP BY method, seed_id, k
),
ideal_bin AS (
  SELECT seed_id, count(*) AS n_rel, sum(1 / log2(rank + 1)) AS ideal
  FROM relevance GROUP BY seed_id
),
ideal_grd AS (
  SELECT seed_id, k, sum((pow(2.0, gain) - 1) / log2(rank + 1)) AS ideal
  FROM relevance JOIN cutoffs ON rank <= k GROUP BY seed_id, k
),
metrics AS (
  SELECT a.method, CAST(c.k AS BIGINT) AS k, a.seed_id,
         coalesce(n_hits, 0) / CAST(c.k AS DOUBLE) AS precision,
         coalesce(ap, 0) / greatest(least(coalesce(n_rel, 0), c.k), 1) AS map,
         coalesce(dcg_bin / b.ideal, 0) AS ndcg_bin,
         coalesce(dcg_grd / g.ideal, 0) AS ndcg_grd,
         coalesce(n_rel, 0) AS n_rel
  FROM asked a CROSS JOIN cutoffs c
  LEFT JOIN reached r ON r.method = a.method AND r.seed_id = a.seed_id AND r.k = c.k
  LEFT JOIN ideal_bin b ON b.seed_id = a.seed_id
  LEFT JOIN ideal_grd g ON g.seed_id = a.seed_id AND g.k = c.k
)"""


_DENSE_LISTS_SQL = f"""
{COSINE_SQL},
dense_seeds AS (SELECT seed_id AS id FROM seeds WHERE seed_id IN (SELECT id FROM vec)),
dense_lists AS ({similar_sql('dense_seeds', 'vec', 'dots', N_RECOMMENDED)})"""

_DENSE_METRICS_SQL = f"""
{_RELEVANCE_SQL}, {_DENSE_LISTS_SQL},
recs AS (SELECT 'stored' AS method, seed_id, item_id, rank FROM dense_lists),
{_metrics_sql("SELECT 'stored' AS method, id AS seed_id FROM dense_seeds")}"""


def _metric_query(metric: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        per_seed = evaluate_content(
            _judgement(spark, folder), vectors={"stored": vectors(spark, folder)}
        )
        return per_seed.select(
            "method", "seed_id", "k", F.round(metric, 6).alias(metric), "n_rel"
        )

    return query


for _name, _metric in {
    "precision_at_k": "precision",
    "ap_at_k": "map",
    "ndcg_binary": "ndcg_bin",
    "ndcg_graded": "ndcg_grd",
}.items():
    QUERIES[_name] = _metric_query(_metric)
    SQL[_name] = f"""
WITH {_DENSE_METRICS_SQL}
SELECT method, seed_id, k, round({_metric}, 6) AS {_metric}, n_rel FROM metrics"""


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Mean metrics of TF-IDF over the documents and of the stored vectors."""
    per_seed = evaluate_content(
        _judgement(spark, folder),
        index=index_texts(table(spark, folder, "documents"), "doc_id", "text"),
        vectors={"stored": vectors(spark, folder)},
    )
    means = summarize(per_seed)
    return means.select(
        "label", "method", "k", *[F.round(m, 6).alias(m) for m in METRICS]
    )


QUERIES["eval_summary"] = eval_summary
SQL["eval_summary"] = f"""
WITH {_RELEVANCE_SQL}, {_DENSE_LISTS_SQL},
{term_ctes('documents', 'doc_id', 'nfc_normalize(lower(text))', FULL_CORPUS_FEATURES, 't_')},
{weight_ctes('t_counts', 't_idf', 'post')},
ids AS (SELECT doc_id AS id FROM documents),
text_seeds AS (SELECT seed_id AS id FROM seeds WHERE seed_id IN (SELECT id FROM ids)),
text_dots AS (
  SELECT a.item_id AS seed_id, b.item_id, sum(a.weight * b.weight) AS dot
  FROM post a JOIN post b USING (term)
  WHERE a.item_id IN (SELECT id FROM text_seeds) GROUP BY a.item_id, b.item_id
),
text_lists AS ({similar_sql('text_seeds', 'ids', 'text_dots', N_RECOMMENDED)}),
recs AS (
  SELECT 'stored' AS method, seed_id, item_id, rank FROM dense_lists
  UNION ALL
  SELECT 'tfidf' AS method, seed_id, item_id, rank FROM text_lists
),
{_metrics_sql('''SELECT 'stored' AS method, id AS seed_id FROM dense_seeds
  UNION ALL SELECT 'tfidf' AS method, id AS seed_id FROM text_seeds''')}
SELECT method || '_' || k AS label, method, k, round(avg(precision), 6) AS precision,
       round(avg(map), 6) AS map, round(avg(ndcg_bin), 6) AS ndcg_bin,
       round(avg(ndcg_grd), 6) AS ndcg_grd
FROM metrics GROUP BY method, k"""


def eval_files(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the stored vectors, kept as CSV under a run's id and read back with their means."""
    per_seed = evaluate_content(
        _judgement(spark, folder), vectors={"stored": vectors(spark, folder)}
    )
    paths = store_evaluation(per_seed, scratch_path(spark, "logs"), run_stamp(spark))
    detail, means = (read_csv(spark, path, multi_line=False) for path in paths)
    means = means.select("method", "k", *[F.col(m).alias(f"mean_{m}") for m in METRICS])
    return detail.join(means, ["method", "k"]).select(
        "method",
        "seed_id",
        F.col("k").cast("bigint").alias("k"),
        *[F.round(F.col(c).cast("double"), 6).alias(c) for m in METRICS for c in (m, f"mean_{m}")],
    )


QUERIES["eval_files"] = eval_files
SQL["eval_files"] = f"""
WITH {_DENSE_METRICS_SQL}
SELECT method, seed_id, k, {", ".join(
    f"round({m}, 6) AS {m}, round(avg({m}) OVER (PARTITION BY method, k), 6) AS mean_{m}"
    for m in METRICS
)} FROM metrics"""
