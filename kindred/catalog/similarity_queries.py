"""TF-IDF, similar items, free-text search and vector similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.catalog.common import table, term_ctes, vectors, weight_ctes
from kindred.catalog.text_queries import dictionaries, full_ctes
from kindred.operators.neighbors import as_seeds, similar_by_vector, unknown_seeds, with_names
from kindred.operators.terms import (
    DESCRIPTION_FEATURES,
    FULL_CORPUS_FEATURES,
    SEARCH_FEATURES,
    fit_tfidf,
)
from kindred.plans.content import index_tables, index_texts, light_counts, similar_items
from kindred.plans.serving import PAGE, search, search_rows, similar_by_name

QUERIES = {}
SQL = {}
TOP = 10


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


_TEXT = "nfc_normalize(lower(text))"


def similar_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar documents of every document."""
    return similar_items(index_texts(_documents(spark, folder), "doc_id", "text"), TOP)


QUERIES["similar_tfidf"] = similar_tfidf


def similar_sql(seeds: str, items: str, sims: str, k: int, keep_self: bool = False) -> str:
    """Dense ranking of all items for every seed, zeros included."""
    other = "" if keep_self else "WHERE s.id <> i.id"
    return f"""
SELECT seed_id, item_id, similarity, rank FROM (
  SELECT seed_id, item_id, similarity,
         row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, item_id) AS rank
  FROM (
    SELECT s.id AS seed_id, i.id AS item_id, round(coalesce(dot, 0.0), 6) AS similarity
    FROM {seeds} s CROSS JOIN {items} i
    LEFT JOIN {sims} d ON d.seed_id = s.id AND d.item_id = i.id
    {other}
  )
) WHERE rank <= {k}"""


SQL["similar_tfidf"] = f"""
WITH {term_ctes('documents', 'doc_id', _TEXT, FULL_CORPUS_FEATURES)},
{weight_ctes('counts', 'idf', 'post')},
ids AS (SELECT doc_id AS id FROM documents),
dots AS (
  SELECT a.item_id AS seed_id, b.item_id, sum(a.weight * b.weight) AS dot
  FROM post a JOIN post b USING (term) GROUP BY a.item_id, b.item_id
)
{similar_sql('ids', 'ids', 'dots', TOP)}"""


def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return light_counts(_documents(spark, folder), "doc_id", "text")


QUERIES["ngram_counts"] = ngram_counts
SQL["ngram_counts"] = f"""
WITH {term_ctes('documents', 'doc_id', _TEXT, FULL_CORPUS_FEATURES)}
SELECT item_id, term, tf FROM counts"""


def vocab_cap(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    model = fit_tfidf(light_counts(docs, "doc_id", "text"), docs, DESCRIPTION_FEATURES)
    return model.terms.select("term", "df", "ctf", F.round("idf", 6).alias("idf"))


QUERIES["vocab_cap"] = vocab_cap
SQL["vocab_cap"] = f"""
WITH {term_ctes('documents', 'doc_id', _TEXT, DESCRIPTION_FEATURES)}
SELECT term, df, ctf, round(idf, 6) AS idf FROM idf"""


def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    counts = light_counts(docs, "doc_id", "text")
    model = fit_tfidf(counts, docs, FULL_CORPUS_FEATURES)
    return model.postings(model.weigh(counts)).select(
        "item_id", "term", F.round("weight", 6).alias("weight")
    )


QUERIES["tfidf_weights"] = tfidf_weights
SQL["tfidf_weights"] = f"""
WITH {term_ctes('documents', 'doc_id', _TEXT, FULL_CORPUS_FEATURES)},
{weight_ctes('counts', 'idf', 'post')}
SELECT item_id, term, round(weight, 6) AS weight FROM post"""


def text_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark text as a free-text query over the documents."""
    index = index_texts(_documents(spark, folder), "doc_id", "text", SEARCH_FEATURES)
    return search(index, table(spark, folder, "benchmark"), "item_id", "text")


QUERIES["text_search"] = text_search
SQL["text_search"] = f"""
WITH {term_ctes('documents', 'doc_id', _TEXT, SEARCH_FEATURES)},
{weight_ctes('counts', 'idf', 'post')},
{term_ctes('benchmark', 'item_id', _TEXT, SEARCH_FEATURES, prefix='q_')},
{weight_ctes('q_counts', 'idf', 'q_post')},
queries AS (SELECT item_id AS id FROM benchmark),
ids AS (SELECT doc_id AS id FROM documents),
dots AS (
  SELECT a.item_id AS seed_id, b.item_id, sum(a.weight * b.weight) AS dot
  FROM q_post a JOIN post b USING (term) GROUP BY a.item_id, b.item_id
)
{similar_sql('queries', 'ids', 'dots', PAGE, keep_self=True)}"""


def similar_dense(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar stored vectors of every vector."""
    items = vectors(spark, folder)
    return similar_by_vector(as_seeds(items), items, TOP)


QUERIES["similar_dense"] = similar_dense
COSINE_SQL = """
vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dots AS (
  SELECT a.id AS seed_id, b.id AS item_id, list_cosine_similarity(a.v, b.v) AS dot
  FROM vec a CROSS JOIN vec b
)"""
SQL["similar_dense"] = f"""
WITH {COSINE_SQL}
{similar_sql('vec', 'vec', 'dots', TOP)}"""


def by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Look-alikes of the first part of every name, by stored vectors."""
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name")
    )
    names = parts.select("item_name").distinct()
    return similar_by_name(parts, vectors(spark, folder), names)


QUERIES["similar_by_name"] = by_name
SQL["similar_by_name"] = f"""
WITH {COSINE_SQL},
seeds AS (
  SELECT id FROM (SELECT min(p_partkey) AS id FROM part GROUP BY p_name)
  WHERE id IN (SELECT id FROM vec)
),
best AS ({similar_sql('seeds', 'vec', 'dots', PAGE)})
SELECT seed_id, item_id, p_name AS item_name, similarity, rank
FROM best LEFT JOIN part ON p_partkey = item_id"""


def search_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark text as a query over the documents, hits with the documents' columns."""
    docs = table(spark, folder, "documents")
    index = index_texts(_documents(spark, folder), "doc_id", "text", SEARCH_FEATURES)
    rows = docs.select(F.col("doc_id").alias("item_id"), "lang", "source", "n_chars")
    return search_rows(index, rows, table(spark, folder, "benchmark"), "item_id", "text")


QUERIES["search_items"] = search_items
SQL["search_items"] = f"""
WITH hits AS ({SQL["text_search"]})
SELECT item_id, seed_id, similarity, rank, lang, source, n_chars
FROM hits LEFT JOIN documents ON doc_id = item_id"""

_PART_TEXT = "p_name || ' ' || p_brand || ' ' || p_type"


def by_name_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Look-alikes of the first part of every name, by the words of name, brand and type."""
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"),
    )
    index = index_texts(parts, "item_id", "text", SEARCH_FEATURES)
    return similar_by_name(parts, index, parts.select("item_name").distinct())


QUERIES["similar_by_name_terms"] = by_name_terms
SQL["similar_by_name_terms"] = f"""
WITH {term_ctes('part', 'p_partkey', _PART_TEXT, SEARCH_FEATURES)},
{weight_ctes('counts', 'idf', 'post')},
seeds AS (SELECT min(p_partkey) AS id FROM part GROUP BY p_name),
ids AS (SELECT p_partkey AS id FROM part),
dots AS (
  SELECT a.item_id AS seed_id, b.item_id, sum(a.weight * b.weight) AS dot
  FROM post a JOIN post b USING (term)
  WHERE a.item_id IN (SELECT id FROM seeds) GROUP BY a.item_id, b.item_id
),
best AS ({similar_sql('seeds', 'ids', 'dots', PAGE)})
SELECT seed_id, item_id, p_name AS item_name, similarity, rank
FROM best LEFT JOIN part ON p_partkey = item_id"""


def similar_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The whole content job: loosely named documents, described by text and source, with what was said on them."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("Hotel_ID"),
        F.col("lang").alias("Hotel_Name"),
        F.col("text").alias("Hotel_Description"),
        F.col("source").alias("hotel_description_more"),
    )
    said = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("Hotel_ID"), F.col("role").alias("Reviewer Name"), "turn", "text"
    )
    found = index_tables(docs, said, dictionaries(spark), "turn")
    return with_names(similar_items(found.index, TOP), found.items)


QUERIES["similar_corpus"] = similar_corpus
SQL["similar_corpus"] = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') || ' ' || coalesce(source, '') AS text FROM documents
),
talk AS (
  SELECT conv_id, turn, coalesce(role, '') || ' ' || coalesce(text, '') AS text FROM conversations
),
{full_ctes('docs', 'doc_id', 'own')},
{full_ctes('talk', 'conv_id, turn', 'said')},
bag AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS bag
        FROM said GROUP BY conv_id),
corpus AS (SELECT doc_id, text || ' ' || coalesce(bag, '') AS text
           FROM own LEFT JOIN bag USING (doc_id)),
{term_ctes('corpus', 'doc_id', 'text', FULL_CORPUS_FEATURES)},
{weight_ctes('counts', 'idf', 'post')},
ids AS (SELECT doc_id AS id FROM documents),
dots AS (
  SELECT a.item_id AS seed_id, b.item_id, sum(a.weight * b.weight) AS dot
  FROM post a JOIN post b USING (term) GROUP BY a.item_id, b.item_id
),
best AS ({similar_sql('ids', 'ids', 'dots', TOP)})
SELECT seed_id, item_id, lang AS item_name, similarity, rank
FROM best LEFT JOIN documents ON doc_id = item_id"""


def seeds_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """Parts asked for as seeds that have no stored vector."""
    wanted = table(spark, folder, "part").select(F.col("p_partkey").alias("seed_id"))
    return unknown_seeds(wanted, vectors(spark, folder))


QUERIES["seeds_unknown"] = seeds_unknown
SQL["seeds_unknown"] = """
SELECT DISTINCT p_partkey AS seed_id FROM part
WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)"""
