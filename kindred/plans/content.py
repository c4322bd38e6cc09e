"""Content similarity of items and its evaluation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.schema import RULES, Roles, Rule, join_all_strings, join_text, resolve_roles
from kindred.functions.text import as_text, compose_unicode, fold_case
from kindred.operators.corpus import corpus_segments
from kindred.operators.dictionaries import Dictionaries, clean_full
from kindred.operators.neighbors import (
    as_seeds,
    require_seeds,
    similar_by_terms,
    similar_by_vector,
)
from kindred.operators.ranking import (
    N_RECOMMENDED,
    evaluate,
    label_method,
    summarize,
    union_methods,
)
from kindred.operators.relevance import (
    distinct_pairs,
    evaluation_candidates,
    jaccard_relevance,
    sample_seeds,
)
from kindred.operators.terms import (
    FULL_CORPUS_FEATURES,
    MIN_DOCUMENTS,
    TfidfModel,
    fit_tfidf,
    known_counts,
    loose_counts,
    segment_counts,
    spread_by_item,
    term_counts,
)
from kindred.session import cut
from kindred.sources.stores import write_results


@dataclass(frozen=True)
class TextIndex:
    """A fitted vocabulary and the vectors of all items, written out once."""

    model: TfidfModel
    vectors: DataFrame


def _index(
    counts: DataFrame, items: DataFrame, max_features: int, min_df: int
) -> TextIndex:
    model = fit_tfidf(counts, items, max_features, min_df)
    return TextIndex(model, cut(model.weigh(counts, items)))


def light_texts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, text)`` after light cleaning, spread by item.

    Terms are runs of word characters, so turning all other characters into spaces
    first would not change them; only case and composition are left to do.
    """
    folded = texts.withColumn(text_col, compose_unicode(fold_case(as_text(F.col(text_col)))))
    return spread_by_item(folded, id_col, text_col)


def light_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Term counts of one text per item after light cleaning."""
    return term_counts(light_texts(texts, id_col, text_col))


def index_texts(
    items: DataFrame,
    id_col: str,
    text_col: str,
    max_features: int = FULL_CORPUS_FEATURES,
    min_df: int = MIN_DOCUMENTS,
) -> TextIndex:
    """Index one text per item after light cleaning.

    The vocabulary is fitted on the counts of all terms, vectors are made from those of its own.
    """
    ids = items.select(F.col(id_col).alias("item_id"))
    texts = light_texts(items, id_col, text_col)
    model = fit_tfidf(loose_counts(texts), ids, max_features, min_df)
    counts = known_counts(texts, model.terms, max_features)
    return TextIndex(model, cut(model.weigh(counts, ids)))


def index_corpus(
    items: DataFrame,
    feedback: DataFrame,
    *,
    key: str,
    item_text: str,
    feedback_text: str,
    order_col: str,
    dictionaries: Dictionaries,
    max_features: int = FULL_CORPUS_FEATURES,
    min_df: int = MIN_DOCUMENTS,
    null_text: str = "",
) -> TextIndex:
    """Index item texts together with all feedback on them, both fully cleaned.

    The feedback of an item stays in pieces throughout; see ``segment_counts``.
    """
    own = clean_full(items, item_text, dictionaries, null_text=null_text)
    said = clean_full(feedback, feedback_text, dictionaries, null_text=null_text)
    # cleaning and counting are the costly parts, and both are read several times
    segments = cut(corpus_segments(own, said, key, item_text, feedback_text, order_col))
    counts = cut(segment_counts(segments, key), "counts")
    ids = items.select(F.col(key).alias("item_id"))
    return _index(counts, ids, max_features, min_df)


@dataclass(frozen=True)
class ContentTables:
    """Items and feedback with their roles found, and the index over all their text."""

    roles: Roles
    items: DataFrame
    index: TextIndex


def index_tables(
    items: DataFrame,
    feedback: DataFrame,
    dictionaries: Dictionaries,
    order_col: str,
    *,
    rules: Mapping[str, Rule] = RULES,
    max_features: int = FULL_CORPUS_FEATURES,
    min_df: int = MIN_DOCUMENTS,
    null_text: str = "",
) -> ContentTables:
    """From loosely named tables to an index: roles, texts, cleaning, bags, weights.

    An item's text is its description columns put together, a feedback row's text all of its string
    columns; ``order_col`` is a whole number that orders the feedback. Feedback without a column
    that joins it to items is left out. ``items`` of the result are ``(item_id, item_name)``.
    """
    roles = resolve_roles(items, feedback, rules)
    own = items.select(
        F.col(f"`{roles.item_id}`").alias("item_id"),
        F.col(f"`{roles.item_name}`").alias("item_name"),
        join_text(roles.text, null_text).alias("text"),
    )
    key = F.col(f"`{roles.join_key}`") if roles.join_key else F.lit(None)
    said = feedback.select(
        key.cast(own.schema["item_id"].dataType).alias("item_id"),
        F.col(f"`{order_col}`").alias("order"),
        join_all_strings(feedback, null_text).alias("said"),
    ).filter(F.col("item_id").isNotNull())
    index = index_corpus(
        own.select("item_id", "text"),
        said,
        key="item_id",
        item_text="text",
        feedback_text="said",
        order_col="order",
        dictionaries=dictionaries,
        max_features=max_features,
        min_df=min_df,
        null_text=null_text,
    )
    return ContentTables(roles, own.select("item_id", "item_name"), index)


def similar_items(
    index: TextIndex, k: int, seeds: DataFrame | None = None
) -> DataFrame:
    """The ``k`` most similar items of all items, or of ``seeds(seed_id)``."""
    if seeds is not None:
        require_seeds(seeds, index.vectors)
    return similar_by_terms(as_seeds(index.vectors, seeds), index.vectors, k)


class NothingToEvaluateError(ValueError):
    """No item can serve as a seed."""


@dataclass(frozen=True)
class Judgement:
    """The evaluation seeds and what is relevant to each of them."""

    seeds: DataFrame
    relevance: DataFrame


def judge_by_users(interactions: DataFrame, items: DataFrame, n_seeds: int) -> Judgement:
    """Sample seeds among the items and find their relevant items by shared users.

    ``interactions(user_key, item_id)``, ``items(item_id)``. It is an error if no item
    shares users with enough others.
    """
    pairs = cut(distinct_pairs(interactions))
    seeds = cut(sample_seeds(evaluation_candidates(pairs, items), n_seeds))
    if seeds.isEmpty():
        raise NothingToEvaluateError("no item shares users with enough other items")
    return Judgement(seeds, cut(jaccard_relevance(pairs, seeds)))


def evaluate_content(
    judgement: Judgement,
    *,
    index: TextIndex | None = None,
    vectors: dict[str, DataFrame] | None = None,
    n_recommended: int = N_RECOMMENDED,
) -> DataFrame:
    """Per-seed metrics of TF-IDF and of each stored set of vectors, by method name.

    A method is only asked for the seeds it has a vector for.
    """
    lists: list[DataFrame] = []
    asked: list[DataFrame] = []

    def add(method: str, items: DataFrame, similar) -> None:
        seeds = as_seeds(items, judgement.seeds)
        lists.append(label_method(similar(seeds, items, n_recommended), method))
        asked.append(seeds.select(F.lit(method).alias("method"), "seed_id"))

    if index is not None:
        add("tfidf", index.vectors, similar_by_terms)
    for method, items in (vectors or {}).items():
        add(method, items, similar_by_vector)
    return evaluate(union_methods(lists), judgement.relevance, union_methods(asked))


def store_evaluation(per_seed: DataFrame, folder: str, run_id: str) -> tuple[str, str]:
    """Write per-seed metrics and their means as CSV; the paths of both.

    Each run has folders of its own, so earlier runs stay.
    """
    per_seed = cut(per_seed, "evaluation")
    detail = write_results(per_seed, folder, "content_eval_results", run_id)
    return detail, write_results(summarize(per_seed), folder, "content_eval_summary", run_id)
