"""Answers to many requests at once: free-text search and look-alikes by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.neighbors import (
    as_seeds,
    first_by_name,
    similar_by_terms,
    similar_by_vector,
    with_names,
)
from kindred.plans.content import TextIndex, light_counts
from kindred.session import cut

# Fixed value: how many items a page shows.
PAGE = 9


def search(
    index: TextIndex, queries: DataFrame, id_col: str, text_col: str, k: int = PAGE
) -> DataFrame:
    """``(seed_id, item_id, similarity, rank)``: the best items for each query text."""
    ids = queries.select(F.col(id_col).alias("item_id"))
    weighed = cut(index.model.weigh(light_counts(queries, id_col, text_col), ids))
    return similar_by_terms(as_seeds(weighed), index.vectors, k, keep_self=True)


def search_rows(
    index: TextIndex,
    items: DataFrame,
    queries: DataFrame,
    id_col: str,
    text_col: str,
    k: int = PAGE,
) -> DataFrame:
    """The hits of :func:`search` with the whole rows of ``items(item_id, ...)``.

    Only the rows of hits are looked for. An item that was indexed but has no row keeps its
    hit with nulls. Columns of items named like those of a hit are refused.
    """
    taken = {"seed_id", "similarity", "rank"} & set(items.columns)
    if taken:
        raise ValueError(f"columns named like those of a hit: {', '.join(sorted(taken))}")
    return search(index, queries, id_col, text_col, k).join(items, "item_id", "left")


def similar_by_name(
    items: DataFrame, vectors: DataFrame | TextIndex, names: DataFrame, k: int = PAGE
) -> DataFrame:
    """Look-alikes of the first item of each requested name, with item names.

    ``vectors`` are stored vectors or a text index. A name whose item has no vector gets no rows.
    """
    seeds = first_by_name(items, names)
    if isinstance(vectors, TextIndex):
        found = similar_by_terms(as_seeds(vectors.vectors, seeds), vectors.vectors, k)
    else:
        found = similar_by_vector(as_seeds(vectors, seeds), vectors, k)
    return with_names(found, items)
