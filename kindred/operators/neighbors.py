"""The most similar items of each seed, by cosine.

As in a dense similarity matrix, items without anything in common have similarity 0
and still fill up a short list. Scores are rounded to six decimals before ranking and
ties go to the lower item id, so the result is the same on every run. How the lists are found
without comparing all with all is told in :mod:`kindred.operators.topk`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.topk import TERMS, VECTORS, top


def similar_by_terms(
    seeds: DataFrame, items: DataFrame, k: int, *, keep_self: bool = False
) -> DataFrame:
    """``(seed_id, item_id, similarity, rank)`` over unit-length sparse vectors.

    ``seeds(seed_id, idx, weight)`` are items, or queries weighed with the same
    vocabulary (then with ``keep_self``).
    """
    return top(items, seeds, TERMS, k, keep_self)


def similar_by_vector(
    seeds: DataFrame, items: DataFrame, k: int, *, keep_self: bool = False
) -> DataFrame:
    """The same over dense vectors ``(seed_id, embedding)`` and ``(item_id, embedding)``.

    All vectors have one length; a zero vector has similarity 0 to everything.
    """
    return top(items, seeds, VECTORS, k, keep_self)


def as_seeds(items: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Item vectors as seeds: all of them, or those named in ``wanted(seed_id)``."""
    seeds = items.withColumnRenamed("item_id", "seed_id")
    if wanted is None:
        return seeds
    return seeds.join(wanted.select("seed_id"), "seed_id", "left_semi")


def unknown_seeds(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """The requested ``seed_id`` values that no item has."""
    known = items.select(F.col("item_id").alias("seed_id"))
    return wanted.join(known, "seed_id", "left_anti").select("seed_id").distinct()


class UnknownSeedError(ValueError):
    """A requested seed is not an item."""


def require_seeds(wanted: DataFrame, items: DataFrame) -> None:
    """Raise if any requested seed is unknown, naming a few of them."""
    missing = unknown_seeds(wanted, items).orderBy("seed_id").limit(10).collect()
    if missing:
        raise UnknownSeedError(
            f"not among the items: {', '.join(str(r['seed_id']) for r in missing)}"
        )


def first_by_name(items: DataFrame, names: DataFrame) -> DataFrame:
    """``(item_name, seed_id)``: the first item, by id, of each requested name."""
    return (
        items.join(names.select("item_name"), "item_name", "left_semi")
        .groupBy("item_name")
        .agg(F.min("item_id").alias("seed_id"))
    )


def with_names(similar: DataFrame, items: DataFrame) -> DataFrame:
    """Add the item name to a list of similar items."""
    return similar.join(items.select("item_id", "item_name"), "item_id", "left").select(
        "seed_id", "item_id", "item_name", "similarity", "rank"
    )
