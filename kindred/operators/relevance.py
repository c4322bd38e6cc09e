"""Which items count as relevant to a seed: overlap of their users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.hashing import mix
from kindred.operators.topk import top_per_seed
from kindred.session import cut

# Relevance lists, candidates and sample of the evaluation.
MOST_RELEVANT = 1000
MIN_RELEVANT = 2
N_SEEDS = 300

# A user with more items than this is dealt into slices, ...
SLICE_ROWS = 100_000
# ... unless that made more such users than this, the most that may be broadcast.
MOST_BUSY = 10_000


def distinct_pairs(
    interactions: DataFrame, user_col: str = "user_key", item_col: str = "item_id"
) -> DataFrame:
    """``(user_key, item_id)`` once each, without nulls."""
    return (
        interactions.select(F.col(user_col).alias("user_key"), F.col(item_col).alias("item_id"))
        .na.drop()
        .distinct()
    )


def busy_users(pairs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(user_key, n_slices)`` of the users with more items than one slice holds.

    A slice holds ``slice_rows`` items or, on very large tables, the part of all rows
    that leaves fewer than ``MOST_BUSY`` users above it. So the result always has fewer rows
    than that and can be broadcast, and no slice outgrows a small share of the table.
    """
    width = max(slice_rows, -(-pairs.count() // MOST_BUSY))
    return (
        pairs.groupBy("user_key")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > width)
        .select("user_key", F.ceil(F.col("n") / width).cast("int").alias("n_slices"))
    )


def partners(pairs: DataFrame, seed_pairs: DataFrame, busy: DataFrame) -> DataFrame:
    """``(seed_id, item_id)`` once for every user they share, the seed itself left out.

    The items of a busy user are dealt into slices by hash, and each of that user's
    seeds goes to all of the slices, so the join's key is never hotter than one slice.
    """
    wide = F.broadcast(busy)
    slices = F.coalesce("n_slices", F.lit(1))
    dealt = pairs.join(wide, "user_key", "left").select(
        "user_key", "item_id", F.pmod(F.xxhash64("item_id"), slices).alias("slice")
    )
    every = F.sequence(F.lit(0).cast("bigint"), (slices - 1).cast("bigint"))
    copied = seed_pairs.join(wide, "user_key", "left").select(
        "seed_id", "user_key", F.explode(every).alias("slice")
    )
    return (
        dealt.join(copied, ["user_key", "slice"])
        .filter(F.col("seed_id") != F.col("item_id"))
        .select("seed_id", "item_id")
    )


def jaccard_relevance(
    pairs: DataFrame,
    seeds: DataFrame,
    topn: int = MOST_RELEVANT,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``(seed_id, item_id, gain, rank)``: shared users over all users of both items.

    ``pairs`` are distinct, ``seeds(seed_id)`` name some items. Only rows of seed
    items look for partners, so a pair (user, item) is met once per seed of that user
    and the work is bounded by pairs times seeds however busy a user is; the union
    comes from the three counts. A user with very many items is joined in slices.
    ``pairs`` is read several times and had better be a written table.
    """
    holders = pairs.groupBy("item_id").agg(F.count("*").alias("n_users"))
    seed_pairs = pairs.join(
        seeds.select(F.col("seed_id").alias("item_id")).distinct(), "item_id", "left_semi"
    ).select(F.col("item_id").alias("seed_id"), "user_key")
    shared = (
        partners(pairs, seed_pairs, busy_users(pairs, slice_rows))
        .groupBy("seed_id", "item_id")
        .agg(F.count("*").alias("n_shared"))
    )
    seed_holders = holders.select(
        F.col("item_id").alias("seed_id"), F.col("n_users").alias("n_seed_users")
    )
    union = F.col("n_seed_users") + F.col("n_users") - F.col("n_shared")
    scored = (
        shared.join(seed_holders, "seed_id")
        .join(holders, "item_id")
        .select("seed_id", "item_id", (F.col("n_shared") / union).alias("gain"))
    )
    return top_per_seed(scored, "gain", topn)


def users_of_few_items(pairs: DataFrame, most: int) -> DataFrame:
    """``(user_key, n_items)`` of the users with at most ``most`` items, written out."""
    degree = pairs.groupBy("user_key").agg(F.count("*").alias("n_items"))
    return cut(degree.filter(F.col("n_items") <= most), "few-items")


def evaluation_candidates(
    pairs: DataFrame, items: DataFrame, min_relevant: int = MIN_RELEVANT
) -> DataFrame:
    """``(item_id)``: items of ``items`` that share users with ``min_relevant`` others.

    A user with more than ``min_relevant`` items settles it for all of them. Only the
    remaining users, whose items are few, are paired up, so the cost is linear in the
    pairs. These users are written first: where they are no large table, the pairs need not be moved to be
    told apart by them.
    """
    rare = users_of_few_items(pairs, min_relevant)
    settled = pairs.join(rare, "user_key", "left_anti").select("item_id").distinct()
    few = pairs.join(rare.filter("n_items > 1"), "user_key", "left_semi").select("user_key", "item_id")
    shared = (
        few.join(few.withColumnRenamed("item_id", "other"), "user_key")
        .filter(F.col("item_id") != F.col("other"))
        .select("item_id", "other")
        .distinct()
        .groupBy("item_id")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_relevant)
        .select("item_id")
    )
    candidates = settled.unionByName(shared).distinct()
    return items.select("item_id").join(candidates, "item_id", "left_semi")


def sample_seeds(
    candidates: DataFrame, n: int = N_SEEDS, seed: int = 42
) -> DataFrame:
    """``(seed_id)``: ``n`` candidates without replacement, the same ones on every run.

    All of them if there are fewer.
    """
    key = F.col("item_id")
    if not isinstance(candidates.schema["item_id"].dataType, T.IntegralType):
        key = F.xxhash64(key)
    return (
        candidates.select("item_id", mix(key, seed).alias("_mix"))
        .orderBy("_mix", "item_id")
        .limit(n)
        .select(F.col("item_id").alias("seed_id"))
    )
