"""Precision, average precision and two kinds of NDCG for any recommender.

Recommendations are rows ``(method, seed_id, item_id, rank)``, relevance is rows
``(seed_id, item_id, gain, rank)``. Rank-based sums replace all looping, and every
cut-off is computed from one pass over the joined rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.labels import method_label

# Cut-offs, and the length of the recommended lists.
CUTOFFS = (5, 10, 20)
N_RECOMMENDED = 200

NO_METHOD = "method string, seed_id bigint, item_id bigint, rank bigint"


def discount(rank: Column) -> Column:
    """What a hit at a rank is worth: ``1 / log2(rank + 1)``."""
    return 1.0 / F.log2(rank + 1.0)


def graded_gain(gain: Column) -> Column:
    return F.pow(F.lit(2.0), gain) - 1.0


def _per_cutoff(cutoffs: Sequence[int]) -> Column:
    return F.explode(F.array(*[F.lit(k) for k in cutoffs]).cast("array<bigint>"))


def label_method(similar: DataFrame, method: str) -> DataFrame:
    return similar.select(F.lit(method).alias("method"), "seed_id", "item_id", "rank")


def union_methods(frames: Sequence[DataFrame | None]) -> DataFrame:
    """Stack the methods that exist; no row if none does."""
    present = [f for f in frames if f is not None]
    if not present:
        return SparkSession.active().createDataFrame([], NO_METHOD)
    return reduce(lambda a, b: a.unionByName(b), present)


def judged(recommended: DataFrame, relevance: DataFrame) -> DataFrame:
    """Each recommended row with ``hit``, its ``gain`` (0 on a miss) and hits so far."""
    gains = relevance.select("seed_id", "item_id", "gain")
    so_far = (
        Window.partitionBy("method", "seed_id")
        .orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        recommended.join(gains, ["seed_id", "item_id"], "left")
        .withColumn("hit", F.col("gain").isNotNull().cast("bigint"))
        .withColumn("gain", F.coalesce("gain", F.lit(0.0)))
        .withColumn("hits", F.sum("hit").over(so_far))
    )


def _ideals(relevance: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """Per seed and cut-off: the number relevant, the ideal binary sum over *all* of
    them, and the ideal graded sum over the best ``k``."""
    graded = F.when(
        F.col("rank") <= F.col("k"), graded_gain(F.col("gain")) * discount(F.col("rank"))
    )
    return (
        relevance.withColumn("k", _per_cutoff(cutoffs))
        .groupBy("seed_id", "k")
        .agg(
            F.count("*").alias("n_rel"),
            F.sum(discount(F.col("rank"))).alias("ideal_bin"),
            F.sum(graded).alias("ideal_grd"),
        )
    )


def evaluate(
    recommended: DataFrame,
    relevance: DataFrame,
    seeds: DataFrame,
    cutoffs: Sequence[int] = CUTOFFS,
) -> DataFrame:
    """``(method, k, seed_id, precision, map, ndcg_bin, ndcg_grd, n_rel)``.

    ``seeds(method, seed_id)`` names who is scored, so that a seed without any
    recommendation counts as zero.
    """
    at_k = (
        judged(recommended.filter(F.col("rank") <= max(cutoffs)), relevance)
        .withColumn("k", _per_cutoff(cutoffs))
        .filter(F.col("rank") <= F.col("k"))
    )
    hit, rank = F.col("hit"), F.col("rank")
    reached = at_k.groupBy("method", "seed_id", "k").agg(
        F.sum(hit).alias("n_hits"),
        F.sum(hit * F.col("hits") / rank).alias("ap_sum"),
        F.sum(hit * discount(rank)).alias("dcg_bin"),
        F.sum(graded_gain(F.col("gain")) * discount(rank)).alias("dcg_grd"),
    )
    full = (
        seeds.select("method", "seed_id")
        .withColumn("k", _per_cutoff(cutoffs))
        .join(reached, ["method", "seed_id", "k"], "left")
        .join(_ideals(relevance, cutoffs), ["seed_id", "k"], "left")
        .na.fill(0, ["n_hits", "n_rel"])
    )

    def share(part: str, ideal: str) -> Column:
        ratio = F.try_divide(F.coalesce(F.col(part), F.lit(0.0)), F.col(ideal))
        return F.coalesce(ratio, F.lit(0.0))

    possible = F.greatest(F.least(F.col("n_rel"), F.col("k")), F.lit(1))
    return full.select(
        "method",
        "k",
        "seed_id",
        (F.col("n_hits") / F.col("k")).alias("precision"),
        (F.coalesce("ap_sum", F.lit(0.0)) / possible).alias("map"),
        share("dcg_bin", "ideal_bin").alias("ndcg_bin"),
        share("dcg_grd", "ideal_grd").alias("ndcg_grd"),
        "n_rel",
    )


METRICS = ("precision", "map", "ndcg_bin", "ndcg_grd")


def summarize(per_seed: DataFrame) -> DataFrame:
    """The mean of each metric per method and cut-off, sorted, with a chart label."""
    return (
        per_seed.groupBy("method", "k")
        .agg(*[F.avg(m).alias(m) for m in METRICS])
        .withColumn("label", method_label(F.col("method"), F.col("k")))
        .orderBy("k", "method")
    )
