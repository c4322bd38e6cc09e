"""Mixing sources to target weights by entropy balancing.

Documents start at rate 1 (taken once). Among all rates between 0 and ``cap`` under which
each source's tokens add up to its target, those nearest to 1 in entropy are
``min(cap, exp(lambda * size))`` with one multiplier ``lambda`` for each source's token
constraint. The multipliers solve the convex dual; they are found by Newton iterations
over all sources at once, each a distributed sum over the counts of documents by source
and size, kept inside a bracket so that every step is safe. Tilted rates are then rounded
to whole copies: going from large to small sizes, each size takes the number of copies
that brings the source's running total nearest to its due, and those copies are dealt
evenly to the documents of that size in the order of a hash of their ids.

Sources are ordered by code point with null last and weigh ``WEIGHTS`` in turn. Targets share
the total of all sizes by weight; a source stops at ``cap`` times its own size, and what is
left is shared again by weight among the others until none is above.

Nothing is collected but a few totals. A source that holds a third of all documents is
summed before it is shuffled and dealt in slices of its documents.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source of
its own; sources whose texts are all empty have target 0; an empty table gives an empty result;
repeated rows are documents of their own, rows that repeat an id too. Extra columns are
ignored, ``mixed_copies`` keeps them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.words import WORD
from kindred.session import cut

# Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
CAP = 3
#: A source's tokens come this near to its target before rounding.
TOLERANCE = 1e-9
STEPS = 100
#: Slices that the documents of one source and size are ranked in.
SLICES = 64


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source`` and ``size``, the number of words."""
    return docs.select(
        docs[id_col].alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD)), F.lit(0))
        .cast("bigint")
        .alias("size"),
    )


def targets(counts: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from counts by ``source``, ``size`` and ``n``."""
    sources = cut(
        counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
        "sources",
    )
    # ranks without a single task: sources are sorted in ranges, and each range knows how
    # many sources come before it
    ordered = cut(
        sources.where("source IS NOT NULL").repartitionByRange(16, "source").select(
            F.spark_partition_id().alias("part"), "source", "source_size"
        ),
        "ordered",
    )
    before = {}
    have = 0
    for row in ordered.groupBy("part").count().orderBy("part").collect():  # at most 16 rows
        before[row["part"]] = have
        have += row["count"]
    offset = F.lit(0)
    for part, n in before.items():
        offset = F.when(F.col("part") == part, n).otherwise(offset)
    in_part = Window.partitionBy("part").orderBy("source")
    ranked = ordered.select(
        "source", "source_size", (F.row_number().over(in_part) - 1 + offset).alias("rank")
    ).union(
        sources.where("source IS NULL").select("source", "source_size", F.lit(have).alias("rank"))
    )
    weight = F.lit(float(weights[0]))
    for i, w in enumerate(weights):
        weight = F.when(F.col("rank") % len(weights) == i, float(w)).otherwise(weight)
    weighed = cut(ranked.select("source", "source_size", weight.alias("weight")), "weights")

    limit = cap * F.col("source_size")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = 0.0  # words for each unit of weight
    while True:
        full = limit < level * F.col("weight")
        held, open_ = weighed.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        new = (total - held) / open_ if open_ else level
        if new <= level:
            break
        level = new
    return weighed.select(
        "source",
        "source_size",
        F.least(limit.cast("double"), F.lit(level) * F.col("weight")).alias("target"),
    )


def multipliers(counts: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """``source``, ``target``, ``scale`` and ``lam``: rates are ``rate(size)``.

    ``lam`` is for sizes in units of ``scale``, the source's mean size. It is infinite where
    the target is the most that the source can give.
    """
    facts = counts.where("size > 0").groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"),
        F.min("size").alias("least"),
    )
    top = F.log(F.lit(float(cap))) * F.col("scale") / F.col("least")
    full = F.col("target") >= cap * F.col("source_size") * (1 - TOLERANCE)
    state = cut(
        wanted.join(facts, wanted["source"].eqNullSafe(facts["source"]))
        .select(
            wanted["source"],
            "target",
            "scale",
            F.when(full, F.lit(float("inf"))).otherwise(0.0).alias("lam"),
            F.lit(float("-inf")).alias("low"),
            top.alias("high"),
            (full | (F.col("target") <= 0)).alias("done"),
        ),
        "duals",
    )
    for _ in range(STEPS):
        if state.where("NOT done").isEmpty():
            break
        x = F.col("size") / F.col("scale")
        free = F.exp(F.col("lam") * x)
        words = F.col("size") * F.col("n")
        sums = (
            counts.join(state.where("NOT done"), counts["source"].eqNullSafe(state["source"]))
            .groupBy(state["source"])
            .agg(
                F.sum(words * F.least(free, F.lit(float(cap)))).alias("got"),
                F.sum(F.when(free < cap, words * free * x).otherwise(0.0)).alias("slope"),
            )
            .select(F.col("source").alias("of"), "got", "slope")
        )
        low = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("got") > F.col("target"), F.col("lam")).otherwise(F.col("high"))
        middle = F.when(
            F.col("new_low") == F.lit(float("-inf")), 2 * F.least(F.col("lam"), F.lit(-1.0))
        ).otherwise((F.col("new_low") + F.col("new_high")) / 2)
        newton = F.col("lam") + (F.col("target") - F.col("got")) / F.col("slope")
        safe = (F.col("slope") > 0) & (newton > F.col("new_low")) & (newton < F.col("new_high"))
        close = F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.col("target") + 0.01
        stepped = (
            state.where("NOT done")
            .join(sums, F.col("source").eqNullSafe(F.col("of")))
            .withColumn("new_low", low)
            .withColumn("new_high", high)
            .select(
                "source",
                "target",
                "scale",
                F.when(close, F.col("lam")).when(safe, newton).otherwise(middle).alias("lam"),
                F.col("new_low").alias("low"),
                F.col("new_high").alias("high"),
                close.alias("done"),
            )
        )
        state = cut(state.where("done").union(stepped), "duals")
    return state.select("source", "target", "scale", "lam")


def rate(cap: float = CAP) -> Column:
    """The tilted rate of a ``size`` under ``lam`` and ``scale``."""
    tilted = F.when(F.col("lam") == float("inf"), float(cap)).otherwise(
        F.exp(F.col("lam") * F.col("size") / F.col("scale"))
    )
    return F.when(F.col("target") > 0, F.least(tilted, F.lit(float(cap)))).otherwise(0.0)


def _rounded(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for each size of one source, the running total kept near what is due.

    A source of W words has at most sqrt(2 W) different sizes, so the rows are few.
    """
    rows = rows.sort_values("size", ascending=False)
    due, taken, copies = 0.0, 0, []
    for size, n, each, cap in zip(rows["size"], rows["n"], rows["rate"], rows["cap"]):
        due += size * n * each
        most = int(cap) * n
        copies.append(int(min(most, max(0, round((due - taken) / size)))))
        taken += copies[-1] * size
    return rows[["source", "size", "n"]].assign(copies=copies)


def rounded(counts: DataFrame, duals: DataFrame, cap: int = CAP) -> DataFrame:
    """``source``, ``size``, ``n`` and the ``copies`` that all documents of that size take."""
    rated = counts.where("size > 0").join(duals, counts["source"].eqNullSafe(duals["source"])).select(
        counts["source"], "size", "n", rate(cap).alias("rate"), F.lit(cap).alias("cap")
    )
    return rated.groupBy("source").applyInPandas(
        _rounded, "source string, size bigint, n bigint, copies bigint"
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, source, text).

    ``doc_id``, ``size``, ``source``, ``source_size``, ``target`` and ``copies`` (0 to ``cap``).
    """
    rows = cut(sized(docs).withColumn("mix_order", F.xxhash64("doc_id")), "sizes")
    counts = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    wanted = cut(targets(counts, weights, cap), "targets")
    duals = multipliers(counts, wanted, cap)
    plan = cut(rounded(counts, duals, cap), "plan")

    place = F.pmod(F.shiftright("mix_order", 40), F.lit(SLICES)).alias("slice")
    sliced = rows.select("*", place)
    own = Window.partitionBy("source", "size", "slice").orderBy("mix_order", "doc_id")
    starts = (
        sliced.groupBy("source", "size", "slice")
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn(
            "start",
            F.sum("m").over(Window.partitionBy("source", "size").orderBy("slice")) - F.col("m"),
        )
    )
    ranked = sliced.withColumn("rank", F.row_number().over(own) - 1)
    steps = starts.join(
        plan.select(F.col("source").alias("ps"), F.col("size").alias("pz"), "n", "copies"),
        F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")),
        "left",
    ).select(
        F.col("source").alias("ss"),
        F.col("size").alias("sz"),
        F.col("slice").alias("sl"),
        "start",
        "n",
        "copies",
    )
    placed = ranked.join(
        steps,
        F.col("source").eqNullSafe(F.col("ss"))
        & (F.col("size") == F.col("sz"))
        & (F.col("slice") == F.col("sl")),
    ).withColumn("at", F.col("rank") + F.col("start"))

    def until(i: Column) -> Column:
        return F.floor(i * F.col("copies") / F.col("n"))

    copies = F.coalesce(until(F.col("at") + 1) - until(F.col("at")), F.lit(0)).cast("bigint")
    dealt = placed.select("doc_id", "size", "source", copies.alias("copies"))
    goal = wanted.select(F.col("source").alias("of"), "source_size", "target")
    return dealt.join(goal, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source", "source_size", "target", "copies"
    )


def mixed_copies(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, all columns kept.

    ``mix_copy`` counts a row's copies from 1. Rows are told apart by id, source and size; rows
    that repeat all three share out what the mix takes of them.
    """
    names = [c for c in docs.columns if c != "mix_copy"]
    key = F.xxhash64("doc_id", "source", "size")
    dealt = cut(mix(docs, weights, cap).select(key.alias("__mix"), "copies"), "dealt")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    own_key = F.xxhash64("doc_id", F.col("source").cast("string"), size)
    keyed = docs.select(*names, own_key.alias("__key"))

    def repeated(rows: DataFrame, plan: DataFrame, by: Column) -> DataFrame:
        return rows.join(plan.where("copies > 0"), by).select(
            *names, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("mix_copy")
        )

    same_key = F.col("__key") == F.col("__mix")
    several = cut(dealt.groupBy("__mix").count().where("count > 1").select("__mix"), "several")
    if several.isEmpty():
        return repeated(keyed, dealt, same_key)
    once = repeated(keyed, dealt.join(several, "__mix", "left_anti"), same_key)
    number = F.row_number().over(Window.partitionBy("__key").orderBy("text")).alias("__row")
    rows = keyed.join(several, same_key, "left_semi").select("*", number)
    plan = dealt.join(several, "__mix", "left_semi").select(
        "*",
        F.row_number().over(Window.partitionBy("__mix").orderBy(F.desc("copies"))).alias("__nth"),
    )
    return once.union(repeated(rows, plan, same_key & (F.col("__row") == F.col("__nth"))))
