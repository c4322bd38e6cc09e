"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are whole numbers. A bounded set of pivots, data vectors picked by a hash of their ids,
cuts space into cells; every vector belongs to its nearest pivot. Each cell is
summed up by its size, its largest norm and its few vectors nearest to the pivot. The
summaries go to all tasks, and there give each query a floor for its k-th best score: the k-th
best among the summaries' vectors. With the floor, a query bounds where in a cell a better
vector can lie: at distance d from pivot p, its score is at most ``q.p + |q| d`` (Cauchy-Schwarz)
and at most ``(|q|^2 + R^2 - (|q - p| - d)^2) / 2`` (triangle inequality, R the cell's
largest norm). Queries are grouped by cells, groups keep one range of distances for each cell, and
a data vector is sent only to the groups whose range holds its distance. Groups and cells are
cut into blocks of bounded size, each pair of blocks is solved by one matrix product, and the
best ``k`` of the blocks are merged.

The bounds only ever keep more than is needed, so the result is exact; ties go to the lower id.
All scores are 64-bit whole numbers, exact whatever their size. Pivots, summaries and ranges are bounded by
``MOST_PIVOTS`` (squared, for the ranges) whatever the number of vectors.

Defined cases: null and empty vectors, vectors with a null or non-finite component or too large for scores
of 64 bits, and rows without an id take no part; vectors of different lengths are not compared, every
length is searched by itself; rows that repeat an id count once, as the lowest vector; a query with fewer than
``k`` candidates gets them all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.vectors import matrix, products, usable, whole
from kindred.llm.words import column
from kindred.session import cut

K = 5
#: Vectors that one pivot stands for, and most pivots there are.
PER_PIVOT, MOST_PIVOTS = 2_000, 1_024
#: Queries of one group, and of one block; data vectors of one block.
GROUP, QUERY_BLOCK, DATA_BLOCK = 2_000, 2_000, 8_000


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id`` and ``v``: each component x as floor(scale * x)."""
    return (
        vectors.where(F.col(id_col).isNotNull() & usable(vector_col, scale))
        .select(F.col(id_col).cast("bigint").alias("vec_id"), whole(vector_col, scale).alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def _matrix(batch: pa.RecordBatch | pa.Table, name: str, width: int) -> np.ndarray:
    return matrix(batch, name, width).astype(np.float64)


def _cells(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the distance to it."""
    square = (
        (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    )
    cell = square.argmin(axis=1)
    return cell, np.sqrt(np.maximum(square[np.arange(len(rows)), cell], 0.0))


def _summaries(data: DataFrame, pivots: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Of each cell its largest norm and distance, and ``k + 1`` vectors next to the pivot."""
    width = pivots.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, ids = _matrix(batch, "v", width), column(batch, "vec_id").to_numpy()
            cell, away = _cells(rows, pivots)
            norm = np.sqrt((rows**2).sum(axis=1))
            order = np.lexsort((ids, away, cell))
            at = np.flatnonzero(np.diff(cell[order], prepend=-1) != 0)
            place = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
            near = order[place <= k]
            top_norm, top_away = np.zeros(len(pivots)), np.zeros(len(pivots))
            np.maximum.at(top_norm, cell, norm)
            np.maximum.at(top_away, cell, away)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell[near]),
                    pa.array(away[near]),
                    pa.array(ids[near]),
                    pa.array(rows[near].astype(np.int64).tolist(), pa.list_(pa.int64())),
                    pa.array(top_norm[cell[near]]),
                    pa.array(top_away[cell[near]]),
                ],
                ["cell", "away", "vec_id", "v", "norm", "radius"],
            )

    found = data.mapInArrow(
        work, "cell bigint, away double, vec_id bigint, v array<bigint>, norm double, radius double"
    )
    # every batch gives at most k + 1 rows a cell; of these each cell keeps k + 1
    by_cell = Window.partitionBy("cell")
    kept = (
        found.withColumn("place", F.row_number().over(by_cell.orderBy("away", "vec_id")))
        .withColumn("norm", F.max("norm").over(by_cell))
        .withColumn("radius", F.max("radius").over(by_cell))
        .where(F.col("place") <= k + 1)
        .toArrow()
    )
    norm, radius = np.full(len(pivots), -1.0), np.zeros(len(pivots))
    cell = kept["cell"].to_numpy()
    norm[cell] = kept["norm"].to_numpy()
    radius[cell] = kept["radius"].to_numpy()
    order = np.argsort(kept["vec_id"].to_numpy())
    return {
        "norm": norm,
        "radius": radius,
        "ids": kept["vec_id"].to_numpy()[order],
        "rows": _matrix(kept, "v", width)[order],
    }


def _grouped(pivots: np.ndarray, groups: int) -> np.ndarray:
    """A group for each pivot: centres far from one another, every pivot at its nearest."""
    centres = [0]
    away = ((pivots - pivots[0]) ** 2).sum(axis=1)
    while len(centres) < groups:
        centres.append(int(away.argmax()))
        away = np.minimum(away, ((pivots - pivots[centres[-1]]) ** 2).sum(axis=1))
    return _cells(pivots, pivots[centres])[0]


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """The ``k`` rows of highest inner product for each row where ``is_query`` holds.

    ``vectors`` holds ``vec_id`` and ``v`` (whole numbers), see ``whole_numbers``; a query's own
    row is no candidate. ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.
    """
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    data = cut(vectors.withColumn("width", F.size("v")), "vectors")
    asked = data.where(is_query).select("width").distinct().orderBy("width")
    found = vectors.sparkSession.createDataFrame([], result)
    for row in asked.collect():  # the different lengths, one as a rule
        of_width = data.where(F.col("width") == row["width"]).select("vec_id", "v")
        found = found.union(_search(of_width, is_query, k, row["width"]))
    return found


def _search(data: DataFrame, is_query: Column, k: int, width: int) -> DataFrame:
    """``search`` among vectors of one length."""
    rows, n_queries = data.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    n_pivots = int(min(MOST_PIVOTS, max(1, rows // PER_PIVOT)))
    # bounded by MOST_PIVOTS
    picked = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).select("v").toArrow()
    pivots = np.unique(_matrix(picked, "v", width), axis=0)
    group_of = _grouped(pivots, int(min(len(pivots), max(1, -(-n_queries // GROUP)))))
    summary = _summaries(data, pivots, k)

    def bounds(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group of each query, and the distances in each cell at which a better row can be."""
        q, ids = _matrix(batch, "v", width), column(batch, "vec_id").to_numpy()
        scores = q @ summary["rows"].T
        scores[ids[:, None] == summary["ids"][None, :]] = -np.inf
        floor = np.full(len(q), -np.inf)
        if scores.shape[1] >= k:
            floor = np.partition(scores, -k, axis=1)[:, -k]
        norm = np.sqrt((q**2).sum(axis=1))[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = (floor[:, None] - q @ pivots.T) / norm
        least = np.where(norm > 0, least, -np.inf)
        gap = np.sqrt(
            np.maximum(
                (norm**2) + (pivots**2).sum(axis=1)[None, :] - 2 * q @ pivots.T, 0.0
            )
        )
        room = norm**2 + summary["norm"][None, :] ** 2 - 2 * floor[:, None]
        reach = np.sqrt(np.maximum(room, 0.0))
        slack = 1e-6 * (1.0 + gap + reach + norm)
        low = np.maximum(least, gap - reach) - slack
        high = np.where(room >= -1e-6, gap + reach, -np.inf) + slack
        cell, _ = _cells(q, pivots)
        return group_of[cell], low, high

    def query_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (group_of.max() + 1, len(pivots))
        low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
        for batch in batches:
            if batch.num_rows:
                group, a, b = bounds(batch)
                np.minimum.at(low, group, np.where(a <= b, a, np.inf))
                np.maximum.at(high, group, np.where(a <= b, b, -np.inf))
        at = np.argwhere(low <= high)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(at[:, 0]),
                pa.array(at[:, 1]),
                pa.array(low[low <= high]),
                pa.array(high[low <= high]),
            ],
            ["g", "cell", "low", "high"],
        )

    queries = data.where(is_query)
    # at most groups * pivots rows
    ranges = (
        queries.mapInArrow(query_ranges, "g bigint, cell bigint, low double, high double")
        .groupBy("g", "cell")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .toArrow()
    )
    low = np.full((group_of.max() + 1, len(pivots)), np.inf)
    high = np.full(low.shape, -np.inf)
    low[ranges["g"].to_numpy(), ranges["cell"].to_numpy()] = ranges["low"].to_numpy()
    high[ranges["g"].to_numpy(), ranges["cell"].to_numpy()] = ranges["high"].to_numpy()

    def group_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, _ = _cells(_matrix(batch, "v", width), pivots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group_of[cell]), column(batch, "vec_id"), column(batch, "v")],
                    ["g", "vec_id", "v"],
                )

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, away = _cells(_matrix(batch, "v", width), pivots)
                need = (low[:, cell] <= away) & (away <= high[:, cell])
                g, row = np.nonzero(need)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), column(batch, "vec_id").take(taken), column(batch, "v").take(taken)],
                    ["g", "vec_id", "v"],
                )

    schema = "g bigint, vec_id bigint, v array<bigint>"
    asked = cut(queries.mapInArrow(group_queries, schema), "asked")
    sent = cut(data.mapInArrow(replicate, schema), "sent")

    def blocks_of(rows: DataFrame, most: int, name: str) -> DataFrame:
        sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
        return sizes

    sizes = blocks_of(asked, QUERY_BLOCK, "nq").join(blocks_of(sent, DATA_BLOCK, "nd"), "g")
    sizes = cut(sizes, "blocks")
    every = F.sequence(F.lit(0), F.col("nd") - 1)
    left = asked.join(sizes, "g").select(
        "g",
        # both sides' keys must be of one type: cogrouping hashes them as they are
        F.pmod(F.xxhash64("vec_id"), F.col("nq")).cast("int").alias("bq"),
        F.explode(every).alias("bd"),
        "vec_id",
        "v",
    )
    right = sent.join(sizes, "g").select(
        "g",
        F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"),
        F.pmod(F.xxhash64("vec_id"), F.col("nd")).cast("int").alias("bd"),
        "vec_id",
        "v",
    )

    def solve(own: pa.Table, other: pa.Table) -> pa.Table:
        other = other.sort_by("vec_id")
        q, ids = matrix(own, "v", width), own["vec_id"].to_numpy()
        x, to = matrix(other, "v", width), other["vec_id"].to_numpy()
        lowest = np.iinfo(np.int64).min  # no score: those are above -9e18
        out: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        for i in range(0, len(q) if len(x) else 0, 256):
            scores = products(q[i : i + 256], x)
            scores[ids[i : i + 256, None] == to[None, :]] = lowest
            most = min(k, scores.shape[1])
            least = np.partition(scores, -most, axis=1)[:, -most]
            for j, row in enumerate(scores):
                at = np.flatnonzero((row >= least[j]) & (row > lowest))
                at = at[np.lexsort((to[at], -row[at]))][:k]
                out.append(np.column_stack([np.full(len(at), ids[i + j]), to[at], row[at]]).astype(np.int64))
        rows = np.concatenate(out)
        return pa.table({"query_id": rows[:, 0], "vec_id": rows[:, 1], "score": rows[:, 2]})

    best = left.groupBy("g", "bq", "bd").cogroup(right.groupBy("g", "bq", "bd")).applyInArrow(
        solve, "query_id bigint, vec_id bigint, score bigint"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        best.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
