"""Hard negatives from blocks of vectors in Hilbert order, with zone maps.

An anchor's positives are its best rows of the same label by inner product. For each positive, its
hard negatives are the best rows of other labels whose score lies in a window below the
positive's score.

All rows are sorted by label and place on a Hilbert curve through the (coarsened) space, and
written as Parquet blocks of ``BLOCK`` neighbouring rows. A block is one row of the file: its vectors, and
beside them a zone map of its labels and of the least and largest value in each dimension. Zone maps are read
without the vectors. From an anchor and a zone map, interval arithmetic gives a lowest and a highest
score that any row of the block can have, so a block is read for an anchor only if

- for positives, its highest possible score reaches the ``k``-th best that the anchor finds in
  the blocks that look best for it, and it has rows of the anchor's label;
- for negatives, its range of scores meets one of the anchor's windows, and it has rows of other labels.

Bounds only decide which blocks are not read, so the result is exact; ties go to the lower id. Scores
are 64-bit whole numbers. Anchors and zone maps meet in cells of bounded size, anchors and blocks
block by block; no task holds all of either. A label that a third of all rows have fills more blocks,
nothing else. Rows of each block are cut to ``k`` for each anchor and window before they are shuffled.

Defined cases: rows without an id or label, null and empty vectors, vectors with a null or non-finite
component or too large for scores of 64 bits take no part; vectors of different lengths are
not compared; rows that repeat an id count once, as the lowest vector and then the lowest label; an anchor
with fewer than ``k`` others of its label has those as positives; a positive of negative score has an
empty window; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.vectors import matrix, products, usable, whole
from kindred.llm.words import column
from kindred.session import cut

K = 5
#: The window reaches from this share of the positive's score, in hundredths, up to the score.
SHARE = 80
#: Rows of one block, and anchors of one group, as a power of two; zone maps and anchors of one cell.
BLOCK, GROUP_BITS, ZONES, ANCHORS = 1_024, 10, 4_096, 8_192
#: Dimensions that the curve runs through (the first ones), and bits of each.
CURVE_DIMENSIONS, CURVE_BITS = 64, 4
#: Slices in which the rows of one anchor are merged.
SLICES = 32


def candidates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
) -> DataFrame:
    """``vec_id``, ``label`` and ``v`` (whole numbers) of the rows that take part, one for each id."""
    return (
        vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector_col, scale))
        .select(
            F.col(id_col).cast("bigint").alias("vec_id"),
            F.struct(whole(vector_col, scale).alias("v"), F.col(label_col).cast("bigint").alias("label")).alias("row"),
        )
        .groupBy("vec_id")
        .agg(F.min("row").alias("row"))
        .select("vec_id", "row.label", "row.v")
    )


def hilbert_keys(rows: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates below ``2**bits``, as bytes to sort by.

    The coordinates are turned, bit by bit from the highest, into the curve's own
    frame (Skilling's transposed form), and their bits are then interleaved.
    """
    x = rows.T.astype(np.uint32).copy()
    for bit in range(bits - 1, 0, -1):
        high, below = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for axis in x:
            turned = (axis & high) != 0
            swap = np.where(turned, np.uint32(0), (x[0] ^ axis) & below)
            x[0] ^= np.where(turned, below, swap)
            axis ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros(x.shape[1], np.uint32)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint32(bit)) & 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= flip
    # bits of all axes, the highest of each first
    planes = [(x >> np.uint32(bit)) & 1 for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def on_curve(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``width`` and ``place``, which sorts them along the curve."""
    low, high = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    low, span = float(low or 0), max(1.0, float(high or 0) - float(low or 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "v")
            sizes = lists.value_lengths().to_numpy()
            places = np.empty(len(sizes), object)
            for width in np.unique(sizes):
                mine = np.flatnonzero(sizes == width)
                v = matrix(batch.take(pa.array(mine)), "v", int(width))[:, :CURVE_DIMENSIONS]
                cells = ((v - low) / span * ((1 << CURVE_BITS) - 1e-6)).astype(np.int64)
                for i, key in zip(mine, hilbert_keys(cells)):
                    places[i] = key.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int32()), pa.array(places, pa.binary())],
                [*batch.schema.names, "width", "place"],
            )

    return rows.mapInArrow(
        work, "vec_id bigint, label bigint, v array<bigint>, width int, place binary"
    )


ORDER = ["width", "label", "place", "vec_id"]
ZONE = "block bigint, width int, n int, label_low bigint, label_high bigint, low array<bigint>, high array<bigint>"


def blocks(sorted_rows: DataFrame) -> DataFrame:
    """Blocks of up to ``BLOCK`` neighbouring rows, one row each; vectors as bytes."""

    def packed(number: int, width: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        numbers = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([width], pa.int32()),
                pa.array([len(ids)], pa.int32()),
                pa.array([labels.min()], pa.int64()),
                pa.array([labels.max()], pa.int64()),
                pa.array([v.min(axis=0)], numbers),
                pa.array([v.max(axis=0)], numbers),
                *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (ids, labels, v)),
            ],
            ["block", "width", "n", "label_low", "label_high", "low", "high", "ids", "labels", "vectors"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            kept = rows if kept is None else pa.concat_tables([kept, rows])
            while kept.num_rows:
                widths = kept["width"].to_numpy()
                same = int(np.argmax(widths != widths[0])) if (widths != widths[0]).any() else len(widths)
                if same == len(widths) and same < BLOCK:
                    break  # more of this block may follow
                part = kept.slice(0, min(same, BLOCK))
                yield _of(packed, number, part)
                number, kept = number + 1, kept.slice(part.num_rows)
        if kept is not None and kept.num_rows:
            yield _of(packed, number, kept)

    return sorted_rows.mapInArrow(work, ZONE + ", ids binary, labels binary, vectors binary")


def _of(packed, number: int, part: pa.Table) -> pa.RecordBatch:
    width = int(part["width"][0].as_py())
    return packed(
        number, width, part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part, "v", width)
    )


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each anchor with any vector between ``low`` and ``high``."""
    a, low, high = (x.astype(np.float64) for x in (anchors, low, high))
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    rounding = 1e-12 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - rounding, up @ high.T + down @ low.T + rounding


def _cells(anchors: DataFrame, zones: DataFrame, n_anchors: int, n_zones: int) -> tuple[DataFrame, DataFrame]:
    """Anchors and zone maps, dealt to cells so that each of both meet in one cell."""
    rows, columns = max(1, math.ceil(n_anchors / ANCHORS)), max(1, math.ceil(n_zones / ZONES))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("r", F.pmod(F.xxhash64("group"), F.lit(rows)).cast("int")).withColumn("c", every(columns))
    right = zones.withColumn("c", F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int")).withColumn("r", every(rows))
    return left.groupBy("r", "c"), right.groupBy("r", "c")


def to_read(anchors: DataFrame, zones: DataFrame, sizes: tuple[int, int], rule: str) -> DataFrame:
    """``group``, ``block`` and ``readers``, the ids of the group's anchors that must read the block.

    ``rule`` is "look" (for each anchor the block of its label with the highest bound),
    "positives" (``floor`` must be reached) or "negatives" (one of ``windows`` must be met).
    """

    def work(own: pa.Table, other: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for width in np.intersect1d(own["width"].to_numpy(), other["width"].to_numpy()).tolist():
            mine = own.filter(pa.array(own["width"].to_numpy() == width))
            maps = other.filter(pa.array(other["width"].to_numpy() == width))
            low, high = score_bounds(
                matrix(mine, "v", width), matrix(maps, "low", width), matrix(maps, "high", width)
            )
            label = mine["label"].to_numpy()[:, None]
            first, last = maps["label_low"].to_numpy()[None, :], maps["label_high"].to_numpy()[None, :]
            has = (first <= label) & (label <= last)
            if rule == "look":
                need = np.zeros(has.shape, bool)
                need[np.arange(len(has)), np.where(has, high, -np.inf).argmax(axis=1)] = True
                need &= has
            elif rule == "positives":
                need = has & (high >= mine["floor"].fill_null(-np.inf).to_numpy()[:, None])
            else:
                need = np.zeros(has.shape, bool)
                windows = mine["windows"].to_pylist()
                for i in range(max(map(len, windows), default=0)):
                    top = np.array([float(w[i]) if i < len(w) else np.nan for w in windows])[:, None]
                    need |= (low <= top) & (high >= top * (SHARE / 100) - 1e-9 * np.abs(top))
                need &= (first != label) | (last != label)
            at, zone = np.nonzero(need)
            found.append(
                (mine["group"].to_numpy()[at], maps["block"].to_numpy()[zone], mine["vec_id"].to_numpy()[at])
            )
        group, block, reader = (
            np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(3)
        )
        order = np.lexsort((reader, block, group))
        group, block, reader = group[order], block[order], reader[order]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        offsets = pa.array(np.append(first, len(order)).astype(np.int32))
        return pa.table(
            {
                "group": group[first],
                "block": block[first],
                "readers": pa.ListArray.from_arrays(offsets, pa.array(reader, pa.int64())),
            }
        )

    left, right = _cells(anchors, zones, *sizes)
    return left.cogroup(right).applyInArrow(work, "group bigint, block bigint, readers array<bigint>")


def read(anchors: DataFrame, packed: DataFrame, wanted: DataFrame, k: int, negatives: bool) -> DataFrame:
    """Of each block that is read, the best ``k`` rows for each anchor (and window).

    ``anchor_id``, ``top`` (the window's upper end; null for positives), ``vec_id``, ``score``.
    """
    names = ["anchor_id", "top", "vec_id", "score"]

    def work(own: pa.Table, other: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
        if own.num_rows and other.num_rows:
            width = other["width"][0].as_py()
            ids, labels, v = (
                np.frombuffer(other[c][0].as_py(), np.int64) for c in ("ids", "labels", "vectors")
            )
            scores = products(matrix(own, "v", width), v.reshape(-1, width))
            same = own["label"].to_numpy()[:, None] == labels[None, :]
            tops = own["windows"].to_pylist() if negatives else [[0]] * own.num_rows
            for i, anchor in enumerate(own["vec_id"].to_numpy()):
                row = scores[i]
                for top in tops[i]:
                    if negatives:
                        good = ~same[i] & (row <= top) & (row >= top - (100 - SHARE) * top // 100)
                    else:
                        good = same[i] & (ids != anchor)
                    at = np.flatnonzero(good)
                    if len(at) > k:
                        at = at[row[at] >= np.partition(row[at], -k)[-k]]
                    at = at[np.lexsort((ids[at], -row[at]))][:k]
                    fixed = np.tile([anchor, top], (len(at), 1))
                    out.append(np.column_stack([fixed, ids[at], row[at]]))
        rows = np.concatenate(out)
        return pa.table({n: rows[:, j] for j, n in enumerate(names)})

    readers = wanted.select(F.col("block").alias("of_block"), F.explode("readers").alias("vec_id"))
    left = readers.join(anchors, "vec_id").groupBy(F.col("group").alias("of_group"), "of_block")
    right = wanted.select("group", "block").join(
        packed.select("block", "width", "ids", "labels", "vectors"), "block"
    )
    return left.cogroup(right.groupBy("group", "block")).applyInArrow(
        work, ", ".join(f"{n} bigint" for n in names)
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each anchor and window, with their ``rank``; merged in two steps."""
    order = [F.desc("score"), F.asc("vec_id")]
    in_slice = Window.partitionBy("anchor_id", "top", "slice").orderBy(*order)
    in_all = Window.partitionBy("anchor_id", "top").orderBy(*order)
    return (
        found.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(SLICES)))
        .withColumn("in_slice", F.row_number().over(in_slice))
        .where(F.col("in_slice") <= k)
        .withColumn("rank", F.row_number().over(in_all))
        .where(F.col("rank") <= k)
        .drop("slice", "in_slice")
    )


def mine(rows: DataFrame, is_anchor: Column, k: int = K) -> DataFrame:
    """The best ``k`` hard negatives for each of an anchor's best ``k`` positives.

    ``rows`` holds ``vec_id``, ``label`` and ``v``, see ``candidates``. ``anchor_id``, ``positive_id``,
    ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.
    """
    placed = cut(on_curve(cut(rows, "rows")), "placed")
    packed = cut(blocks(placed.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)), "blocks")
    zones = packed.select(*[c.strip().split(" ")[0] for c in ZONE.split(",")])
    anchors = cut(
        placed.where(is_anchor)
        .repartitionByRange(*ORDER)
        .sortWithinPartitions(*ORDER)
        .withColumn("group", F.shiftright(F.monotonically_increasing_id(), GROUP_BITS))
        .drop("place"),
        "anchors",
    )
    sizes = anchors.count(), zones.count()

    looked = read(anchors, packed, cut(to_read(anchors, zones, sizes, "look"), "look"), k, False)
    floors = (
        _best(looked, k)
        .where(F.col("rank") == k)
        .select(F.col("anchor_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    )
    with_floor = cut(anchors.join(floors, "vec_id", "left"), "floors")
    wanted = cut(to_read(with_floor, zones, sizes, "positives"), "positives-to-read")
    positives = cut(
        _best(read(anchors, packed, wanted, k, False), k).select(
            "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )

    windows = (
        positives.where("positive_score >= 0")
        .groupBy(F.col("anchor_id").alias("vec_id"))
        .agg(F.collect_set("positive_score").alias("windows"))  # k at most
    )
    with_windows = cut(anchors.join(windows, "vec_id"), "windows")
    wanted = cut(to_read(with_windows, zones, sizes, "negatives"), "negatives-to-read")
    negatives = _best(read(with_windows, packed, wanted, k, True), k)
    return positives.join(
        negatives.select(
            "anchor_id",
            F.col("top").alias("positive_score"),
            F.col("vec_id").alias("negative_id"),
            F.col("score").alias("negative_score"),
            F.col("rank").cast("int").alias("rank"),
        ),
        ["anchor_id", "positive_score"],
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH finite AS (
  SELECT vec_id, label, embedding,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS f
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(f, lambda x: TRY_CAST(x AS BIGINT)) AS v
  FROM finite WHERE list_sum(list_transform(f, lambda x: x * x)) < 9.0e18
),
v AS (
  SELECT vec_id, label, v FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v, label) AS copy FROM whole
  ) WHERE copy = 1
),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = d.label AS same, d.vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v d ON a.vec_id <> d.vec_id AND len(a.v) = len(d.v)
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
    FROM s WHERE same
  ) WHERE place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
) WHERE rank <= 5
"""
