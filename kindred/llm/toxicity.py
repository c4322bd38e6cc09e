"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the set of its words, their first four and five letters, its
pairs of neighbouring words and its pairs of words with one word between, each hashed
into ``2**BITS`` slots. FTRL-proximal keeps a learning rate for every slot and sets all
slots to zero whose evidence stays below the L1 penalty, so the fitted model is a short
list of slots and weights, small enough to be sent to every task.

The model is fitted on at most ``max_rows`` labelled rows, picked by a hash of their
ids. They are dealt to a fixed number of shards (one, by default: the learner is a
sequential one, and its sample is bounded), each shard is read in a fixed order, and the
shards' weights are averaged. The result depends on neither partitions nor cores. All texts are scored whole, without any shuffle.

Defined cases: a null or empty text has no features and scores by the intercept alone;
a null label or id is not learned from; repeated rows are learned from once each and
scored alike; with no labelled rows at all every score is exactly 0.5. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.words import (
    MULTIPLIER,
    PLAIN,
    blocks,
    column,
    flat_lists,
    mixed,
    narrowed,
    texts,
    tokens,
)

#: Slots of the feature hash, as a power of two.
BITS = 20
#: Labelled rows that a model is fitted on, at most.
MAX_ROWS = 20_000
SHARDS = 1
EPOCHS = 3

STEMS = (4, 5)


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties of the learner."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.1


@dataclass(frozen=True)
class Model:
    """An intercept, and the slots whose weight is not zero."""

    intercept: float = 0.0
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.slots] = self.weights
        return table


def features(batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the texts' features, and which text each is of; some come repeatedly."""
    words = tokens(batch, PLAIN, STEMS).words_only()
    owner = words.owner
    found = [(words.hashes, owner)]
    for stem in words.prefixes:
        found.append((stem[stem != 0] ^ np.uint64(1), owner[stem != 0]))
    for gap in (1, 2):
        pair = words.hashes[:-gap] * MULTIPLIER + words.hashes[gap:] * np.uint64(2 * gap + 1)
        inside = owner[:-gap] == owner[gap:]
        found.append((pair[inside], owner[:-gap][inside]))
    slots = mixed(np.concatenate([s for s, _ in found])) >> np.uint64(64 - BITS)
    return slots.astype(np.int64), np.concatenate([o for _, o in found])


def distinct_features(batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each text, in order of the texts, and how many each has."""
    slots, owner = features(batch)
    both = np.sort((owner << BITS) | slots)
    both = both[np.diff(both, prepend=-1) != 0]
    return both & ((1 << BITS) - 1), np.bincount(both >> BITS, minlength=len(batch))


def train_one(
    rows: Sequence[tuple[np.ndarray, int]], rule: Ftrl, epochs: int
) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal over ``rows`` of (distinct slots, label), in their order.

    A row's slots are widened only while it is learned from, so ``rows`` may be views.
    """
    size = (1 << BITS) + 1  # the last is the intercept
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        free = np.where(at == size - 1, 0.0, rule.l1)
        away = np.abs(z[at]) - free
        rate = (rule.beta + np.sqrt(n[at])) / rule.alpha + rule.l2
        return np.where(away > 0, -np.sign(z[at]) * away / rate, 0.0)

    for _ in range(epochs):
        for slots, label in rows:
            at = np.append(slots, size - 1)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rule.alpha * w
            n[at] += g * g
    found = np.flatnonzero(np.abs(z[:-1]) > rule.l1)
    return float(weights(np.array([size - 1]))[0]), found, weights(found)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS
) -> DataFrame:
    """At most ``max_rows`` labelled texts: ``doc_id``, ``text``, ``label``.

    ``labels`` holds ``doc_id`` and ``label`` (0 or 1). The rows are those with the
    lowest hashes of their ids. Their number is bounded, so they are broadcast.
    """
    picked = (
        labels.select(F.col("doc_id").cast("bigint"), F.col("label").cast("int"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    return narrowed(docs).join(F.broadcast(picked), "doc_id")


def fit(
    sample: DataFrame,
    rule: Ftrl = Ftrl(),
    shards: int = SHARDS,
    epochs: int = EPOCHS,
) -> Model:
    """A model from ``doc_id``, ``text`` and ``label``; see ``labelled_sample``."""
    schema = "shard int, doc_id bigint, label int, slots array<int>"

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = texts(batch)
            for part in blocks(own):
                slots, counts = distinct_features(own[part])
                ids = batch.slice(part.start, part.stop - part.start).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays(
                    [*ids.columns, flat_lists(counts, slots, pa.int32())],
                    [*ids.schema.names, "slots"],
                )

    def learn(table: pa.Table) -> pa.Table:
        # views of the lists where they arrived: nothing that is large is copied
        lists, labels = [], []
        for batch in table.to_batches():
            slots = column(batch, "slots")
            flat, offsets = slots.values.to_numpy(), slots.offsets.to_numpy()
            lists += [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            labels += column(batch, "label").to_pylist()
        ids = table["doc_id"].to_numpy()
        order = np.lexsort((ids, mixed(ids.astype(np.uint64))))
        rows = [(lists[i], labels[i]) for i in order]
        intercept, at, weights = train_one(rows, rule, epochs)
        del table, lists, rows
        pa.default_memory_pool().release_unused()  # the worker goes on with other tasks
        return pa.table(
            {
                "slot": pa.array(np.append(at, -1), pa.int64()),
                "weight": pa.array(np.append(weights, intercept), pa.float64()),
            }
        )

    rows = (
        sample.select(
            F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int").alias("shard"),
            "doc_id",
            "label",
            "text",
        )
        .mapInArrow(featurize, schema)
        .groupBy("shard")
        .applyInArrow(learn, "slot bigint, weight double")
    )
    # at most shards * 2**BITS rows; after the L1 penalty some hundreds
    total = rows.groupBy("slot").agg(
        F.sort_array(F.collect_list("weight")).alias("weights")  # at most one of each shard
    )
    found = {r["slot"]: sum(r["weights"]) / shards for r in total.collect()}
    intercept = found.pop(-1, 0.0)
    slots = np.array(sorted(found), np.int64)
    return Model(intercept, slots, np.array([found[s] for s in slots.tolist()]))


def scores(batch: list[bytes | None], model: Model, table: np.ndarray) -> np.ndarray:
    """Scores of texts inside a task; ``table`` is ``model.dense()``."""
    margins = []
    for part in blocks(batch):
        slots, owner = features(batch[part])
        known = table[slots] != 0
        both = np.unique((owner[known] << BITS) | slots[known])
        margins.append(
            np.bincount(
                both >> BITS,
                table[both & ((1 << BITS) - 1)].astype(np.float64),
                minlength=part.stop - part.start,
            )
        )
    total = np.concatenate([np.zeros(0), *margins]) + model.intercept
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` of every row of ``docs``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        for batch in batches:
            found = scores(texts(batch), model, table)
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array(found),
                    pa.array((found >= 0.5).astype(np.int32)),
                ],
                ["doc_id", "score", "predicted"],
            )

    return narrowed(docs, id_col, text_col).mapInArrow(
        scored, "doc_id bigint, score double, predicted int"
    )


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, that are not predicted to be toxic.

    Null texts and texts without any feature (empty ones, marks only) say nothing and stay, whatever the
    intercept is. Rows are judged one by one where they are read; nothing is shuffled or joined.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        # the score of a text without features; others of just this score know no feature
        silent = scores([b""], model, table)[0]
        for batch in batches:
            found = scores(texts(batch, text_col), model, table)
            yield batch.filter(pa.array((found < 0.5) | (found == silent)))

    return docs.mapInArrow(kept, docs.schema)
