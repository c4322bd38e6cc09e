"""Quality classifier by positive-unlabelled learning.

Known are some texts that are good for certain; all others are web text, good or bad. With the share
``prior`` of good texts among all, the risk of calling a bad text good can be had without
any bad label: it is the risk over all texts minus ``prior`` times that over the good ones. The
minimised risk is ``prior * E_good[l(g)] + max(0, E_all[l(-g)] - prior * E_good[l(-g)])`` with the
logistic loss l and margin g. The second term can only fall below 0 by overfitting; where it does,
the step goes back up that term instead (the non-negative estimator).

The prior is estimated first. A model fitted on half of the good texts, with ``FIRST_PRIOR``, orders
all others; for any cut, the share of all these texts above it is at least their prior times the share of
the other half of the good texts. The prior is the lowest such quotient, each raised by
``ERRORS`` standard errors, among cuts that leave at least ``LEAST_ABOVE`` of the good texts.

A text is described by shares and sizes (capitals, marks, distinct words, repeated word
pairs, line breaks and so on, see ``SIGNALS``). Each is cut at fixed edges and every bin has its own
weight, the sum of the steps up to it; the ridge is on the steps, so bins with few texts follow
their neighbours. Descriptions take one byte for each signal; they are computed once for each text and
written. All texts and all good labels take part in every step: a step is one pass over the
descriptions that adds up gradients inside tasks, and only the sums (one row for each bin) reach the
driver. Steps are scaled by the fixed matrix that bounds the curvature from above, and accelerated.
What rows contribute is rounded to whole numbers before it is added up, so the model depends on
neither partitions nor cores.

Defined cases: null and empty texts are described alike and get a score; rows without an id are
unlabelled; a label counts as good if all label rows of that id say 1; repeated rows count
as often as they come; with no good text, or no text, at all every score is the prior, 0.5. Very long
texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.words import EXACT, MULTIPLIER, blocks, column, mixed, narrowed, texts, tokens
from kindred.session import cut

#: Bytes of text worked on at once.
AT_ONCE = 500_000
#: Steps of one fit, and the ridge on the weights' steps, divided by the number of good texts.
STEPS, RIDGE = 30, 1.0
FIRST_PRIOR, ERRORS = 0.5, 2.0
#: Cuts that the prior is estimated from leave this share of the good texts above them.
LEAST_ABOVE = 0.3
#: Margins are counted in so many bins between -MARGIN and MARGIN.
MARGIN, MARGIN_BINS = 20.0, 400
#: Contributions are rounded to this fraction.
UNIT = 1.0 / (1 << 20)
#: From this score on a text is taken for good.
GOOD = 0.7

#: Edges of shares, of mean word lengths in bytes, and of numbers of words.
SHARE = (0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9, 0.98)
LENGTH = (2, 3, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 9, 11, 15, 25)
WORDS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192)
BINS = len(SHARE) + 1

#: What a text is described by, and where it is cut.
SIGNALS = {
    "capitals": SHARE,  # of ASCII letters
    "marks": SHARE,  # ASCII marks, of all bytes but blanks
    "digits": SHARE,
    "beyond_ascii": SHARE,
    "mark_runs": SHARE,  # marks that follow the same mark, of all bytes but blanks
    "word_length": LENGTH,
    "words": WORDS,
    "distinct": SHARE,  # distinct words of all words
    "top_word": SHARE,  # the commonest word's share
    "same_again": SHARE,  # words equal to the one before
    "old_pairs": SHARE,  # word pairs that came before in the text
    "ends_in_mark": SHARE,  # of words
    "only_marks": SHARE,  # words without a letter
    "begins_capital": SHARE,
    "short": SHARE,  # words of up to three bytes
    "breaks": SHARE,  # line breaks, of words
}
SIZE = 1 + len(SIGNALS) * BINS

_UPPER, _LOWER, _DIGIT, _MARK, _HIGH, _BREAK = range(6)


def _classes() -> np.ndarray:
    table = np.full(256, -1, np.int8)
    for i in range(33, 127):
        c = chr(i)
        table[i] = (
            _UPPER if c.isupper() else _LOWER if c.islower() else _DIGIT if c.isdigit() else _MARK
        )
    table[128:] = _HIGH
    table[10] = _BREAK
    return table


CLASS = _classes()


def _repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each text has, and how often its commonest comes."""
    keys = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (mixed(hashes) >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    whose = (keys[first] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, whose, np.diff(np.append(first, len(keys))))
    return np.bincount(whose, minlength=n), top


def describe(batch: list[bytes | None]) -> np.ndarray:
    """The signals of texts, a row for each."""
    n = len(batch)
    found = tokens(batch, EXACT)
    joined = np.frombuffer(b" ".join([*(t or b"" for t in batch), b""]), np.uint8)
    sizes = np.array([len(t or b"") for t in batch], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    kind = CLASS[joined]

    def of_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    upper, lower, digit, mark, high, line = (of_text(kind == c) for c in range(6))
    runs = np.zeros(len(joined), bool)
    runs[1:] = (joined[1:] == joined[:-1]) & (kind[1:] == _MARK)
    owner = found.owner
    begin, end = found.starts + bounds[owner], found.ends + bounds[owner]
    letters = np.concatenate([[0], np.cumsum((kind == _UPPER) | (kind == _LOWER) | (kind == _HIGH))])
    same = owner[1:] == owner[:-1]

    def of_words(flags: np.ndarray, whose: np.ndarray = owner) -> np.ndarray:
        return np.bincount(whose[flags], minlength=n)

    distinct, top = _repeats(owner, found.hashes, n)
    pairs = (found.hashes[:-1] * MULTIPLIER + found.hashes[1:])[same]
    new_pairs, _ = _repeats(owner[:-1][same], pairs, n)
    n_pairs = np.maximum(found.counts - 1, 0)
    words, filled = np.maximum(found.counts, 1), np.maximum(upper + lower + digit + mark + high, 1)
    values = {
        "capitals": upper / np.maximum(upper + lower, 1),
        "marks": mark / filled,
        "digits": digit / filled,
        "beyond_ascii": high / filled,
        "mark_runs": of_text(runs) / filled,
        "word_length": (upper + lower + digit + mark + high) / words,
        "words": found.counts,
        "distinct": distinct / words,
        "top_word": top / words,
        "same_again": of_words(same & (found.hashes[1:] == found.hashes[:-1]), owner[1:]) / words,
        "old_pairs": (n_pairs - new_pairs) / np.maximum(n_pairs, 1),
        "ends_in_mark": of_words(kind[end - 1] == _MARK) / words,
        "only_marks": of_words(letters[end] == letters[begin]) / words,
        "begins_capital": of_words(kind[begin] == _UPPER) / words,
        "short": of_words(end - begin <= 3) / words,
        "breaks": line / words,
    }
    return np.column_stack([values[name] for name in SIGNALS]).astype(np.float64)


def binned(signals: np.ndarray) -> np.ndarray:
    """The bin of each signal."""
    found = [np.searchsorted(edges, x, "right") for edges, x in zip(SIGNALS.values(), signals.T)]
    return np.column_stack(found).astype(np.uint8)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``bins`` (a byte for each signal) of every row."""
    width = len(SIGNALS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = texts(batch)
            rows = [binned(describe(own[part])) for part in blocks(own, AT_ONCE)]
            flat = np.concatenate([np.zeros((0, width), np.uint8), *rows]).tobytes()
            bins = [flat[i : i + width] for i in range(0, len(flat), width)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(bins, pa.binary())], ["doc_id", "bins"]
            )

    return narrowed(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, bins binary")


@dataclass(frozen=True)
class Model:
    """A weight for each bin of each signal behind an intercept, and the estimated prior."""

    prior: float = 0.5
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SIZE))


def _places(batch: pa.RecordBatch) -> np.ndarray:
    """Which weights each row has, the intercept apart."""
    rows = b"".join(column(batch, "bins").to_pylist())
    bins = np.frombuffer(rows, np.uint8).reshape(-1, len(SIGNALS))
    return bins.astype(np.int64) + 1 + BINS * np.arange(len(SIGNALS))


def _margins(places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[0] + weights[places].sum(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _sums(rows: DataFrame, weights: np.ndarray, good: Column) -> np.ndarray:
    """Sums over all rows that a step needs; 3 x (SIZE + 1), the last column holds the losses.

    Of each bin: the gradient of l(-g) over all texts, of l(-g) over good ones, of l(g) over good ones.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, SIZE + 1))  # whole numbers, exact
        for batch in batches:
            if not batch.num_rows:
                continue
            places = _places(batch)
            good = column(batch, "good").to_numpy(zero_copy_only=False)
            g = _margins(places, weights)
            up, loss = _sigmoid(g), np.logaddexp(0, g)
            for row, (share, lost) in enumerate(
                ((up, loss), (up * good, loss * good), ((up - 1) * good, (loss - g) * good))
            ):
                share = np.rint(share / UNIT)
                total[row, 0] += share.sum()
                total[row, 1:SIZE] += np.bincount(
                    places.ravel(), np.repeat(share, places.shape[1]), minlength=SIZE
                )[1:]
                total[row, SIZE] += np.rint(lost / UNIT).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(SIZE + 1)), *(pa.array(t.astype(np.int64)) for t in total)],
            ["place", "every", "down", "up"],
        )

    found = (
        rows.select("bins", good.alias("good"))
        .mapInArrow(work, "place bigint, every bigint, down bigint, up bigint")
        .groupBy("place")
        .agg(*(F.sum(c).alias(c) for c in ("every", "down", "up")))
        .toArrow()  # SIZE + 1 rows
        .sort_by("place")
    )
    return np.stack([found[c].to_numpy() for c in ("every", "down", "up")]) * UNIT


def _together(rows: DataFrame) -> np.ndarray:
    """How many rows have both of two bins; SIZE x SIZE, the intercept counts as a bin of all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SIZE, SIZE))
        for batch in batches:
            if batch.num_rows:
                has = np.zeros((batch.num_rows, SIZE))
                has[:, 0] = 1
                np.put_along_axis(has, _places(batch), 1, axis=1)
                total += has.T @ has
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(SIZE)), pa.array(total.astype(np.int64).tolist(), pa.list_(pa.int64()))],
            ["place", "counts"],
        )

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = table["counts"].combine_chunks().flatten().to_numpy().reshape(-1, SIZE).sum(axis=0)
        return pa.table(
            {
                "place": pa.array([key[0].as_py()], pa.int64()),
                "counts": pa.array([total], pa.list_(pa.int64())),
            }
        )

    schema = "place bigint, counts array<bigint>"
    # a row of each task for each bin; SIZE rows are collected
    found = rows.select("bins").mapInArrow(work, schema).groupBy("place").applyInArrow(add, schema)
    table = found.toArrow().sort_by("place")
    return np.array(table["counts"].to_pylist(), float)


def _steps_to_bins() -> np.ndarray:
    """The matrix that sums up each signal's steps to its bins' weights."""
    matrix = np.eye(SIZE)
    for first in range(1, SIZE, BINS):
        matrix[first : first + BINS, first : first + BINS] = np.tril(np.ones((BINS, BINS)))
    return matrix


def minimise(
    sums: Callable[[np.ndarray], np.ndarray],
    curvature: np.ndarray,
    n_all: int,
    n_good: int,
    prior: float,
    steps: int = STEPS,
) -> np.ndarray:
    """Bin weights of the lowest non-negative risk that is reached.

    ``sums(weights)`` gives what ``_sums`` does, ``curvature`` the mean of ``_together``.
    """
    summed = _steps_to_bins()
    ridge = np.full(SIZE, RIDGE / n_good)
    ridge[0] = 1e-6
    scale = np.array([1.0 / n_all, -prior / n_good, prior / n_good])[:, None]
    # the logistic loss curves by a quarter at most
    inverse = np.linalg.inv(summed.T @ curvature @ summed / 4 + np.diag(ridge))
    at = before = best = np.zeros(SIZE)
    lowest, speed = np.inf, 0
    for _ in range(steps):
        every, down, up = sums(summed @ at) * scale
        bad = every[SIZE] + down[SIZE]
        risk = up[SIZE] + max(0.0, bad) + 0.5 * (ridge * at**2).sum()
        slower = risk > lowest * 1.0001
        if risk < lowest:
            lowest, best = risk, at
        if bad < 0:
            # the risk of bad texts is overfitted: back up that term
            at = before = at + inverse @ (summed.T @ (every + down)[:SIZE])
            speed = 0
            continue
        step = at - inverse @ (summed.T @ (every + down + up)[:SIZE] + ridge * at)
        speed = 0 if slower and speed > 2 else speed + 1
        at, before = step + max(0, speed - 1) / (speed + 2) * (step - before), step
    return summed @ best


def estimate_prior(
    above_all: np.ndarray, above_good: np.ndarray, errors: float = ERRORS
) -> float:
    """The lowest quotient of what is above a cut, among cuts with enough good texts above.

    Both count the texts at or above falling cuts; the last cut is below all.
    """
    n_good = above_good.max(initial=0)
    if not n_good:
        return 0.5
    enough = above_good >= LEAST_ABOVE * n_good
    share = above_good[enough] / n_good
    quotient = above_all[enough] / above_all.max() / share
    return float((quotient * (1 + errors * np.sqrt((1 - share) / (share * n_good)))).min())


def _prior(rows: DataFrame, weights: np.ndarray) -> float:
    """Prior of all rows, by the order of those that the weights were not fitted on as good."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, MARGIN_BINS), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            g = _margins(_places(batch), weights)
            at = np.clip((g + MARGIN) / (2 * MARGIN) * MARGIN_BINS, 0, MARGIN_BINS - 1).astype(np.int64)
            half = column(batch, "half").to_numpy()
            counts[0] += np.bincount(at[half != 1], minlength=MARGIN_BINS)
            counts[1] += np.bincount(at[half == 2], minlength=MARGIN_BINS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(MARGIN_BINS)), pa.array(counts[0]), pa.array(counts[1])],
            ["place", "every", "good"],
        )

    found = (
        rows.select("bins", "half")
        .mapInArrow(work, "place bigint, every bigint, good bigint")
        .groupBy("place")
        .agg(F.sum("every").alias("every"), F.sum("good").alias("good"))
        .toArrow()  # MARGIN_BINS rows
        .sort_by("place")
    )
    every, good = (np.cumsum(found[c].to_numpy()[::-1]) for c in ("every", "good"))
    return estimate_prior(every, good)


def marked_good(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``half``: 1 or 2 for good texts, by a hash of their ids, and 0 for all others.

    ``labels`` holds ``doc_id`` and ``label``, of which 1 is trusted.
    """
    trusted = (
        labels.where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("label").alias("label"))
        .where("label = 1")
        .select("doc_id", (1 + F.pmod(F.xxhash64("doc_id"), F.lit(2))).cast("int").alias("half"))
    )
    return rows.join(trusted, "doc_id", "left").select(
        "doc_id", "bins", F.coalesce("half", F.lit(0)).alias("half")
    )


def fit(rows: DataFrame, steps: int = STEPS) -> Model:
    """A model from ``bins`` and ``half`` of all texts; ``rows`` is read often and should be ``cut``."""
    n_all, first, second = rows.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("half") == 1, 1)), F.count(F.when(F.col("half") == 2, 1))
    ).first()
    if not first + second:
        return Model()
    curvature = _together(rows) / n_all
    prior = 0.5
    if first and second:
        half = F.col("half") == 1
        order = minimise(lambda w: _sums(rows, w, half), curvature, n_all, first, FIRST_PRIOR, steps // 2)
        # of those that are not in the first half; all in it are good
        prior = (_prior(rows, order) * (n_all - first) + first) / n_all
    prior = float(np.clip(prior, 0.01, 0.99))
    good = F.col("half") > 0
    return Model(
        prior,
        minimise(lambda w: _sums(rows, w, good), curvature, n_all, first + second, prior, steps),
    )


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` of described rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _sigmoid(_margins(_places(batch), model.weights))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(found), pa.array((found >= GOOD).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return rows.mapInArrow(work, "doc_id bigint, score double, predicted int")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    steps: int = STEPS,
) -> DataFrame:
    """Fit on all of ``docs`` and the good ones among ``labels``, and score every row."""
    rows = cut(marked_good(described(docs, id_col, text_col), labels), "described")
    return score(rows, fit(rows, steps))
