"""Words of texts as 64-bit hashes, and numpy helpers on them.

All operators that compare texts word by word share these functions. They run inside
tasks on a block of texts at a time; nothing here keeps state that grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Odd 64-bit multipliers of public integer mixers.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: The inverse of MULTIPLIER modulo 2**64.
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes of text that are worked on at once; a longer text makes a block of its own.
BLOCK_BYTES = 500_000

# The white space between words, as code points.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Well distributed 64-bit values, one for each of ``x``."""
    x = x + np.uint64(seed * int(MULTIPLIER) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool, punctuation: bool) -> np.ndarray:
    """What each byte adds to the hash of a word; 0 for bytes that do not count."""
    values = np.arange(1, 257, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    ascii_bytes = np.arange(128)
    alnum = [chr(i).isalnum() for i in ascii_bytes]
    if not punctuation:
        values[ascii_bytes[~np.array(alnum)]] = 0
    values[[32, *range(9, 14)]] = 0
    return values


#: Words in lower case; punctuation around them does not count.
PLAIN = _byte_values(lower=True, punctuation=False)
#: Words with A-Z in lower case, else as they are.
LOWERED = _byte_values(lower=True, punctuation=True)
#: Words as they are.
EXACT = _byte_values(lower=False, punctuation=True)

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


class _Powers:
    """Powers of the multiplier and of its inverse, as many as were needed so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.full(n, m) for m in (MULTIPLIER, INVERSE))
            for powers in (cls.up, cls.down):
                powers[0] = 1
                np.cumprod(powers, out=powers)
        return cls.up, cls.down


@dataclass
class Tokens:
    """The words of some texts in a row; places are bytes from the start of the text.

    ``hashes`` is 0 for a word of nothing but bytes that do not count.
    """

    hashes: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    prefixes: list[np.ndarray]

    @property
    def owner(self) -> np.ndarray:
        """Which text a word is of."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def words_only(self) -> Tokens:
        """Without the words whose hash is 0."""
        good = self.hashes != 0
        counts = np.bincount(self.owner[good], minlength=len(self.counts))
        return Tokens(
            self.hashes[good],
            counts,
            self.starts[good],
            self.ends[good],
            [p[good] for p in self.prefixes],
        )


def tokens(
    batch: list[bytes | None], values: np.ndarray = PLAIN, prefixes: tuple[int, ...] = ()
) -> Tokens:
    """Words of texts, split at ASCII white space, and their 64-bit hashes.

    A word's hash is a polynomial in its bytes, taken for all words at once from
    differences of prefix sums. ``prefixes`` asks for hashes of so many first bytes as
    well (0 where the word is not longer).
    """
    lengths = np.array([len(t or b"") for t in batch], np.int64)
    joined = np.frombuffer(b" ".join([*(t or b"" for t in batch), b""]), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    up, down = _Powers.to(len(joined) + 1)
    worth = values[joined]
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(worth * up[: len(joined)], out=sums[1:])
    inside = ~_BLANK[joined]
    edge = np.flatnonzero(np.diff(inside, prepend=False))  # texts end in a blank
    starts, ends = edge[0::2], edge[1::2]
    first = starts
    if not worth[starts].all():
        counted = np.append(np.flatnonzero(worth), len(joined))
        first = np.minimum(counted[np.searchsorted(counted, starts)], ends)

    def hashed(until: np.ndarray) -> np.ndarray:
        return mixed((sums[until] - sums[first]) * down[first])

    some = first < ends
    hashes = np.where(some, hashed(ends) | np.uint64(1), np.uint64(0))
    begins = [
        np.where(first + n < ends, hashed(np.minimum(first + n, ends)) | np.uint64(1), np.uint64(0))
        for n in prefixes
    ]
    owner = np.searchsorted(bounds, starts, "right") - 1
    counts = np.bincount(owner, minlength=len(batch)).astype(np.int64)
    return Tokens(hashes, counts, starts - bounds[owner], ends - bounds[owner], begins)


def blocks(batch: list[bytes | None], most: int = BLOCK_BYTES) -> Iterator[slice]:
    """Slices of a batch that hold about ``most`` bytes each."""
    start, size = 0, 0
    for i, text in enumerate(batch):
        size += len(text or b"") + 1
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(batch):
        yield slice(start, len(batch))


def grouped_runs(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside each text, and how many each text has.

    A text of 1 to ``k - 1`` words has one run of them all.
    """
    short = (counts > 0) & (counts < k)
    if short.any():
        offsets = np.cumsum(counts) - counts
        pads = np.where(short, k - counts, 0)
        at = np.repeat((offsets + counts), pads)
        hashes = np.insert(hashes, at, np.uint64(0x5EED))
        counts = counts + pads
    out = runs(hashes, k)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)[: len(out)]
    inside = np.arange(len(out)) + k <= ends[owner]
    return out[inside], np.maximum(counts - k + 1, 0)


def runs(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` values, by position of its first."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * MULTIPLIER + values[j : j + n]
    return mixed(total)


def long_runs(values: np.ndarray, k: int) -> np.ndarray:
    """As ``runs``, in time that does not depend on ``k``: differences of prefix sums."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _Powers.to(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[k:] - sums[:n]) * down[:n])


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every window of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A text column as bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def flat_lists(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from the lengths of its lists and all values in a row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def narrowed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only an id and a text, under the names that the operators work with."""
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")
    )


def fold(key: Column, folds: int = 5) -> Column:
    """Fold of a row: crc32 of its key as text, modulo ``folds``; null keys have none."""
    return F.crc32(key.cast("string").cast("binary")) % folds
