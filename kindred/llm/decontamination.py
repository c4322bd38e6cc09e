"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed pattern over neighbouring words: the words under a 1 are hashed, the
words under a 0 are ignored, so a substituted word spoils only the hits that look at it.
All benchmark positions are hashed under all masks. Texts are hashed the same way where
they are read; a bitmap of fixed size over the benchmark's hashes keeps away nearly
all positions that cannot hit. What is left is joined with the benchmark by hash, and
around every hit the texts are laid side by side: an overlap is a stretch of
``min_words`` words (of the whole item where it is shorter) around a hit in which at
least ``min_share`` of the words are equal, place by place.

The bitmap has 2**BITMAP_BITS bits whatever the benchmark's size; a large benchmark fills
it and makes it less useful, never wrong. Nothing else is sent to all tasks.

Items of ten words or more share five masks, chosen so that wherever the allowed substitutions fall in
a stretch of 10 to 13 words, one mask looks at none of them. Shorter items have masks of their own length,
each of which ignores two neighbouring words; the texts are hashed for those lengths that the benchmark has.

Defined cases: null and empty texts hold nothing and hit nothing; a benchmark item with
fewer than ``LEAST_WORDS`` words is not searched for, since so few words stand in many texts by chance; rows without an id are not
searched (and kept by ``remove``); repeated rows are reported once; an empty table
on either side gives no overlaps. Words are compared in lower case without the
punctuation around them. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.words import (
    MULTIPLIER,
    blocks,
    column,
    mixed,
    narrowed,
    texts,
    tokens,
)
from kindred.session import cut

# Masks of weight 6.
MASKS = ("1101111", "11110011", "1100010111", "1110001011", "10111101")
#: Words of the shortest items that are searched for, and of the shortest that ``MASKS`` are for.
LEAST_WORDS, LONG_WORDS = 5, 10
MIN_WORDS = 13
MIN_SHARE = 0.8
BITMAP_BITS = 24
#: Bits that one row of the collected bitmap has.
PAGE_BITS = 18


def masks_for(words: int) -> tuple[str, ...]:
    """The masks that an item of so many words is searched for by."""
    if words >= LONG_WORDS:
        return MASKS
    if words < LEAST_WORDS:
        return ()
    return tuple(
        "1" * at + "0" * min(2, words - at) + "1" * max(0, words - at - 2) for at in range(0, words, 2)
    )


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the words under the mask's ones, for every place it can be laid at."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # a leading one keeps masks apart that differ in their leading zeros
    total = np.full(n, int("1" + mask, 2), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            total = total * MULTIPLIER + words[j : j + n]
    return mixed(total)


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bitmap for each hash."""
    shift = np.uint64(64 - BITMAP_BITS)
    return (hashes >> shift).astype(np.int64), (mixed(hashes, 1) >> shift).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def hashed_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``words`` and the item's seeds: ``places``, ``hashes``, ``slots``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tokens(texts(batch)).words_only()
            per = np.split(found.hashes, np.cumsum(found.counts)[:-1])
            lists: list[list] = [[], [], [], []]
            for words in per[: batch.num_rows]:
                each = [seeds(words, m) for m in masks_for(len(words))]
                hashes = np.concatenate([np.zeros(0, np.uint64), *each])
                lists[0].append(words.view(np.int64))
                lists[1].append(np.concatenate([np.zeros(0, np.int64), *(np.arange(len(e)) for e in each)]))
                lists[2].append(hashes.view(np.int64))
                lists[3].append(np.concatenate(_slots(hashes)))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(x, pa.list_(pa.int64())) for x in lists)],
                ["item_id", "words", "places", "hashes", "slots"],
            )

    return narrowed(benchmark, id_col, text_col).mapInArrow(
        work,
        "item_id bigint, words array<bigint>, places array<bigint>, hashes array<bigint>,"
        " slots array<bigint>",
    )


def bitmap(items: DataFrame, width: int = BITMAP_BITS) -> np.ndarray:
    """Which of 2**``width`` slots the items' seeds fall into, as one bit each."""

    def page(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PAGE_BITS, np.uint8)
        bits[table["slot"].to_numpy() & ((1 << PAGE_BITS) - 1)] = 1
        return pa.table(
            {
                "page": pa.array([key[0].as_py()], pa.int64()),
                "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
            }
        )

    pages = (
        items.select(F.explode("slots").alias("slot"))
        .distinct()
        .select(F.shiftright("slot", PAGE_BITS).alias("page"), "slot")
        .groupBy("page")
        .applyInArrow(page, "page bigint, bits binary")
    )
    whole = np.zeros((1 << (width - PAGE_BITS), 1 << (PAGE_BITS - 3)), np.uint8)
    for row in pages.collect():  # at most 2**(width - PAGE_BITS) rows of fixed size
        whole[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    return whole.reshape(-1)


def masks_of(items: DataFrame) -> list[str]:
    """All masks that some of the hashed ``items`` are searched for by."""
    sizes = F.least(F.size("words"), F.lit(LONG_WORDS)).alias("n")
    found = items.select(sizes).distinct().collect()  # LONG_WORDS + 1 rows at most
    return sorted({mask for row in found for mask in masks_for(row["n"])})


def regions(docs: DataFrame, bits: np.ndarray, pad: int, masks: list[str]) -> DataFrame:
    """Stretches of texts around places that may hit under one of ``masks``.

    ``doc_id``, ``start`` (number of its first word), ``words`` with ``pad`` words on both
    sides of the places, and the ``places`` (from the stretch's start) and their ``hashes``.
    """

    def maybe(hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for slot in _slots(hashes):
            found &= (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 != 0
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = column(batch, "doc_id").to_numpy(), texts(batch)
            out: list[list] = [[], [], [], [], []]
            for part in blocks(own):
                found = tokens(own[part]).words_only()
                ends = np.cumsum(found.counts)
                begins = ends - found.counts
                hits, hashes = [], []
                for mask in masks:
                    each = seeds(found.hashes, mask)
                    at = np.flatnonzero(maybe(each))
                    owner = np.searchsorted(ends, at, "right")
                    at = at[at + len(mask) <= ends[owner]]
                    hits.append(at)
                    hashes.append(each[at])
                at = np.concatenate([np.zeros(0, np.int64), *hits])
                each = np.concatenate([np.zeros(0, np.uint64), *hashes])
                order = np.argsort(at, kind="stable")
                at, each = at[order], each[order]
                owner = np.searchsorted(ends, at, "right")
                left = np.maximum(at - pad, begins[owner])
                right = np.minimum(at + max(map(len, masks), default=0) + pad, ends[owner])
                new = np.ones(len(at), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (left[1:] > right[:-1])
                firsts = np.flatnonzero(new)
                for a, b in zip(firsts, np.append(firsts[1:], len(at))):
                    out[0].append(ids[part.start + owner[a]])
                    out[1].append(left[a] - begins[owner[a]])
                    out[2].append(found.hashes[left[a] : right[b - 1]].view(np.int64))
                    out[3].append(at[a:b] - left[a])
                    out[4].append(each[a:b].view(np.int64))
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x, kind)
                    for x, kind in zip(out, (pa.int64(), pa.int64(), many, many, many))
                ],
                ["doc_id", "start", "words", "places", "hashes"],
            )

    return (
        narrowed(docs)
        .where("doc_id IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(
            work,
            "doc_id bigint, start bigint, words array<bigint>, places array<bigint>,"
            " hashes array<bigint>",
        )
    )


def best_stretch(equal: np.ndarray, width: int, share: float) -> tuple[int, int, int] | None:
    """First and end place of the stretches of ``width`` that are equal enough, and how many
    places are equal between them."""
    if width <= 0 or len(equal) < width:
        return None
    sums = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(sums[width:] - sums[:-width] >= math.ceil(share * width - 1e-9))
    if not len(good):
        return None
    first, end = int(good[0]), int(good[-1]) + width
    return first, end, int(sums[end] - sums[first])


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = MIN_WORDS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Overlaps of ``docs`` (doc_id, text) with ``benchmark`` (item_id, text).

    One row for each document and item that overlap: ``doc_id``, ``item_id``, and of the
    overlap with most equal words ``doc_start`` and ``doc_end`` (words, end exclusive),
    ``item_start`` and ``matched`` (equal words).
    """
    items = cut(hashed_items(benchmark), "items")
    near = cut(regions(docs, bitmap(items), min_words, masks_of(items)), "regions")
    seeds_of = items.select(
        F.explode(F.arrays_zip("places", "hashes")).alias("s"), "item_id"
    ).select(F.col("s.hashes").alias("hash"), F.col("s.places").alias("item_place"), "item_id")
    hits = near.select(
        "doc_id", "start", F.explode(F.arrays_zip("places", "hashes")).alias("s")
    ).select("doc_id", "start", F.col("s.hashes").alias("hash"), F.col("s.places").alias("place"))
    laid = (
        hits.join(seeds_of, "hash")
        .select("doc_id", "start", "item_id", (F.col("place") - F.col("item_place")).alias("shift"))
        .distinct()
    )
    schema = (
        "doc_id bigint, item_id bigint, doc_start bigint, doc_end bigint, item_start bigint,"
        " matched bigint"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "doc_start", "doc_end", "item_start", "matched"]
        for batch in batches:
            found = []
            for row in zip(*(column(batch, n) for n in ("doc_id", "item_id", "start", "shift", "words", "item_words"))):
                doc, item, start, shift = (x.as_py() for x in row[:4])
                own, other = (x.values.to_numpy() for x in row[4:])
                a, b = max(0, shift), min(len(own), len(other) + shift)
                equal = own[a:b] == other[a - shift : b - shift]
                good = best_stretch(equal, min(min_words, len(other)), min_share)
                if good:
                    found.append(
                        (doc, item, start + a + good[0], start + a + good[1], a - shift + good[0], good[2])
                    )
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in found], pa.int64()) for i in range(len(names))], names
            )

    side_by_side = laid.join(near.select("doc_id", "start", "words"), ["doc_id", "start"]).join(
        items.select("item_id", F.col("words").alias("item_words")), "item_id"
    )
    best = F.max(
        F.struct("matched", (-F.col("doc_start")).alias("s"), "doc_start", "doc_end", "item_start")
    )
    return (
        side_by_side.mapInArrow(verify, schema)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", "b.doc_start", "b.doc_end", "b.item_start", "b.matched")
    )


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text overlaps no benchmark item."""
    bad = cut(overlaps(docs, benchmark).select(F.col("doc_id").alias("__bad")).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
