"""Ranked lexical search: documents of each query item, grouped by the mask of terms they hold.

Texts are split where they are read, and only the terms that some item asks for are kept: a
bitmap of fixed size over the items' terms keeps away nearly all others. What stays is written
once, a row for each document (postings by document), together with its length. Counts over all
documents give every term its weight.

The postings are then read batch by batch. For one item and one batch, every term of the item
has a bitmap over the documents; read across, the bitmaps give each document a mask of the terms
it holds. Documents with the same mask form a group, and a group's highest possible score is the
sum of its terms' highest contributions in the batch. Groups are scored by descending bound
until the next bound is below the ``k``-th best score that the task has found for the item
so far. The bounds only decide what is not scored, so the ranking is exact. A task hands on at most
``k`` rows for each item; these are merged in two steps, so that no task gets an item's rows of all
tasks.

Items are dealt to blocks of about ``BLOCK_TERMS`` terms by a hash of their ids. One block at a
time is sent to all tasks, and its terms decide what is read of the postings, so any number of items
can be asked for. An item is never split; its own size is the bound of a block then.

Terms are compared by 63-bit hashes. Scores are 64-bit whole numbers, ties go to the lower
document id.

Defined cases: null and empty texts hold no terms and are not counted; rows that repeat an id or
a text are documents of their own; documents without an id rank behind all others of the same score;
items without an id are left out, rows that repeat an item id are one item with the terms of all;
an item without terms, or whose terms no document holds, has no rows; an empty table on either
side gives no rows. Very long texts are worked on whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.decontamination import bitmap
from kindred.llm.words import EXACT, Tokens, blocks, column, flat_lists, narrowed, texts, tokens
from kindred.session import cut

K = 50
#: Terms of the items that are looked for at once.
BLOCK_TERMS = 200_000
#: Bits of the bitmap of asked terms, as a power of two.
BITMAP_BITS = 24
#: Bytes of text worked on at once; cells of the table of one item's terms and a batch's documents.
AT_ONCE, CELLS = 500_000, 4_000_000
#: Documents that are scored first; each next step scores twice as many.
STEP = 128
#: Slices in which the tasks' rows of one item are merged.
SLICES = 64


def _term_bytes() -> bytes:
    """Byte by byte: letters (lower-cased), digits and all that is not ASCII; else a blank."""
    keep = [chr(i).lower() if chr(i).isalnum() else " " for i in range(128)]
    return "".join(keep).encode() + bytes(range(128, 256))


TERM_BYTES = _term_bytes()


def terms(batch: list[bytes | None]) -> Tokens:
    """The terms of texts: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return tokens([t and t.translate(TERM_BYTES) for t in batch], EXACT)


def asked_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``item_id`` and ``term`` (a hash)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ids = texts(batch), column(batch, "doc_id").to_numpy()
            for part in blocks(own, AT_ONCE):
                found = terms(own[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part][found.owner]), pa.array(found.hashes.view(np.int64))],
                    ["item_id", "term"],
                )

    return (
        narrowed(items, id_col, text_col)
        .where("doc_id IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(work, "item_id bigint, term bigint")
        .distinct()
    )


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    """Two places in the bitmap for each hash; the lowest bit of a hash is always 1."""
    low = np.uint64((1 << BITMAP_BITS) - 1)
    return [((hashes >> np.uint64(s)) & low).astype(np.int64) for s in (1, 1 + BITMAP_BITS)]


def asked_bits(asked: DataFrame) -> np.ndarray:
    """The bitmap of all asked terms."""
    low = F.lit((1 << BITMAP_BITS) - 1).cast("bigint")
    places = [F.shiftright("term", s).bitwiseAND(low) for s in (1, 1 + BITMAP_BITS)]
    return bitmap(asked.select(F.array(*places).alias("slots")), BITMAP_BITS)


def postings(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``doc_id``, ``n`` (all terms), ``terms`` in the bitmap and ``tfs``, of texts with terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = texts(batch)
            for part in blocks(own, AT_ONCE):
                found = terms(own[part])
                good = np.ones(len(found.hashes), bool)
                for slot in _slots(found.hashes):
                    good &= (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 != 0
                hashes, owner = found.hashes[good], found.owner[good]
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                tfs = np.diff(np.append(first, len(hashes)))
                sizes = np.bincount(owner[first], minlength=len(found.counts))
                some = found.counts > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "doc_id")[part.start : part.stop].filter(pa.array(some)),
                        pa.array(found.counts[some]),
                        flat_lists(sizes[some], hashes[first].view(np.int64), pa.int64()),
                        flat_lists(sizes[some], tfs, pa.int32()),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return (
        narrowed(docs)
        .where("text IS NOT NULL")
        .mapInArrow(work, "doc_id bigint, n bigint, terms array<bigint>, tfs array<int>")
    )


def document_counts(posted: DataFrame) -> DataFrame:
    """``term`` and ``df``, the documents that hold it; counted inside tasks first."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, df = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df)], ["term", "df"])

    return (
        posted.select("terms")
        .mapInArrow(tally, "term bigint, df bigint")
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
    )


@dataclass
class Block:
    """Some items: of item i, its terms are ``place[start[i]:start[i + 1]]`` of ``vocabulary``."""

    ids: np.ndarray
    start: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    vocabulary: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Block:
        """From ``item_id``, ``term`` and ``weight``."""
        item, term, weight = (rows[c].to_numpy() for c in ("item_id", "term", "weight"))
        order = np.lexsort((term, item))
        item, term, weight = item[order], term[order], weight[order]
        ids, start = np.unique(item, return_index=True)
        vocabulary, place = np.unique(term, return_inverse=True)
        return cls(ids, np.append(start, len(item)), place, weight, vocabulary)


@dataclass
class Best:
    """The best documents of one item that a task has found so far, best first."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    docs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    no_id: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @property
    def floor(self) -> int:
        """A score below this is of no use."""
        return int(self.scores[-1]) if len(self.scores) >= self.k else 1

    def add(self, scores: np.ndarray, docs: np.ndarray, no_id: np.ndarray) -> None:
        good = scores >= self.floor
        scores, docs, no_id = (
            np.concatenate([a, b[good]])
            for a, b in ((self.scores, scores), (self.docs, docs), (self.no_id, no_id))
        )
        order = np.lexsort((docs, no_id, -scores))[: self.k]
        self.scores, self.docs, self.no_id = scores[order], docs[order], no_id[order]


def mask_groups(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks of the columns of ``present`` (terms x documents), one column for each,
    and which of them each document has."""
    packed = np.packbits(present, axis=0)
    wide = np.zeros((-(-len(packed) // 8) * 8, present.shape[1]), np.uint8)
    wide[: len(packed)] = packed
    words = np.ascontiguousarray(wide.T).view(np.uint64)
    group = np.zeros(len(words), np.int64)
    for word in words.T:
        # equal so far and equal in this word
        values, at = np.unique(word, return_inverse=True)
        _, group = np.unique(group * len(values) + at, return_inverse=True)
    first = np.zeros(group.max(initial=-1) + 1, np.int64)
    first[group] = np.arange(len(group))
    return present[:, first], group


def rank_batch(parts: np.ndarray, weight: np.ndarray, docs: np.ndarray, no_id: np.ndarray, best: Best) -> int:
    """Add the documents of one batch to ``best``; how many were scored.

    ``parts`` is terms x documents: what a term contributes for each unit of its ``weight``.
    """
    present = parts > 0
    masks, group = mask_groups(present)
    highest = weight * parts.max(axis=1, initial=0)
    bounds = highest @ masks.astype(np.int64)
    order = np.argsort(-bounds[group], kind="stable")
    falling = -bounds[group][order]
    done, step = 0, STEP
    while done < len(order):
        # as far as bounds reach the floor, and not more than a step
        until = min(int(np.searchsorted(falling, -best.floor, "right")), done + step)
        if until <= done:
            break
        at = order[done:until]
        best.add(weight @ parts[:, at].astype(np.int64), docs[at], no_id[at])
        done, step = until, step * 2
    return done


def best_of_block(posted: DataFrame, block: Block, per_length: tuple[int, int], k: int) -> DataFrame:
    """At most ``k`` rows for each item and task: ``item_id``, ``doc_id``, ``score``."""
    all_docs, all_terms = per_length

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in block.ids]
        for batch in batches:
            ids = column(batch, "doc_id")
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            n, lists = column(batch, "n").to_numpy(), column(batch, "terms")
            term, tf = lists.flatten().to_numpy(), column(batch, "tfs").flatten().to_numpy()
            at = np.minimum(np.searchsorted(block.vocabulary, term), len(block.vocabulary) - 1)
            known = block.vocabulary[at] == term
            doc = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())[known]
            at, tf = at[known], tf[known].astype(np.int64)
            length = 50 + (50 * n * all_docs) // all_terms
            part = ((1_000_000_000 * tf) // (1000 * tf + 20 * length[doc])).astype(np.int32)
            order = np.argsort(at, kind="stable")
            at, doc, part = at[order], doc[order], part[order]
            begin = np.searchsorted(at, np.arange(len(block.vocabulary) + 1))
            for i in range(len(block.ids)):
                mine = slice(block.start[i], block.start[i + 1])
                place = block.place[mine]
                size = begin[place + 1] - begin[place]
                row = np.repeat(np.arange(len(place)), size)
                # positions of all entries of the item's terms, term after term
                entry = np.arange(size.sum()) + np.repeat(begin[place] - (np.cumsum(size) - size), size)
                width = max(1, CELLS // len(place))
                for first in range(0, len(n), width):
                    here = entry[(doc[entry] >= first) & (doc[entry] < first + width)]
                    rows = row[(doc[entry] >= first) & (doc[entry] < first + width)]
                    held = np.unique(doc[here])
                    parts = np.zeros((len(place), len(held)), np.int32)
                    parts[rows, np.searchsorted(held, doc[here])] = part[here]
                    rank_batch(parts, block.weight[mine], ids[held], no_id[held], best[i])
        sizes = [len(b.scores) for b in best]
        docs = np.concatenate([np.zeros(0, np.int64), *(b.docs for b in best)])
        no_id = np.concatenate([np.zeros(0, bool), *(b.no_id for b in best)])
        scores = np.concatenate([np.zeros(0, np.int64), *(b.scores for b in best)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(block.ids, sizes)), pa.array(docs, mask=no_id), pa.array(scores)],
            ["item_id", "doc_id", "score"],
        )

    return posted.mapInArrow(work, "item_id bigint, doc_id bigint, score bigint")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    asked = cut(asked_terms(items, item_id, text_col), "asked")
    posted = cut(postings(narrowed(docs, doc_id, text_col), asked_bits(asked)), "postings")
    all_docs, all_terms = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(1000 * F.log(F.lit(2.0 * all_docs + 2.0) / (2 * F.col("df") + 1)))
    weighed = cut(
        asked.join(document_counts(posted), "term")
        .select("item_id", "term", weight.cast("bigint").alias("weight"))
        .where("weight > 0"),
        "weights",
    )
    n_blocks = max(1, math.ceil(weighed.count() / BLOCK_TERMS))
    number = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    found = None
    for i in range(n_blocks):
        # about BLOCK_TERMS rows, or the terms of one item
        block = Block.of(weighed.where(number == i).toArrow())
        if len(block.ids):
            of_block = best_of_block(posted, block, (all_docs, all_terms), k)
            found = of_block if found is None else found.union(of_block)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], "item_id bigint, rank int, doc_id bigint, score bigint"
        )
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    in_slice = Window.partitionBy("item_id", "slice").orderBy(*order)
    of_item = Window.partitionBy("item_id").orderBy(*order)
    return (
        found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SLICES)))
        .withColumn("place", F.row_number().over(in_slice))
        .where(F.col("place") <= k)
        .withColumn("rank", F.row_number().over(of_item))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


# The characters that end a term, for SQL.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SQL = rf"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts
  FROM documents WHERE text IS NOT NULL
),
docs AS (SELECT doc_id, r, CAST(len(ts) AS BIGINT) AS size, ts FROM texts WHERE len(ts) > 0),
totals AS (SELECT count(*) AS all_docs, CAST(sum(size) AS BIGINT) AS all_terms FROM docs),
asked AS (
  SELECT DISTINCT item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
),
held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term
),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals
),
parts AS (
  SELECT h.r, d.doc_id, h.term,
         weights.w * ((1000000000 * h.tf) // (1000 * h.tf + 20 * (50 + (50 * d.size * all_docs) // all_terms))) AS part
  FROM held h JOIN docs d ON d.r = h.r JOIN weights ON weights.term = h.term, totals
),
scores AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(part) AS BIGINT) AS score
  FROM asked JOIN parts ON parts.term = asked.term GROUP BY item_id, r
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores WHERE score > 0
) WHERE rank <= 50
"""
