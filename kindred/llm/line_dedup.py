"""Line dedup by winnowing: repeated runs are found, extended and deleted where they recur.

Every text is read as one line of words after another. A hash is taken of each run of
``RUN`` words, and of every ``WINDOW`` neighbouring hashes the smallest is a
fingerprint. Two texts that share ``RUN + WINDOW - 1`` = 50 words in a row therefore
share a fingerprint, wherever the words stand and however the lines are broken; that
guarantee is why the hashes are taken over words and not over whole lines, whose
breaks move when a passage is pasted into another line.

Each fingerprint's first place (lowest document id, then lowest position) is its source. Later
places are joined with it, and fingerprints that continue one another on the same shift become one
run. A window of ``MIN_WORDS`` words belongs to its first smallest fingerprint. Where it lies inside
a run, it is repeated; where it sticks out, the source may differ there while another
document has the whole window, so all windows of that fingerprint are hashed themselves, in
every document, and each is compared with its own first place. What is deleted is thus exact:
every word of a window of ``MIN_WORDS`` words that stands at an earlier place too, with the
blanks before it; first occurrences stay.

Only fingerprints (about one for 13 words) and the windows at the edges of runs are shuffled, and the
texts once, by document. Which fingerprints' windows are asked for is sent to all tasks as a bitmap of
fixed size; a large input fills it and makes it less useful, never wrong. Each later place is
paired with one first place, never with all others, so a passage that stands in a third of all
documents costs one row for each of its places.

Defined cases: an id stands for one text (where different texts share an id, they are
taken for one another); a null text stays null; texts under 50 words stay as they are; rows without
an id are neither compared nor changed; rows that repeat an id with the same text are
changed alike; a text that is one repeated run becomes empty and its row stays. Repeats
inside one document count as well. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.decontamination import bitmap
from kindred.llm.words import (
    EXACT,
    blocks,
    column,
    flat_lists,
    long_runs,
    narrowed,
    texts,
    tokens,
)
from kindred.session import cut

#: Columns that :func:`remove` adds; those of the same name are replaced.
ADDED = ("removed_words", "removed_spans")

MIN_WORDS = 50
RUN = 26
WINDOW = MIN_WORDS - RUN + 1
#: Bits of the bitmap of fingerprints whose windows are hashed, as a power of two.
BITMAP_BITS = 27


def chosen(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For every window, the place of its minimum, the first one where there are ties."""
    out, have = np.arange(len(hashes)), 1
    while have < window:
        step = min(have, window - have)
        left, right = out[: max(0, len(out) - step)], out[step:]
        out = np.where(hashes[right] < hashes[left], right, left)
        have += step
    return out


def fingerprints(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the minima of all windows."""
    return np.unique(chosen(hashes, window))


def text_windows(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``MIN_WORDS`` words inside one text, and the places of
    their fingerprints; ``hashes`` are those of all runs of the texts' words in a row."""
    of = chosen(hashes)
    ends = np.repeat(np.cumsum(counts), counts)[: len(of)]
    first = np.flatnonzero(np.arange(len(of)) + MIN_WORDS <= ends)
    return first, of[first]


def _lead(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which places are the first of their hash in their text; places are in order."""
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = np.diff(owner[order]) != 0
    new[1:] |= np.diff(hashes[order].view(np.int64)) != 0
    out = np.zeros(len(order), bool)
    out[order] = new
    return out


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``place`` (number of the first word) and ``hash`` of all fingerprints.

    ``ahead`` and ``behind`` are how many words before ``place`` the first and the last window
    begin that belong to it; ``lead`` is whether it is the first place of its hash in the text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = column(batch, "doc_id").to_numpy(), texts(batch)
            for part in blocks(own):
                found = tokens(own[part], EXACT)
                hashes = long_runs(found.hashes, RUN)
                ends = np.cumsum(found.counts)
                first, of = text_windows(hashes, found.counts)
                last = np.flatnonzero(np.diff(of, append=-1))
                at = of[last]
                ahead = at - first[np.concatenate([[0], last + 1])[: len(last)]]
                behind = at - first[last]
                owner = np.searchsorted(ends, at, "right")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[part][owner]),
                        pa.array((at - (ends - found.counts)[owner]).astype(np.int32)),
                        pa.array(hashes[at].view(np.int64)),
                        pa.array(ahead.astype(np.int8)),
                        pa.array(behind.astype(np.int8)),
                        pa.array(_lead(owner, hashes[at])),
                    ],
                    ["doc_id", "place", "hash", "ahead", "behind", "lead"],
                )

    return (
        narrowed(docs)
        .where("doc_id IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(
            work,
            "doc_id bigint, place int, hash bigint, ahead tinyint, behind tinyint, lead boolean",
        )
    )


def first_places(places: DataFrame) -> DataFrame:
    """``hash``, ``source`` (document) and ``origin`` (place) of the first of several places.

    Written out, so that the join with all places is one of its own, in which a hash that stands
    in very many documents can be split.
    """
    leading = F.when(F.col("lead"), F.col("doc_id"))
    found = (
        places.groupBy("hash")
        .agg(
            F.min("doc_id").alias("source"),
            F.min_by("place", leading).alias("origin"),
            F.count(F.lit(1)).alias("n"),
        )
        .where("n > 1")
        .drop("n")
    )
    return cut(found, "first-places")


#: Places that are later than the first place they are joined with.
LATER = "doc_id > source OR doc_id = source AND place > origin"


def later_runs(marks: DataFrame) -> DataFrame:
    """Runs of fingerprints that continue one another in a document and in their source.

    ``doc_id``, ``first`` and ``end`` (words), and ``open``, the hashes of its fingerprints
    to which windows belong that stick out of the run.
    """
    pairs = (
        marks.join(first_places(marks), "hash")
        .where(LATER)
        .withColumn("shift", F.col("place") - F.col("origin"))
        .select("doc_id", "source", "shift", "place", "hash", "ahead", "behind")
        .repartition("doc_id", "source", "shift")
        .sortWithinPartitions("doc_id", "source", "shift", "place")
    )

    def runs_of(marks: pa.Table) -> pa.RecordBatch:
        """The runs of whole (doc_id, source, shift)."""
        doc, source, shift, place, hashes, ahead, behind = (
            marks[c].to_numpy().astype(np.int64) for c in marks.column_names
        )
        new = np.ones(len(doc), bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(source) != 0) | (np.diff(shift) != 0)
        new[1:] |= np.diff(place) > RUN
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        first, end = place[begin], place[np.append(begin[1:], len(doc)) - 1] + RUN
        out = (place - ahead < first[run]) | (place - behind + MIN_WORDS > end[run])
        # rows that repeat an id and a text give every mark repeatedly
        out[1:] &= new[1:] | (np.diff(place) != 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc[begin]),
                pa.array(first.astype(np.int32)),
                pa.array(end.astype(np.int32)),
                flat_lists(np.bincount(run[out], minlength=len(begin)), hashes[out], pa.int64()),
            ],
            ["doc_id", "first", "end", "open"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            if not rows.num_rows:
                continue
            keys = [rows[c].to_numpy() for c in ("doc_id", "source", "shift")]
            changes = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0))
            # the last (doc_id, source, shift) may go on in the next batch
            whole = int(changes[-1]) + 1 if len(changes) else 0
            if whole:
                yield runs_of(rows.slice(0, whole))
            kept = rows.slice(whole)
        if kept is not None and kept.num_rows:
            yield runs_of(kept)

    return pairs.mapInArrow(work, "doc_id bigint, first int, end int, open array<bigint>")


def asked(hashes: DataFrame) -> np.ndarray:
    """A bitmap of ``hash``. Fingerprints are small values, so their low bits are used."""
    low = F.lit((1 << BITMAP_BITS) - 1).cast("bigint")
    slots = F.array(
        F.col("hash").bitwiseAND(low), F.shiftright("hash", BITMAP_BITS).bitwiseAND(low)
    )
    return bitmap(hashes.select(slots.alias("slots")), BITMAP_BITS)


def windows(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``doc_id``, ``place`` and ``hash`` of the windows whose fingerprints are in ``bits``."""

    def wanted(hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for shift in (0, BITMAP_BITS):
            slot = ((hashes >> np.uint64(shift)) & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
            found &= (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 != 0
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = column(batch, "doc_id").to_numpy(), texts(batch)
            for part in blocks(own):
                found = tokens(own[part], EXACT)
                hashes = long_runs(found.hashes, RUN)
                ends = np.cumsum(found.counts)
                first, of = text_windows(hashes, found.counts)
                at = first[wanted(hashes)[of]]
                owner = np.searchsorted(ends, at, "right")
                whole = long_runs(found.hashes, MIN_WORDS)[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[part][owner]),
                        pa.array((at - (ends - found.counts)[owner]).astype(np.int32)),
                        pa.array(whole.view(np.int64)),
                        pa.array(_lead(owner, whole)),
                    ],
                    ["doc_id", "place", "hash", "lead"],
                )

    return (
        narrowed(docs)
        .where("doc_id IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(work, "doc_id bigint, place int, hash bigint, lead boolean")
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Words to delete: ``doc_id`` and ``spans``, an ordered array of (first, end)."""
    runs = cut(later_runs(cut(marked(docs), "marks")), "runs")
    open_ends = asked(runs.select(F.explode("open").alias("hash")))
    hashed = cut(windows(docs, open_ends), "windows")
    sticking_out = (
        hashed.join(first_places(hashed), "hash")
        .where(LATER)
        .select("doc_id", F.col("place").alias("first"), (F.col("place") + MIN_WORDS).alias("end"))
    )
    inside = runs.where(F.col("end") - F.col("first") >= MIN_WORDS)
    spans = (
        inside.select("doc_id", "first", "end")
        .union(sticking_out)
        .repartition("doc_id")
        .sortWithinPartitions("doc_id", "first", "end")
    )
    return spans.mapInArrow(_merged, "doc_id bigint, spans array<struct<first: int, end: int>>")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that touch or overlap become one; rows come by document and place."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        doc, first, end = (rows[c].to_numpy().astype(np.int64) for c in ("doc_id", "first", "end"))
        other = np.ones(len(doc), bool)
        other[1:] = np.diff(doc) != 0
        number = np.cumsum(other)
        # the end that is reached so far, in documents one behind the other
        reached = np.maximum.accumulate(number * (1 << 32) + end)
        new = other.copy()
        new[1:] |= (number[1:] * (1 << 32) + first[1:]) > reached[:-1]
        begin = np.flatnonzero(new)
        until = reached[np.append(begin[1:], len(doc)) - 1] & ((1 << 32) - 1)
        span = pa.StructArray.from_arrays(
            [pa.array(first[begin].astype(np.int32)), pa.array(until.astype(np.int32))], ["first", "end"]
        )
        counts = np.bincount(number[begin] - 1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[other]), pa.ListArray.from_arrays(offsets, span)], ["doc_id", "spans"]
        )

    kept: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        changes = np.flatnonzero(np.diff(rows["doc_id"].to_numpy()))
        whole = int(changes[-1]) + 1 if len(changes) else 0
        if whole:
            yield of(rows.slice(0, whole))
        kept = rows.slice(whole)
    if kept is not None and kept.num_rows:
        yield of(kept)


def _without(text: bytes, starts: np.ndarray, ends: np.ndarray, spans: list) -> tuple[bytes, int]:
    """The text without the spans and the blanks before them, and how many words went."""
    gone = np.zeros(len(starts) + 1, np.int64)
    for first, end in spans:
        gone[min(first, len(starts))] += 1
        gone[min(end, len(starts))] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    if not gone.any():
        return text, 0
    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    pieces, at = [], 0
    for a, b in zip(edges[0::2], edges[1::2]):
        pieces.append(text[at : ends[a - 1] if a else 0])
        at = ends[b - 1]
    pieces.append(text[at:])
    if edges[0] == 0:
        pieces[1] = pieces[1].lstrip(b" \t\n\r\x0b\x0c")
    return b"".join(pieces), int(gone.sum())


def remove(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``.

    All columns are kept, ``n_chars`` is counted anew where there is one, and
    the columns ``ADDED`` (counts and spans, in words of the old text) are added.
    """
    names = [c for c in docs.columns if c not in ADDED]
    spans = cut(repeated_spans(docs.withColumnRenamed(text_col, "text")), "spans").select(
        F.col("doc_id").alias("__doc_id"), F.col("spans").alias("__spans")
    )
    joined = docs.select(*names).join(
        spans.hint("shuffle_hash"), docs["doc_id"] == spans["__doc_id"], "left"
    )
    joined = joined.select(
        *[F.col(c).cast("bigint") if c == "n_chars" else F.col(c) for c in names],
        F.lit(0).cast("bigint").alias("removed_words"),
        F.col("__spans").alias("removed_spans"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of = column(batch, "removed_spans")
            counts = np.zeros(batch.num_rows, np.int64)
            changed = np.flatnonzero(spans_of.is_valid().to_numpy(zero_copy_only=False))
            columns = dict(zip(batch.schema.names, batch.columns))
            if len(changed):
                own = columns[text_col].cast(pa.string()).to_pylist()
                lengths = columns["n_chars"].to_pylist() if "n_chars" in columns else None
                for i in changed:
                    text = (own[i] or "").encode()
                    found = tokens([text], EXACT)
                    spans_here = [(s["first"], s["end"]) for s in spans_of[i].as_py()]
                    left, counts[i] = _without(text, found.starts, found.ends, spans_here)
                    own[i] = left.decode()
                    if lengths is not None:
                        lengths[i] = len(own[i])
                columns[text_col] = pa.array(own, columns[text_col].type)
                if lengths is not None:
                    columns["n_chars"] = pa.array(lengths, pa.int64())
            columns["removed_words"] = pa.array(counts)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(work, joined.schema)
