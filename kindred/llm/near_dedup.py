"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words. A shingle weighs 1 + ln(its count in the text)
times its inverse document frequency, which is the mean over its words. Word frequencies
are counted over all documents in a table of ``2**IDF_BITS`` hashed slots, so their size is
fixed, and each word's factor lies between 1 (in every document) and 2 (in none other).
Frequencies of whole shingles are not counted: nearly all of them are 1, and those that are not
belong to the very copies that are looked for, whose likeness they would hide.

Samples are drawn bin-wise: in each of ``PASSES`` passes a shingle falls into one of ``BINS``
bins by its hash, and every bin keeps the consistent weighted sample (Ioffe's
construction) of its shingles; an empty bin borrows from the next. Equal samples have the
probability of the weighted Jaccard similarity. ``ROWS`` samples make a band.

Documents whose texts are equal are one class. Class representatives that agree in a band
are candidates. Pairs are never listed all against all: in each band bucket, the lowest id
is compared with every other member, and links are closed to groups. What is left are
members outside the lowest member's group. Each of them is held against all members of other
groups of its bucket, inside tasks of about ``BLOCK`` by ``BLOCK`` members: first by the share of
equal samples, then, for members that have a partner with ``AGREE`` of them equal, by their
texts. A task returns the links that join what it has not joined yet, so fewer rows than it
has members, and links are closed once more. All links are verified by the exact weighted
Jaccard similarity of the shingles, ``SIMILARITY`` or more.

Defined cases: null counts as empty; empty texts are copies of each other; a text of one to four
words has one shingle; rows without an id take no part; repeated rows are one class and
each gets its row; an empty table gives an empty result. Words are compared in lower
case without punctuation around them. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.words import (
    PLAIN,
    blocks,
    column,
    grouped_runs,
    mixed,
    narrowed,
    texts,
    tokens,
)
from kindred.session import cut

SHINGLE = 5
SIMILARITY = 0.8
IDF_BITS = 18
PASSES, BINS, ROWS = 16, 8, 6
BANDS = PASSES * BINS // ROWS
#: Members of a bucket that are laid side by side in one task, and shingles of their texts.
BLOCK, BLOCK_SHINGLES = 2_000, 1_000_000
#: Share of all samples that must agree before texts are compared: at a similarity of 0.8 this
#: is more than five standard deviations below the mean.
AGREE = 0.6
#: Members that are compared with one text in one task.
SHARE = 256

_BIN_BITS = 3


def _key(docs: DataFrame) -> DataFrame:
    """Ids and texts with the class key of the text."""
    return (
        narrowed(docs)
        .where("doc_id IS NOT NULL")
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("text_key", F.unhex(F.md5("text")))
    )


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)


def word_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each word slot, from 1 to 2."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(1 << IDF_BITS, np.int64), 0
        for batch in batches:
            own = texts(batch)
            rows += len(own)
            for part in blocks(own):
                found = tokens(own[part]).words_only()
                both = np.sort((found.owner << IDF_BITS) | _slots(found.hashes))
                both = both[np.diff(both, prepend=-1) != 0]
                counts += np.bincount(both & ((1 << IDF_BITS) - 1), minlength=1 << IDF_BITS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(counts[at], rows))], ["slot", "n"]
        )

    totals = narrowed(docs).select("text").mapInArrow(work, "slot bigint, n bigint")
    # at most 2**IDF_BITS rows and one for the number of documents
    table = totals.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = table["slot"].to_numpy(), table["n"].to_numpy()
    rows = max(2, int(n[slot == -1].sum()) + 1)
    frequency = np.zeros(1 << IDF_BITS)
    frequency[slot[slot >= 0]] = n[slot >= 0]
    return (1.0 + np.log(rows / (frequency + 1.0)) / np.log(rows)).clip(1.0, 2.0)


def weighted_shingles(
    batch: list[bytes | None], idf: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts in order of text and hash: hashes, weights, and how many
    each text has."""
    found = tokens(batch).words_only()
    shingles, many = grouped_runs(found.hashes, found.counts, SHINGLE)
    worth = np.concatenate([[0.0], np.cumsum(idf[_slots(found.hashes)])])
    begins = np.cumsum(found.counts) - found.counts
    first = np.arange(len(shingles)) + np.repeat(begins - (np.cumsum(many) - many), many)
    last = np.minimum(first + SHINGLE, np.repeat(begins + found.counts, many))
    mean = (worth[last] - worth[first]) / np.maximum(last - first, 1)
    owner = np.repeat(np.arange(len(batch)), many)
    order = np.lexsort((shingles, owner))
    shingles, owner, mean = shingles[order], owner[order], mean[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(shingles)))
    return shingles[at], mean[at] * (1.0 + np.log(times)), np.bincount(owner[at], minlength=len(batch))


def _uniforms(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) out of one 64-bit value."""
    scale = 1.0 / (1 << 32)
    high = (bits >> np.uint64(32)).astype(np.float64)
    low = (bits & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return (high + 0.5) * scale, (low + 0.5) * scale


def samples(shingles: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples of each text, one row of ``PASSES * BINS`` values."""
    n = len(counts)
    base = np.repeat(np.arange(n, dtype=np.int64) << _BIN_BITS, counts)
    log_weight = np.log(weights)
    out = np.zeros((n, PASSES * BINS), np.uint64)
    for p in range(PASSES):
        bits = mixed(shingles, 3 * p + 1)
        u1, u2 = _uniforms(bits)
        u3, u4 = _uniforms(mixed(bits, 3 * p + 2))
        u5, _ = _uniforms(bits * np.uint64(0xD6E8FEB86659FD93) ^ (bits >> np.uint64(29)))
        r, c = -np.log(u1 * u2), -np.log(u3 * u4)
        steps = np.floor(log_weight / r + u5)
        value = np.log(c) - r * (steps - u5) - r
        low = np.full(n << _BIN_BITS, np.inf)
        bin_of = (mixed(shingles, 3 * p + 3) >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        np.minimum.at(low, base + bin_of, value)
        low = low.reshape(n, BINS)
        found = low.copy()
        away = np.zeros((n, BINS), np.uint64)
        for step in range(1, BINS):
            empty = np.isinf(found)
            if not empty.any():
                break
            found[empty] = np.roll(low, -step, axis=1)[empty]
            away[empty] = step
        own = np.arange(p * BINS, (p + 1) * BINS, dtype=np.uint64)
        out[:, own.astype(int)] = mixed(mixed(found.view(np.uint64), 7) + own * np.uint64(64) + away)
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """Hashes of the bands; a band takes its samples from different passes."""
    across = values.reshape(len(values), PASSES, BINS).transpose(0, 2, 1)
    rows = across.reshape(len(values), PASSES * BINS)[:, : BANDS * ROWS]
    rows = rows.reshape(len(values), BANDS, ROWS)
    total = np.zeros(rows.shape[:2], np.uint64)
    for j in range(ROWS):
        total = mixed(total + rows[:, :, j], j + 1)
    return mixed(total + np.arange(BANDS, dtype=np.uint64))


def signed(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """Of every document ``doc_id``, ``text_key``, ``signature`` and ``shingles``, their number.

    A signature is the band hashes, then 16 bits of every sample; it is empty for a text
    without any word.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out, many = texts(batch), [], []
            for part in blocks(own):
                shingles, weights, counts = weighted_shingles(own[part], idf)
                many += counts.tolist()
                drawn = samples(shingles, weights, counts)
                wide, narrow = bands(drawn), (drawn >> np.uint64(48)).astype(np.uint16)
                out += [
                    w.tobytes() + n.tobytes() if c else b"" for w, n, c in zip(wide, narrow, counts)
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    column(batch, "text_key"),
                    pa.array(out, pa.binary()),
                    pa.array(many, pa.int64()),
                ],
                ["doc_id", "text_key", "signature", "shingles"],
            )

    schema = "doc_id bigint, text_key binary, signature binary, shingles bigint"
    return _key(docs).mapInArrow(work, schema)


def _unpacked(classes: DataFrame) -> DataFrame:
    """One row for each representative and band: ``bucket``, ``id``."""
    words = BANDS + PASSES * BINS // 4

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "id").to_numpy()
            raw = b"".join(column(batch, "signature").to_pylist())
            values = np.frombuffer(raw, np.int64).reshape(-1, words)[:, :BANDS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.reshape(-1)), pa.array(np.repeat(ids, BANDS))],
                ["bucket", "id"],
            )

    return (
        classes.where(F.length("signature") > 0)
        .select("id", "signature")
        .mapInArrow(work, "bucket bigint, id bigint")
    )


def _agreeing(
    own: pa.Table, other: pa.Table
) -> Iterator[tuple[int, np.ndarray]]:
    """Of every row of ``own`` its number and those rows of ``other`` that are in another
    group and agree in enough samples."""

    def drawn(table: pa.Table) -> np.ndarray:
        raw = b"".join(table["samples"].to_pylist())
        return np.frombuffer(raw, np.uint16).reshape(-1, PASSES * BINS)

    if not (len(own) and len(other)):
        return
    least = int(AGREE * PASSES * BINS)
    mine, theirs = drawn(own), np.ascontiguousarray(drawn(other).T)
    home, away = own["group"].to_numpy(), other["group"].to_numpy()
    for i in range(len(own)):
        equal = np.zeros(len(other), np.int16)
        for j in range(PASSES * BINS):
            equal += theirs[j] == mine[i, j]
        at = np.flatnonzero((equal >= least) & (away != home[i]))
        if len(at):
            yield i, at[np.argsort(-equal[at], kind="stable")]


def alike(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets that agree with one of another group in enough samples.

    ``placed`` holds ``bucket``, ``id``, ``group`` and ``home``, the group of the bucket's lowest
    member. Every member outside ``home`` is held against every member of another group.
    Returns ``bucket``, ``o``, ``b`` (the task), ``mine`` (outside ``home``, or its partner),
    ``id``, ``group`` and ``samples``.
    """
    apart = F.col("group") != F.col("home")
    sized = placed.join(classes.select("id", "shingles"), "id")

    def parts(rows: Column) -> Column:
        members = F.count(F.when(rows, 1)) / BLOCK
        words = F.sum(F.when(rows, F.col("shingles")).otherwise(0)) / BLOCK_SHINGLES
        return F.ceil(F.greatest(members, words)).cast("int")

    sizes = sized.groupBy("bucket").agg(
        parts(F.lit(True)).alias("blocks"), parts(apart).alias("outer")
    )
    open_ = (
        placed.join(sizes.where("outer > 0"), "bucket")
        .join(classes.select("id", F.substring("signature", 8 * BANDS + 1, 1 << 20).alias("samples")), "id")
        .withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("o", F.pmod(F.xxhash64("id"), F.col("outer")).cast("int"))
    )
    columns = ["bucket", "o", "b", "id", "group", "samples"]
    left = open_.where(apart).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    right = open_.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)))

    def work(own: pa.Table, other: pa.Table) -> pa.Table:
        other = other.rename_columns(columns)
        own = own.rename_columns(columns)
        first, second = [], np.zeros(len(other), bool)
        for i, at in _agreeing(own, other):
            first.append(i)
            second[at] = True
        kept = [(own.take(pa.array(first, pa.int64())), True), (other.filter(pa.array(second)), False)]
        return pa.concat_tables(
            t.append_column("mine", pa.array([side] * len(t), pa.bool_())) for t, side in kept
        )

    key = columns[:3]
    others = right.select(*[F.col(c).alias(f"other_{c}" if c in key else c) for c in columns])
    return (
        left.select(*[F.col(c).alias(f"own_{c}" if c in key else c) for c in columns])
        .groupBy(*[f"own_{c}" for c in key])
        .cogroup(others.groupBy(*[f"other_{c}" for c in key]))
        .applyInArrow(
            work,
            "bucket bigint, o int, b int, id bigint, group bigint, samples binary, mine boolean",
        )
    )


def joined(docs: DataFrame, members: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Links between ``members`` as ``alike`` returns them: ``a``, ``b``, ``similarity``.

    A task holds the texts of its members, in size bounded by ``BLOCK_SHINGLES`` and one text.
    Pairs that agree in most samples come first; pairs that are joined already through
    other members are not compared.
    """

    def work(table: pa.Table) -> pa.Table:
        own, other = (table.filter(pa.compute.equal(table["mine"], side)) for side in (True, False))
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        top: dict[int, int] = {}
        for rows in (own, other):
            ids, words = rows["id"].to_pylist(), rows["text"].to_pylist()
            raw = [(w or "").encode() for w in words]
            for part in blocks(raw):
                hashes, weights, counts = weighted_shingles(raw[part], idf)
                ends = np.cumsum(counts)
                for i, end in enumerate(ends):
                    mine = slice(end - counts[i], end)
                    known[ids[part.start + i]] = hashes[mine], weights[mine]
            top.update(zip(rows["group"].to_pylist(), rows["group"].to_pylist()))

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        out: list[tuple[int, int, float]] = []
        names, groups_ = other["id"].to_pylist(), other["group"].to_pylist()
        ids, homes = own["id"].to_pylist(), own["group"].to_pylist()
        for i, at in _agreeing(own, other):
            for j in at.tolist():
                a, b = root(homes[i]), root(groups_[j])
                if a == b:
                    continue
                score = jaccard(known[ids[i]], known[names[j]])
                if score >= similarity:
                    top[max(a, b)] = min(a, b)
                    out.append((max(ids[i], names[j]), min(ids[i], names[j]), score))
        return pa.table(
            {
                "a": pa.array([r[0] for r in out], pa.int64()),
                "b": pa.array([r[1] for r in out], pa.int64()),
                "similarity": pa.array([r[2] for r in out], pa.float64()),
            }
        )

    return (
        _texts_of(docs, members)
        .groupBy("bucket", "o", "b")
        .applyInArrow(work, "a bigint, b bigint, similarity double")
        .dropDuplicates(["a", "b"])
    )


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``group`` (lowest id reached) of all ends of ``edges`` (a, b).

    Large-star and small-star steps on edges from higher to lower ids, until nothing changes.
    """
    now = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        "links",
    )
    while True:
        # done when every id has one lower neighbour and no lower neighbour has one itself
        tops = now.select(F.col("b").alias("a")).distinct()
        twice = now.groupBy("a").count().where("count > 1").select("a")
        if now.join(tops, "a", "left_semi").select("a").union(twice).isEmpty():
            break
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        down = (
            both.join(low, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        floor = down.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            down.join(floor, "a")
            .select(
                F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"),
                F.col("low").alias("b"),
            )
            .where("a <> b")
            .distinct()
        )
        now = cut(small, "links")
    return now.select(F.col("a").alias("id"), F.col("b").alias("group")).union(
        now.select("b", "b").distinct()
    )


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the texts of its ``id``. A merge join at every size."""
    own = narrowed(docs).where("doc_id IS NOT NULL")
    return own.hint("merge").join(wanted, F.col("doc_id") == F.col("id")).drop("doc_id")


def verified(docs: DataFrame, pairs: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Those of ``pairs`` (hub, id) whose texts are similar: ``a``, ``b``, ``similarity``.

    Each text travels once to every hub it is compared with; a hub with many members is
    split into shares, each with its own copy of the hub's text.
    """
    sizes = pairs.groupBy("hub").agg(
        F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")
    )
    dealt = pairs.join(sizes, "hub").select(
        "id", "hub", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share")
    )
    own = sizes.select(
        F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    )
    rows = (
        _texts_of(docs, dealt.union(own))
        .select("hub", "share", "id", (F.col("id") != F.col("hub")).alias("member"), "text")
        .repartition("hub", "share")
        .sortWithinPartitions("hub", "share", "member", "id")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_id, hub = None, None
        for batch in batches:
            own_texts = texts(batch)
            hubs, ids = column(batch, "hub").to_numpy(), column(batch, "id").to_numpy()
            out: list[tuple] = []
            for part in blocks(own_texts):
                hashes, weights, counts = weighted_shingles(own_texts[part], idf)
                ends = np.cumsum(counts)
                for i, end in enumerate(ends):
                    row = part.start + i
                    mine = slice(end - counts[i], end)
                    if hubs[row] == ids[row]:
                        hub_id, hub = ids[row], (hashes[mine].copy(), weights[mine].copy())
                        continue
                    score = jaccard(hub, (hashes[mine], weights[mine]))
                    if hub_id == hubs[row] and score >= similarity:
                        out.append((ids[row], hub_id, score))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], pa.int64()),
                    pa.array([r[1] for r in out], pa.int64()),
                    pa.array([r[2] for r in out], pa.float64()),
                ],
                ["a", "b", "similarity"],
            )

    return rows.mapInArrow(work, "a bigint, b bigint, similarity double").dropDuplicates(["a", "b"])


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted lists of shingles with weights."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    common = np.minimum(a[1][at[same]], b[1][same]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total else 1.0


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``class_id``, ``group_id`` and ``n_links`` of every document with an id.

    ``class_id`` is the lowest id with the same text, ``group_id`` the lowest id of all
    documents linked to it through similar texts, ``n_links`` the number of texts that the
    class was found similar to by direct comparison.
    """
    idf = word_weights(docs)
    rows = cut(signed(docs, idf), "signatures")
    classes = cut(
        rows.groupBy("text_key").agg(
            F.min("doc_id").alias("id"),
            F.min("signature").alias("signature"),
            F.min("shingles").alias("shingles"),
        ),
        "classes",
    )
    crowded = _unpacked(classes)
    filled = crowded.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n"))
    buckets = cut(crowded.join(filled.where("n > 1"), "bucket").select("bucket", "id", "hub"), "buckets")

    pairs = cut(buckets.where("id <> hub").select("hub", "id").distinct(), "pairs")
    edges = cut(verified(docs, pairs, idf, similarity), "edges")
    reached = cut(components(edges.select("a", "b")), "components")
    homes = reached.select(F.col("id").alias("hub"), F.col("group").alias("home"))
    placed = cut(
        buckets.join(reached, "id", "left")
        .join(homes, "hub", "left")
        .select(
            "bucket",
            "id",
            F.coalesce("group", "id").alias("group"),
            F.coalesce("home", "hub").alias("home"),
        ),
        "placed",
    )
    members = cut(alike(placed, classes), "members")
    if not members.isEmpty():
        edges = cut(edges.union(joined(docs, members, idf, similarity)), "edges")
        reached = cut(components(edges.select("a", "b")), "components")
    degrees = (
        edges.select("a").union(edges.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    )
    named = (
        classes.select("text_key", F.col("id").alias("class_id"))
        .join(reached, F.col("class_id") == F.col("id"), "left")
        .join(degrees, F.col("class_id") == F.col("a"), "left")
        .select(
            "text_key",
            "class_id",
            F.coalesce("group", "class_id").alias("group_id"),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        )
    )
    return rows.select("doc_id", "text_key").join(named, "text_key").drop("text_key")


def _repeated(docs: DataFrame) -> DataFrame:
    """``(doc_id, differ)`` of ids with several rows, and whether their texts differ."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return cut(
        docs.select("doc_id", key.alias("k"))
        .where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n"), (F.min("k") != F.max("k")).alias("differ"))
        .where("n > 1")
        .select("doc_id", "differ"),
        "repeated",
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns kept, with one document of each group: the lowest id.

    Rows without an id stay. Of rows that repeat both id and text one stays. Rows whose id bears
    several texts are judged each by its own text; they count as later than all others, and among
    themselves the order is that of a hash.
    """
    names = docs.columns
    repeated = _repeated(docs)
    shared = repeated.where("differ")
    if shared.isEmpty():
        return _keep_lowest(docs, repeated, similarity)
    marked = docs.join(
        shared.select(F.col("doc_id").alias("__shared")), F.col("doc_id") == F.col("__shared"), "left"
    )
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62)
    apart = cut(
        marked.select(
            *[F.col(f"`{c}`") for c in names if c != "doc_id"],
            F.col("doc_id").alias("__id"),
            F.when(F.col("__shared").isNotNull(), own).otherwise(F.col("doc_id")).alias("doc_id"),
        ),
        "apart",
    )
    kept = _keep_lowest(apart, _repeated(apart), similarity)
    return kept.drop("doc_id").withColumnRenamed("__id", "doc_id").select(*names)


def _keep_lowest(docs: DataFrame, repeated: DataFrame, similarity: float) -> DataFrame:
    """The same where no id bears different texts; ``repeated(doc_id)`` have several rows."""
    names = docs.columns
    found = cut(groups(docs, similarity).where("doc_id <> group_id"), "copies")
    away = found.select(F.col("doc_id").alias("__away")).distinct()
    kept = docs.join(away, docs["doc_id"] == away["__away"], "left_anti")
    if repeated.isEmpty():
        return kept
    several = repeated.select(F.col("doc_id").alias("__twice"))
    once = kept.join(several, kept["doc_id"] == several["__twice"], "left_anti")
    rest = kept.join(several, kept["doc_id"] == several["__twice"], "left_semi")
    return once.select(*names).union(rest.dropDuplicates(["doc_id", "text"]).select(*names))
