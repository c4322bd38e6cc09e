"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of the bytes
that followed them in the training texts, here kept as tables of n-grams. A byte's
probability starts at its longest context: with count c of n, q different bytes seen, it is
(c - 1/2) / n; an unseen byte costs the escape (q / 2) / n and goes on one context down,
where the bytes that the longer context knows are excluded from n and q (escape method D
with symbol exclusion). Below the empty context all bytes not excluded are equally likely.
Texts start after ``ORDER`` start marks and end with an end mark, bytes that UTF-8 never uses.

The model is pretrained: it counts all training texts and then stays as it is, so a
byte's code length depends on its ``ORDER + 1`` bytes alone. Each such n-gram is worked
out once, however often it stands in texts. Bytes seen after a long context have been
seen after every shorter one, so what a context excludes is a sum over its own children.

How it runs: texts are read in chunks. A chunk's distinct n-grams and words, with their
counts in training texts, are summed over all chunks; code lengths are worked out in groups
by the two bytes before the last, with the two lowest orders (at most 65,536 rows) sent along;
code lengths and word counts go back to the chunks that asked, which read their texts
once more. What is shuffled grows with the distinct n-grams and words of the chunks, nothing
else is held whole anywhere.

``chunk`` names a column that splits the texts into pieces of a few ten MB. For files it is the
file and the block that a text was read from, so that no text is moved before it is counted.

Defined cases: null is the empty text, which has the end only; rows without an id and rows
that repeat an id are scored each; with no training texts all bytes are equally likely and
the base score is 0 tokens known; an empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.words import LOWERED, blocks, column, narrowed, texts, tokens
from kindred.session import cut

ORDER = 4
# Bytes that no UTF-8 text holds.
START, END = 0xFE, 0xFF
#: The hash that stands for the end of a text among the words.
END_WORD = np.uint64(0xE0D)
ALPHABET = 256

#: Bytes of text that are worked on at once, with some ten numbers for each byte.
AT_ONCE = 500_000

GRAM, WORD_KIND = 0, 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)


def file_chunk() -> Column:
    """The file block that a row is read from; only right on top of a file scan."""
    return F.xxhash64(F.input_file_name(), F.input_file_block_start())


def grams(batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of ``ORDER + 1`` bytes as numbers, in order, and how many each text has.

    Every text gives one for each byte and one for its end.
    """
    counts = np.array([len(t or b"") + 1 for t in batch], np.int64)
    start, end = bytes([START]) * ORDER, bytes([END])
    joined = _LOWER[np.frombuffer(b"".join([p for t in batch for p in (start, t or b"", end)]), np.uint8)]
    codes = np.zeros(max(0, len(joined) - ORDER), np.int64)
    for i in range(ORDER + 1):
        codes = (codes << 8) | joined[i : len(joined) - ORDER + i]
    # n-grams that begin in a text's start marks or text; those that run over its end go
    begins = np.cumsum(counts + ORDER) - (counts + ORDER)
    keep = np.ones(len(joined), bool)
    last = begins[1:]
    for i in range(1, ORDER + 1):
        keep[last - i] = False
    return codes[keep[: len(codes)]], counts


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of what comes with them."""
    key, value = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    at = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0) != 0)
    return key[at], np.add.reduceat(value, at) if len(at) else value


def _runs_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1) != 0)
    return sorted_keys[at], np.diff(np.append(at, len(sorted_keys)))


class _Tally:
    """Distinct keys of a chunk with their counts in training texts."""

    #: Keys that are kept apart before they are summed up.
    PENDING = 1_000_000

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.pending = 0

    def add(self, keys: np.ndarray, train: bool) -> None:
        found, many = _runs_of(np.sort(keys))
        self.keys.append(found)
        self.n.append(many if train else np.zeros(len(many), np.int64))
        self.pending += len(found)
        if self.pending >= self.PENDING:
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys:
            key, n = _summed(self.keys, self.n)
            self.keys, self.n, self.pending = [key], [n], 0
            return key, n
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _with_ends(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end of each text after its words."""
    return np.insert(hashes, np.cumsum(counts), END_WORD).view(np.int64), counts + 1


def tallied(docs: DataFrame) -> DataFrame:
    """``chunk``, ``kind``, ``key`` and ``n`` (count in training texts, may be 0).

    ``docs`` holds ``chunk``, ``train`` and ``text``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_chunk, tallies = None, None

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, tally in enumerate(tallies):
                key, n = tally.close()
                for i in range(0, len(key), 200_000):
                    part = slice(i, i + 200_000)
                    size = len(key[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(size, open_chunk, np.int64)),
                            pa.array(np.full(size, kind, np.int32)),
                            pa.array(key[part]),
                            pa.array(n[part]),
                        ],
                        ["chunk", "kind", "key", "n"],
                    )

        for batch in batches:
            chunks, train = column(batch, "chunk").to_numpy(), column(batch, "train").to_numpy(zero_copy_only=False)
            own = texts(batch)
            for chunk in dict.fromkeys(chunks.tolist()):
                if chunk != open_chunk:
                    if tallies:
                        yield from flush()
                    open_chunk, tallies = chunk, (_Tally(), _Tally())
                for learned in (True, False):
                    mine = [own[i] for i in np.flatnonzero((chunks == chunk) & (train == learned))]
                    for part in blocks(mine, AT_ONCE):
                        tallies[GRAM].add(grams(mine[part])[0], learned)
                        found = tokens(mine[part], LOWERED)
                        tallies[WORD_KIND].add(_with_ends(found.hashes, found.counts)[0], learned)
        if tallies:
            yield from flush()

    return docs.select("chunk", "train", "text").mapInArrow(
        work, "chunk bigint, kind int, key bigint, n bigint"
    )


def low_orders(totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of bytes, and of bytes after each byte: at most 65,536 rows."""
    pairs = (
        totals.where("n > 0")
        .groupBy((F.col("key") % 65536).alias("pair"))
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    after = np.zeros((256, 256), np.float64)
    pair = pairs["pair"].to_numpy()
    after[pair >> 8, pair & 255] = pairs["n"].to_numpy()
    return after.sum(axis=0), after


def code_lengths(
    keys: np.ndarray, n: np.ndarray, alone: np.ndarray, after: np.ndarray
) -> np.ndarray:
    """log10 probability of the last byte of each n-gram, given the bytes before it.

    ``keys`` and ``n`` hold all n-grams of one pair of bytes before the last (so all that
    the orders from 2 up need), ``alone`` and ``after`` the counts of orders 0 and 1.
    """
    last = keys & 255
    logp = np.zeros(len(keys))
    left = np.ones(len(keys), bool)
    # total, different bytes and mass on the next lower order, of the context above
    above_mass = above_kinds = None
    for order in range(ORDER, -1, -1):
        if order >= 2:
            gram = keys & ((1 << 8 * (order + 1)) - 1)
            kinds, inverse = np.unique(gram, return_inverse=True)
            count = np.bincount(inverse, n, minlength=len(kinds))
            context, home = np.unique(kinds >> 8, return_inverse=True)
            total = np.bincount(home, count, minlength=len(context))
            many = np.bincount(home, count > 0, minlength=len(context))
            lower = kinds & ((1 << 8 * order) - 1)
            if order > 2:
                short, back = np.unique(lower, return_inverse=True)
                low_count = np.bincount(back, count, minlength=len(short))
                # counts of the shorter n-gram come from all longer ones, not this context's
                mass_of = low_count[back]
            else:
                mass_of = after[(kinds >> 8) & 255, kinds & 255]
            mass = np.bincount(home, np.where(count > 0, mass_of, 0.0), minlength=len(context))
            own, t, k, m = count[inverse], total[home][inverse], many[home][inverse], mass[home][inverse]
        elif order == 1:
            before = (keys >> 8) & 255
            own, t = after[before, last], after[before].sum(axis=1)
            k = (after[before] > 0).sum(axis=1)
            m = np.where(after[before] > 0, alone, 0.0).sum(axis=1)
        else:
            own, t = alone[last], np.full(len(keys), alone.sum())
            k, m = np.full(len(keys), float((alone > 0).sum())), np.zeros(len(keys))
        free = t - (0.0 if above_mass is None else above_mass)
        kinds_left = k - (0.0 if above_kinds is None else above_kinds)
        seen = left & (t > 0) & (kinds_left > 0)
        hit = seen & (own > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            logp += np.where(hit, np.log10((own - 0.5) / free), 0.0)
            logp += np.where(seen & ~hit, np.log10(0.5 * kinds_left / free), 0.0)
        left &= ~hit
        above_mass = np.where(t > 0, m, 0.0)
        above_kinds = np.where(t > 0, k, 0.0)
    unseen = ALPHABET - (alone > 0).sum()
    return logp - np.where(left, np.log10(max(1, unseen)), 0.0)


def modelled(totals: DataFrame) -> DataFrame:
    """``key`` and ``value``, the log10 probability of each n-gram's last byte."""
    alone, after = low_orders(totals)

    def work(table: pa.Table) -> pa.Table:
        keys, n = table["key"].to_numpy(), table["n"].to_numpy().astype(np.float64)
        return pa.table({"key": table["key"], "value": code_lengths(keys, n, alone, after)})

    return (
        totals.withColumn("pair", F.shiftright("key", 8) % 65536)
        .groupBy("pair")
        .applyInArrow(work, "key bigint, value double")
    )


class _Lookup:
    """Values by key; every key that is asked for must be there."""

    #: N-grams that are sorted at once: their place fits beside them in 63 bits.
    PLACE_BITS = 63 - 8 * (ORDER + 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def _sorted(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        if len(keys) and (at[-1] >= len(self.keys) or (self.keys[at] != keys).any()):
            raise ValueError("a chunk holds texts that were not counted under its name")
        return self.values[at]

    def of(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        out = np.empty(len(keys))
        out[order] = self._sorted(keys[order])
        return out

    def of_grams(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys))
        most = 1 << min(self.PLACE_BITS, 21)
        for i in range(0, len(keys), most):
            some = keys[i : i + most]
            both = np.sort((some << self.PLACE_BITS) | np.arange(len(some)))
            out[i + (both & ((1 << self.PLACE_BITS) - 1))] = self._sorted(both >> self.PLACE_BITS)
        return out


def scores(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: Column | None = None,
    chunks: int = 64,
) -> DataFrame:
    """Scores of all texts by a model of those where ``train`` holds.

    ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (log10 probability of
    the words and the end by add-half counts) and ``score`` (of the bytes, by PPM).
    """
    if chunk is None:
        chunk = F.pmod(F.xxhash64(docs[id_col]), F.lit(chunks)).cast("bigint")
    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
        chunk.alias("chunk"),
    )
    asked = cut(tallied(rows), "tallies")
    totals = cut(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")), "totals")
    known = totals.where(F.col("kind") == WORD_KIND)
    tokens_seen, kinds_seen = known.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))
    ).first()
    below = tokens_seen + 0.5 * (kinds_seen + 1)

    values = modelled(totals.where(F.col("kind") == GRAM)).select(
        F.lit(GRAM).alias("kind"), "key", "value"
    ).union(known.select("kind", "key", F.col("n").cast("double").alias("value")))
    answers = asked.select("chunk", "kind", "key").join(cut(values, "model"), ["kind", "key"])

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def work(own: pa.Table, model: pa.Table) -> pa.Table:
        kind, key = model["kind"].to_numpy(), model["key"].to_numpy()
        value = model["value"].to_numpy()
        grams_known, words_known = (
            _Lookup(key[kind == k], value[kind == k]) for k in (GRAM, WORD_KIND)
        )
        parts = []
        for batch in own.to_batches(max_chunksize=1024):
            all_texts = texts(batch)
            for part in blocks(all_texts, AT_ONCE):
                mine = all_texts[part]
                codes, many = grams(mine)
                score = np.add.reduceat(grams_known.of_grams(codes), np.cumsum(many) - many)
                found = tokens(mine, LOWERED)
                words, many = _with_ends(found.hashes, found.counts)
                n, edges = words_known.of(words), np.cumsum(many) - many
                parts.append(
                    pa.RecordBatch.from_arrays(
                        [
                            column(batch, "doc_id").slice(part.start, len(mine)),
                            pa.array(many),
                            pa.array(np.add.reduceat((n > 0).astype(np.int64), edges)),
                            pa.array(np.full(len(mine), tokens_seen, np.int64)),
                            pa.array(np.add.reduceat(np.log10((n + 0.5) / below), edges)),
                            pa.array(score),
                        ],
                        names,
                    )
                )
        empty = pa.schema([(n, pa.float64() if "score" in n else pa.int64()) for n in names])
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(parts, empty)

    schema = (
        "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint,"
        " base_score double, score double"
    )
    return (
        rows.select("chunk", "doc_id", "text")
        .groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(work, schema)
    )
