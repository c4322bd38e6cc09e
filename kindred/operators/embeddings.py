"""Text embeddings learnt on the corpus itself, by joins and sums alone.

Words that stand within ``WINDOW`` words of one another are counted together. What two words
share beyond chance is their positive association, ``max(0, ln(n(w,c) N / (n(w) n(c))))`` over
the pairs that were met ``MIN_COUNT`` times or more. A word's vector is the sum of its associations, each with the
signs of the other word: a projection of the whole association table to ``VECTOR_SIZE`` dimensions, with
signs that are bits of the other word's MD5. A text's vector is the mean of its words' vectors.

No table of words is held by the driver or by a task; the number of words has no limit. Associations are
rounded to thousandths and added up as whole numbers, so vectors are the same on any number of
cores and partitions.

Defined cases: a text without a known word has the zero vector; a null text counts as empty; rows that
repeat an id are one text of all their words; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.text import split_tokens
from kindred.session import cut

# The default training settings.
VECTOR_SIZE = 128
WINDOW = 5
MIN_COUNT = 2

#: Associations are rounded to this fraction.
UNITS = 1000
#: Texts that share the vectors of their words, and parts of the words of each such block.
BLOCK_TEXTS, SLICES = 8_192, 4
#: Rows of counts that are multiplied at a time.
CHUNK_ROWS = 16_384


def together(texts: DataFrame, text_col: str, window: int = WINDOW, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, other, n)``: how often two words stand within ``window`` words, in both directions."""
    tokens = texts.select(split_tokens(F.col(text_col)).alias("t"))

    def pairs_at(distance: int) -> Column:
        n = F.greatest(F.size("t") - distance, F.lit(0))
        return F.zip_with(
            F.slice("t", F.lit(1), n),
            F.slice("t", F.lit(1 + distance), n),
            lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")),
        )

    every = F.concat(*[pairs_at(d) for d in range(1, window + 1)])
    counted = (
        tokens.select(F.inline(every))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )
    # a word next to itself counts twice, once in each direction; all other pairs are two rows, so nothing is left to add up
    itself = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), (F.col("n") * 2).alias("n")))
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n")),
    )
    return counted.select(F.inline(F.when(F.col("a") == F.col("b"), itself).otherwise(both)))


def signs(words: list[str], vector_size: int = VECTOR_SIZE) -> np.ndarray:
    """1 or -1 for each word and dimension: the bits of the word's MD5, hexadecimal digit by digit
    and in each from the lowest."""
    digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in words), np.uint8)
    bits = np.unpackbits(digests, bitorder="little").reshape(-1, 16, 2, 4)[:, :, ::-1]
    return bits.reshape(-1, 128)[:, :vector_size].astype(np.int64) * 2 - 1


Values = Callable[[pa.RecordBatch], np.ndarray]


def _sums(keys: pa.Array, values: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct keys in order of first appearance, and the sums of their rows of ``values``."""
    coded = keys.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.diff(codes[order], prepend=-1))
    return coded.dictionary, np.add.reduceat(values[order], first, axis=0)


def _added_up(rows: DataFrame, key: str, values: Values, *, placed: bool = False) -> DataFrame:
    """``key`` and ``vector``, the sum of the rows' ``values``.

    Rows are moved as they are, before they have values, which are many times their size; rows that are ``placed``
    have all of a key in one partition already. They come sorted by
    key, so a task holds one batch and one sum, however many rows a key has.
    """
    schema = T.StructType(
        [T.StructField(key, rows.schema[key].dataType), T.StructField("vector", T.ArrayType(T.LongType()))]
    )

    def batch_of(keys: pa.Array, total: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array((np.arange(len(total) + 1) * total.shape[1]).astype(np.int32))
        vectors = pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))
        return pa.RecordBatch.from_arrays([keys, vectors], [key, "vector"])

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_of(*_sums(batch.column(batch.schema.get_field_index(key)), values(batch)))

    def wholly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_sum = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            own = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            keys, total = _sums(keys, own)
            if open_sum is not None:
                if keys[0] == open_key[0]:
                    total[0] += open_sum[0]
                else:
                    yield batch_of(open_key, open_sum)
            if len(keys) > 1:
                yield batch_of(keys[:-1], total[:-1])
            open_key, open_sum = keys[-1:], total[-1:]
        if open_sum is not None:
            yield batch_of(open_key, open_sum)

    by_key = (rows if placed else rows.repartition(key)).sortWithinPartitions(key)
    return by_key.mapInArrow(partly, schema).mapInArrow(wholly, schema)


def fit_embedding(
    texts: DataFrame,
    text_col: str,
    *,
    vector_size: int = VECTOR_SIZE,
    window: int = WINDOW,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """``(word, vector array<bigint>)`` of all words with an association, in thousandths; written out."""
    met = cut(together(texts, text_col, window, min_count), "together")
    total = met.agg(F.sum("n")).scalar()
    gain = F.log(F.col("n") * total.cast("double") / (F.col("own") * F.col("its").cast("double")))
    # every pair is there in both directions, so a word's count is the sum on either side; by word last, where rows stay
    weighed = (
        met.withColumn("its", F.sum("n").over(Window.partitionBy("other")))
        .withColumn("own", F.sum("n").over(Window.partitionBy("word")))
        .select("word", "other", F.floor(gain * UNITS + 0.5).cast("bigint").alias("gain"))
        .filter("gain > 0")
    )
    if not 1 <= vector_size <= 128:
        raise ValueError("vectors have from 1 to 128 dimensions")

    def signed(batch: pa.RecordBatch) -> np.ndarray:
        other = batch.column(1).dictionary_encode()
        each = signs(other.dictionary.to_pylist(), vector_size)
        return each[other.indices.to_numpy()] * batch.column(2).to_numpy()[:, None]

    return cut(_added_up(weighed, "word", signed, placed=True), "word-vectors")


def embed(words: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, embedding array<double>)``: the mean of the known words' vectors of a text."""
    ids = texts.select(F.col(id_col).alias("item_id"), split_tokens(F.col(text_col)).alias("t"))
    blocks = max(1, math.ceil(texts.count() / BLOCK_TEXTS))
    # rows without an id find no mean in the end
    counted = cut(
        ids.filter(F.col("item_id").isNotNull())
        .select("item_id", F.explode("t").alias("word"))
        .groupBy("item_id", "word")
        .count()
        .withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
        .withColumn("_slice", F.pmod(F.xxhash64("word"), F.lit(SLICES))),
        "word-counts",
    )
    first = words.first()
    size = len(first["vector"]) if first else 0
    # a word's vector goes once to a block of texts, not to each of them
    wanted = counted.select(F.col("_block").alias("_of"), F.col("_slice").alias("_at"), "word").distinct()
    known = wanted.join(words, "word").select("_of", "_at", F.col("word").alias("known"), "vector")

    def multiplied(own: pa.Table, vectors: pa.Table) -> pa.Table:
        place = pc.index_in(own["word"].combine_chunks(), value_set=vectors["known"].combine_chunks())
        own = own.select(["item_id", "count"]).append_column("place", place).filter(place.is_valid()).sort_by("item_id")
        table = pc.list_flatten(vectors["vector"]).to_numpy().reshape(vectors.num_rows, -1)
        coded = own["item_id"].combine_chunks().dictionary_encode()
        codes, place, count = coded.indices.to_numpy(), own["place"].to_numpy(), own["count"].to_numpy()
        total = np.zeros((len(coded.dictionary), size + 1), np.int64)
        for begin in range(0, len(codes), CHUNK_ROWS):
            at = slice(begin, begin + CHUNK_ROWS)
            starts = np.flatnonzero(np.diff(codes[at], prepend=-1))
            each = np.hstack([table[place[at]] * count[at, None], count[at, None]])
            total[codes[at][starts]] += np.add.reduceat(each, starts, axis=0)
        offsets = pa.array((np.arange(len(total) + 1) * (size + 1)).astype(np.int32))
        sums = pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))
        return pa.table({"item_id": coded.dictionary, "vector": sums})

    schema = T.StructType([counted.schema["item_id"], T.StructField("vector", T.ArrayType(T.LongType()))])
    parts = counted.groupBy("_block", "_slice").cogroup(known.groupBy("_of", "_at")).applyInArrow(multiplied, schema)

    def summed(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)

    # the last entry is the number of words
    total = _added_up(parts, "item_id", summed)
    means = total.select(
        "item_id",
        F.transform(
            F.slice("vector", 1, max(1, size)), lambda x: x / (F.element_at("vector", -1) * float(UNITS))
        ).alias("embedding"),
    )
    nothing = F.array_repeat(F.lit(0.0), size or VECTOR_SIZE)
    return (
        ids.select("item_id")
        .distinct()
        .join(means, "item_id", "left")
        .select("item_id", F.coalesce("embedding", nothing).alias("embedding"))
    )
