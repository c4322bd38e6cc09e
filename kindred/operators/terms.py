"""Term counts, vocabulary and TF-IDF vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.text import first_and_last_term, term_tokens, unigrams_and_bigrams
from kindred.operators.corpus import CHUNK, chunk_of
from kindred.session import cut

# Vocabulary sizes of the three presets, and the shared lower bound.
FULL_CORPUS_FEATURES = 50_000
DESCRIPTION_FEATURES = 40_000
SEARCH_FEATURES = 10_000
MIN_DOCUMENTS = 2

# A vocabulary of up to this many terms (some tens of megabytes) is broadcast.
BROADCAST_TERMS = 500_000

#: Into how many parts the texts of one part of the input are dealt.
PARTS = 8

#: Words that are counted at a time, or those of one item.
COUNT_WORDS = 500_000


def spread_by_item(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, text)`` with whole texts spread by item.

    A text is much smaller than the term rows made from it. Moved before it is split,
    it keeps all cores busy whatever the file layout, and counting and weighing per
    item then need no further shuffle. Python functions (NFC) belong before this
    step, as Spark forgets the partitioning behind them.

    The number of parts follows the input and is fixed: left to itself, Spark would put small texts
    together until a part has many times its size in terms.
    """
    rows = texts.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, PARTS * rows.rdd.getNumPartitions()), "item_id")


def _terms(tokens: DataFrame) -> DataFrame:
    """``(item_id, term)`` rows from ``(item_id, _tokens)``."""
    return tokens.select(
        "item_id", F.explode(unigrams_and_bigrams(F.col("_tokens"))).alias("term")
    )


def term_counts(texts: DataFrame) -> DataFrame:
    """``(item_id, term, tf)`` of words and word pairs, from one text per item.

    Best on the output of :func:`spread_by_item`, where it needs no shuffle. Terms are sorted and
    counted inside the row of an item (the texts of a repeated id are one row), so a task holds the terms of one
    item at a time.
    """
    own = texts.groupBy("item_id").agg(F.collect_list("text").alias("_texts"))
    tokens = F.transform("_texts", term_tokens)
    ordered = own.select("item_id", tokens.alias("_tokens")).select(
        "item_id", F.array_sort(F.flatten(F.transform("_tokens", unigrams_and_bigrams))).alias("_terms")
    )
    # where runs of equal terms begin; each lasts until the next
    begins = F.filter(
        F.sequence(F.lit(1), F.size("_terms")),
        lambda i: (i == 1) | (F.get("_terms", i - 1) != F.get("_terms", i - 2)),
    )
    runs = ordered.filter(F.size("_terms") > 0).select("item_id", "_terms", begins.alias("_begins"))
    ends = F.concat(F.slice("_begins", F.lit(2), F.size("_begins")), F.array(F.size("_terms") + 1))
    counted = F.zip_with(
        "_begins",
        ends,
        lambda begin, end: F.struct(
            F.get("_terms", begin - 1).alias("term"), (end - begin).cast("bigint").alias("tf")
        ),
    )
    return runs.select("item_id", F.inline(counted))


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``(item_id, term, tf)`` of rows ``(item_id, lists of words)``; pairs are of neighbours in a list."""
    ids, texts = batch.columns
    inner = texts.flatten()
    words = inner.flatten().dictionary_encode()
    code, n = words.indices.to_numpy().astype(np.int64), len(words.dictionary) + 1
    text = np.repeat(np.arange(len(inner)), pc.list_value_length(inner).to_numpy())
    item = np.repeat(np.arange(len(ids)), pc.list_value_length(texts).to_numpy())[text]
    # item, word and next word in one number; n - 1 stands for no next word
    alone = (item * n + code) * n
    pairs = (alone[:-1] + code[1:])[text[1:] == text[:-1]]
    keys, tf = np.unique(np.concatenate([alone + n - 1, pairs]), return_counts=True)
    both, second = np.divmod(keys, n)
    owner, first = np.divmod(both, n)
    paired = second < n - 1

    def rows(at: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(owner[at])), terms, pa.array(tf[at].astype(np.int64))], ["item_id", "term", "tf"]
        )

    def named(codes: np.ndarray) -> pa.Array:
        return words.dictionary.take(pa.array(codes))

    yield rows(~paired, named(first[~paired]))
    yield rows(paired, pc.binary_join_element_wise(named(first[paired]), named(second[paired]), " "))


def loose_counts(texts: DataFrame) -> DataFrame:
    """The rows of :func:`term_counts` at a fraction of its cost, for uses that are not per item.

    Words are found by Spark, and counted as numbers inside tasks, ``COUNT_WORDS`` at a time. Spark forgets by that how rows
    are spread, so what goes on per item would move all terms again.
    """
    own = texts.groupBy("item_id").agg(F.collect_list("text").alias("_texts"))
    tokens = own.select("item_id", F.transform("_texts", term_tokens).alias("_tokens"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            texts_until = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
            words_until = np.append(0, np.cumsum(pc.list_value_length(lists.flatten()).to_numpy()))[texts_until]
            begin = 0
            while begin < batch.num_rows:
                end = int(np.searchsorted(words_until, words_until[begin] + COUNT_WORDS, "right")) - 1
                end = max(end, begin + 1)
                yield from _counted(batch.slice(begin, end - begin))
                begin = end

    schema = T.StructType(
        [texts.schema["item_id"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]
    )
    return tokens.mapInArrow(work, schema)


def known_counts(texts: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """The rows of :func:`term_counts` whose term is in ``known(term)``, at most ``most`` terms; others are never counted."""
    terms = _terms(texts.select("item_id", term_tokens(F.col("text")).alias("_tokens")))
    wanted = known.select("term")
    if most <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    return terms.join(wanted, "term").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def segment_counts(
    segments: DataFrame, id_col: str, *, chunk: int = CHUNK
) -> DataFrame:
    """``(item_id, term, tf)`` of the corpus an item has in pieces ``(id, ord, text)``.

    Equal to counting the pieces joined in order with a space, but the joined text is
    never built, so an item may have any number of pieces. Word pairs across the seam
    of two pieces are found from the first and last word of each piece: inside a run
    of neighbouring pieces, and then between runs.
    """
    pieces = segments.select(F.col(id_col).alias("item_id"), "ord", "text")
    inside = _terms(pieces.select("item_id", term_tokens(F.col("text")).alias("_tokens")))
    # read twice below, so only the edge words are looked for
    first, last = first_and_last_term(F.col("text"))
    edges = pieces.select(
        "item_id",
        "ord",
        chunk_of(F.col("ord"), chunk).alias("_chunk"),
        first.alias("_first"),
        last.alias("_last"),
    ).filter(F.col("_first") != "")
    in_run = Window.partitionBy("item_id", "_chunk").orderBy("ord")
    between_runs = Window.partitionBy("item_id").orderBy("_chunk")
    runs = edges.groupBy("item_id", "_chunk").agg(
        F.min_by("_first", "ord").alias("_first"), F.max_by("_last", "ord").alias("_last")
    )

    def seams(rows: DataFrame, window) -> DataFrame:
        return (
            rows.withColumn("_next", F.lead("_first").over(window))
            .filter(F.col("_next").isNotNull())
            .select("item_id", F.concat_ws(" ", "_last", "_next").alias("term"))
        )

    return (
        inside.unionByName(seams(edges, in_run))
        .unionByName(seams(runs, between_runs))
        .groupBy("item_id", "term")
        .agg(F.count("*").alias("tf"))
    )


def vocabulary(
    counts: DataFrame, max_features: int, min_df: int = MIN_DOCUMENTS
) -> DataFrame:
    """``(term, df, ctf)``: the terms in at least ``min_df`` items, the most frequent
    ``max_features`` of them by corpus count, ties by term.

    The corpus count at the cut is found first, from how many terms have each count.
    Only terms at or above it are sorted, instead of the best ``max_features`` of every
    task. Both steps read the same written table, so terms are counted once.
    """
    stats = cut(
        counts.groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
        .filter(F.col("df") >= min_df),
        "term-stats",
    )
    # one row per distinct count, far fewer than terms
    reached = F.sum("n").over(
        Window.orderBy(F.desc("ctf")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    lowest = (
        stats.groupBy("ctf")
        .agg(F.count("*").alias("n"))
        .select("ctf", reached.alias("reached"))
        .filter(F.col("reached") >= max_features)
        .agg(F.max("ctf"))
        .scalar()
    )
    return (
        stats.filter(F.col("ctf") >= F.coalesce(lowest, F.lit(0)))
        .orderBy(F.desc("ctf"), F.asc("term"))
        .limit(max_features)
    )


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary: ``terms(term, idx, df, ctf, idf)``."""

    terms: DataFrame
    max_features: int

    def weigh(self, counts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """``(item_id, idx array<int>, weight array<double>)``, length one per item.

        With ``ids(item_id)`` an item without any known term has empty arrays;
        otherwise it is absent. A vector has at most ``max_features`` entries.
        """
        known = self.terms.select("term", "idx", "idf")
        if self.max_features <= BROADCAST_TERMS:
            known = F.broadcast(known)
        entries = (
            counts.join(known, "term")
            .select("item_id", "idx", (F.col("tf") * F.col("idf")).alias("x"))
            .groupBy("item_id")
            .agg(
                F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("e"),
                F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"),
            )
        )
        vectors = entries.select(
            "item_id",
            F.col("e.idx").alias("idx"),
            F.transform(F.col("e.x"), lambda x: x / F.col("norm")).alias("weight"),
        )
        if ids is None:
            return vectors
        return (
            ids.select("item_id")
            .join(vectors, "item_id", "left")
            .select(
                "item_id",
                F.coalesce("idx", F.array().cast("array<int>")).alias("idx"),
                F.coalesce("weight", F.array().cast("array<double>")).alias("weight"),
            )
        )

    def postings(self, vectors: DataFrame) -> DataFrame:
        """``(item_id, term, weight)`` rows of vectors."""
        known = self.terms.select("term", "idx")
        if self.max_features <= BROADCAST_TERMS:
            known = F.broadcast(known)
        return (
            vectors.select(
                "item_id", F.inline(F.arrays_zip("idx", "weight")).alias("idx", "weight")
            )
            .join(known, "idx")
            .select("item_id", "term", "weight")
        )


def fit_tfidf(
    counts: DataFrame,
    items: DataFrame,
    max_features: int,
    min_df: int = MIN_DOCUMENTS,
) -> TfidfModel:
    """Fit on term counts; ``items`` has one row per item, with or without terms.

    The weight of a term is ``ln((1 + n) / (1 + df)) + 1`` for n items. The fitted
    table has at most ``max_features`` rows and is written out once, as every later
    use reads it.
    """
    n_items = items.agg(F.count(F.lit(1))).scalar()
    # at most max_features rows reach this unpartitioned window
    position = F.row_number().over(Window.orderBy(F.desc("ctf"), F.asc("term")))
    terms = vocabulary(counts, max_features, min_df).select(
        "term",
        (position - 1).alias("idx"),
        "df",
        "ctf",
        (F.log((1.0 + n_items) / (1.0 + F.col("df"))) + 1.0).alias("idf"),
    )
    return TfidfModel(cut(terms), max_features)
