"""What keeps time and memory of large inputs in bounds, against the plain way."""

import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions.text import first_and_last_term, term_tokens
from kindred.operators import recommendations, topk
from kindred.operators.dictionaries import _replaced_slices, replace_symbols
from kindred.operators.relevance import evaluation_candidates, users_of_few_items


@pytest.mark.parametrize("floor", ["none", "some", "all"])
def test_pairs_chosen_in_single_precision_are_those_of_exact_scores(floor):
    rng = np.random.default_rng(5)
    items = topk.unit_rows(rng.normal(size=(300, 16)))
    items[7] = 0.0
    items[20:60] = items[20]  # ties
    items[61] = items[20] * (1 + 1e-9)
    seeds = np.concatenate([items[:90], topk.unit_rows(rng.normal(size=(40, 16)))])
    scores = topk._rounded(seeds @ items.T)
    tenth = np.partition(scores, -10, axis=1)[:, -10]
    floors = {
        "none": np.full(len(seeds), -np.inf),
        "some": np.where(np.arange(len(seeds)) % 2 == 0, tenth, -np.inf),
        "all": tenth,
    }[floor]
    row, column = topk._best(scores, floors, 11)
    found = topk._best_dense(topk.Single.of(seeds), topk.Single.of(items), floors, 11)
    order = np.lexsort((found[1], found[0]))
    assert np.array_equal(found[0][order], row)
    assert np.array_equal(found[1][order], column)
    assert np.array_equal(found[2][order], scores[row, column])


def test_values_beyond_single_precision_are_left_to_exact_products():
    assert topk.Single.of(np.array([[1e200, 0.0]])) is None
    assert topk.Single.of(np.array([[np.nan, 0.0]])) is None


def test_edge_words_are_the_outermost_terms(spark):
    texts = [
        "", " ", "a b c", "one", "x one y", "one two", "Ünï größer, ΟΔΟΣ.", "a_b  c1 ", "\U00010400\U00010401 z zz",
        "ét́ cafés", "東京 大阪 x", None, "1 22 333 4", "İstanbul İ",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    first, last = first_and_last_term(F.col("text"))
    tokens = term_tokens(F.col("text"))
    rows = df.select(tokens.alias("t"), first.alias("a"), last.alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [
        (None, None) if r["t"] is None else (r["t"][0], r["t"][-1]) if r["t"] else ("", "") for r in rows
    ]


def test_texts_of_a_batch_are_not_python_strings_all_at_once():
    texts = pa.array([None if i % 7 == 0 else f"te一xt {i} " * (i % 50) for i in range(400)])
    alive, most = weakref.WeakSet(), 0

    class Text(str):
        """A string that can be counted."""

    def replace(text):
        nonlocal most
        new = Text(text.replace("x", " <x> "))
        alive.add(new)
        most = max(most, len(alive))
        return new

    slices = _replaced_slices(texts, replace, characters=1_000)
    assert pa.concat_arrays(slices).to_pylist() == [
        None if t is None else t.replace("x", " <x> ") for t in texts.to_pylist()
    ]
    assert most < 100


def test_symbols_in_texts_of_many_rows(spark):
    texts = [None if i % 11 == 0 else f"b{i} ab一 a" * (i % 5) for i in range(3_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    symbols = spark.createDataFrame([("a", "b", 0), ("b", "<c>", 1)], "key string, value string, line_no int")
    found = [r["text"] for r in replace_symbols(df, "text", symbols).orderBy("id").collect()]
    assert found == [t and t.replace("a", " b ").replace("b", " <c> ") for t in texts]


@pytest.mark.parametrize("least", [1, 2, 4])
def test_only_users_of_few_items_are_told_apart(spark, least):
    bought = {1: [1], 2: [1, 2], 3: [3, 4, 5], 4: [2, 6], 5: [7, 8], 6: list(range(20, 30)), 7: [9, 10, 11, 12]}
    pairs = spark.createDataFrame([(u, i) for u, own in bought.items() for i in own], "user_key int, item_id int")
    rare = {r["user_key"]: r["n_items"] for r in users_of_few_items(pairs, least).collect()}
    assert rare == {u: len(own) for u, own in bought.items() if len(own) <= least}
    partners = {i: {j for own in bought.values() if i in own for j in own if j != i} for i in range(1, 30)}
    items = spark.createDataFrame([(i,) for i in range(1, 25)], "item_id int")
    found = sorted(r["item_id"] for r in evaluation_candidates(pairs, items, least).collect())
    assert found == [i for i in range(1, 25) if len(partners[i]) >= least]


def test_names_of_many_items_are_cut_into_tiles(spark, tmp_path):
    recs = spark.createDataFrame(
        [(f"u{i}", "x") for i in range(4_500)] + [("u1", "x"), (None, "x"), ("u2", "y"), ("u3", None), ("u4", "gone")],
        "UserName string, RecommendedHotel string",
    )
    items = spark.createDataFrame(
        [(i, "x", i % 7) for i in range(5_000)] + [(-1, "y", 1), (-1, "y", 1), (-2, None, 1), (-3, "z", 1)],
        "item_id long, item_name string, stars int",
    )
    found = recommendations.recommended_items(recs, items)
    assert found.columns == [*recs.columns, *items.columns]
    path = str(tmp_path / "found")
    found.withColumn("part", F.spark_partition_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    plain = recs.join(items, recs["RecommendedHotel"] == items["item_name"])
    sums = [F.count("*"), F.sum(F.pmod(F.xxhash64(*found.columns), F.lit(1 << 31)))]
    assert kept.agg(*sums).first() == plain.agg(*sums).first()
    # one name fills several tasks, and takes a small part of a byte a row
    assert kept.where("item_name = 'x'").select("part").distinct().count() > 1
    size = sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet"))
    assert size < kept.count() / 4


def test_no_name_in_common_gives_no_rows(spark):
    recs = spark.createDataFrame([("a", "x")], "UserName string, RecommendedHotel string")
    items = spark.createDataFrame([(1, "y")], "item_id int, item_name string")
    assert recommendations.recommended_items(recs, items).count() == 0
