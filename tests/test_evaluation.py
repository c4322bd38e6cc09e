import random
from collections import Counter

import pytest

from kindred.operators import relevance
from kindred.operators.ranking import evaluate, summarize, union_methods
from kindred.operators.relevance import (
    busy_users,
    distinct_pairs,
    evaluation_candidates,
    jaccard_relevance,
    partners,
    sample_seeds,
)
from kindred.plans.content import (
    NothingToEvaluateError,
    evaluate_content,
    index_texts,
    judge_by_users,
    store_evaluation,
)
from kindred.session import cut
from kindred.sources.tables import read_csv


def visits():
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(40)}", rng.randrange(25)) for _ in range(200)]
    # one user holds a third of all rows, some items are seen by one user only
    rows += [("busy", i) for i in range(25)] * 4
    rows += [("solo", 50), ("pair", 51), ("pair", 52), ("twice", 52), ("twice", 53), (None, 1), ("x", None)]
    return rows


def visits_df(spark):
    return spark.createDataFrame(visits(), "user_key string, item_id int")


# Users of items: 1 and 2 have a and b, 3 has a and c, 4 has c, 5 has d.
FEW = [
    ("a", 1), ("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("c", 3), ("c", 4), ("d", 5),
    (None, 5), ("d", None),
]


def few_df(spark):
    return spark.createDataFrame(FEW, "user_key string, item_id int")


@pytest.mark.parametrize(
    ("topn", "expected"),
    [
        (1, [(1, 2, 1.0), (3, 4, 0.5), (4, 3, 0.5)]),
        (1000, [(1, 2, 1.0), (1, 3, 1 / 3), (3, 4, 0.5), (3, 1, 1 / 3), (3, 2, 1 / 3), (4, 3, 0.5)]),
    ],
)
def test_relevance(spark, topn, expected):
    seeds = spark.createDataFrame([(s,) for s in (1, 3, 4, 5, 99)], "seed_id int")
    found = jaccard_relevance(distinct_pairs(few_df(spark)), seeds, topn)
    rows = found.orderBy("seed_id", "rank").select("seed_id", "item_id", "gain").collect()
    assert [tuple(r) for r in rows] == expected


def test_relevance_is_symmetric(spark):
    pairs = distinct_pairs(visits_df(spark))
    seeds = pairs.selectExpr("item_id AS seed_id").distinct()
    gain = {(r["seed_id"], r["item_id"]): r["gain"] for r in jaccard_relevance(pairs, seeds).collect()}
    assert gain and all(gain[b, a] == g and 0 < g <= 1 for (a, b), g in gain.items())


@pytest.mark.parametrize(
    ("least", "expected"), [(1, [1, 2, 3, 4]), (2, [1, 2, 3]), (3, [3]), (30, [])]
)
def test_candidates(spark, least, expected):
    items = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 77)], "item_id int")
    got = evaluation_candidates(distinct_pairs(few_df(spark)), items, least)
    assert sorted(r["item_id"] for r in got.collect()) == expected


def test_no_candidate_is_an_error(spark):
    items = spark.createDataFrame([(77,)], "item_id int")
    with pytest.raises(NothingToEvaluateError):
        judge_by_users(few_df(spark), items, 300)


def test_no_method_gives_no_row(spark):
    assert union_methods([None]).count() == 0 and union_methods([]).columns[0] == "method"


def test_sample(spark):
    items = spark.range(1000).selectExpr("id AS item_id")
    first = {r["seed_id"] for r in sample_seeds(items, 300).collect()}
    again = {r["seed_id"] for r in sample_seeds(items.repartition(9), 300).collect()}
    other = {r["seed_id"] for r in sample_seeds(items, 300, seed=1).collect()}
    assert len(first) == 300 and first == again and first != other
    # spread over the ids, not the lowest ones
    assert 400 < sum(first) / 300 < 600
    assert sample_seeds(items.limit(5), 300).count() == 5
    named = items.selectExpr("concat('h', item_id) AS item_id")
    assert sample_seeds(named, 10).count() == 10


def test_metrics(spark):
    """Seed 1 has hits at ranks 1 and 3 of three relevant items; 2 has no hit, 3 nothing
    relevant, 4 no recommendation."""
    recs = [("a", s, i, n) for s in (1, 2, 3) for n, i in enumerate((10, 20, 30, 40, 50), 1)]
    rel = [(1, 10, 1.0, 1), (1, 30, 0.5, 2), (1, 99, 0.25, 3), (2, 98, 1.0, 1), (4, 10, 1.0, 1)]
    df = evaluate(
        spark.createDataFrame(recs, "method string, seed_id int, item_id int, rank bigint"),
        spark.createDataFrame(rel, "seed_id int, item_id int, gain double, rank bigint"),
        spark.createDataFrame([("a", s) for s in (1, 2, 3, 4)], "method string, seed_id int"),
    )
    metrics = ("precision", "map", "ndcg_bin", "ndcg_grd", "n_rel")
    got = {(r["seed_id"], r["k"]): tuple(r[m] for m in metrics) for r in df.collect()}
    assert len(got) == 4 * 3
    # (1 + 2/3) / 3; 1.5 / (1 + 0.63093 + 0.5); gains 2**g - 1 are 1, 0.41421 and 0.18921
    for k in (5, 10, 20):
        assert got[1, k] == pytest.approx((2 / k, 0.555556, 0.703918, 0.890234, 3), abs=1e-5)
        assert [got[s, k] for s in (2, 3, 4)] == [(0, 0, 0, 0, n) for n in (1, 0, 1)]
    means = summarize(df).collect()
    assert [(r["k"], r["method"], r["label"]) for r in means] == [(k, "a", f"a_{k}") for k in (5, 10, 20)]
    assert means[0]["precision"] == pytest.approx(0.1)


def test_whole_evaluation(spark):
    items = spark.createDataFrame([(i,) for i in range(25)], "item_id int")
    texts = items.selectExpr("item_id", "concat('room number', ' kind', item_id % 4) AS text")
    vectors = items.filter("item_id < 10").selectExpr(
        "item_id", "array(1.0D, CAST(item_id AS DOUBLE)) AS embedding"
    )
    judgement = judge_by_users(visits_df(spark), items, 300)
    per_seed = evaluate_content(
        judgement, index=index_texts(texts, "item_id", "text"), vectors={"stored": vectors}
    )
    counts = {(r["method"], r["k"]): r["count"] for r in per_seed.groupBy("method", "k").count().collect()}
    assert counts == {(m, k): n for m, n in (("tfidf", 25), ("stored", 10)) for k in (5, 10, 20)}
    # everybody shares the busy user, so every recommended item is relevant
    assert per_seed.filter("method = 'tfidf' AND precision < 1").isEmpty()


def busy_visits(spark):
    """One user holds a third of all rows, the others a few each."""
    few = spark.range(2400).selectExpr("concat('u', id % 300) AS user_key", "CAST(id * 7 % 1200 AS INT) AS item_id")
    return few.union(spark.range(1200).selectExpr("'busy'", "CAST(id AS INT)")).distinct()


def test_slices_of_a_busy_user_give_the_same_relevance(spark):
    pairs = cut(busy_visits(spark))
    seeds = spark.range(5).selectExpr("CAST(id * 11 AS INT) AS seed_id")
    whole = {tuple(r) for r in jaccard_relevance(pairs, seeds, 50).collect()}
    assert whole == {tuple(r) for r in jaccard_relevance(pairs, seeds, 50, slice_rows=100).collect()}
    assert len(whole) == 250


def test_no_key_of_the_join_is_wider_than_a_slice(spark, monkeypatch):
    pairs = busy_visits(spark)
    assert [tuple(r) for r in busy_users(pairs, 100).collect()] == [("busy", 12)]
    assert busy_users(pairs, 1200).isEmpty() and busy_users(pairs.limit(0), 100).isEmpty()
    slices = pairs.filter("user_key = 'busy'").selectExpr("pmod(xxhash64(item_id), 12) AS s")
    assert max(r["count"] for r in slices.groupBy("s").count().collect()) < 150
    # however small the slices, the users above them stay few enough to broadcast
    monkeypatch.setattr(relevance, "MOST_BUSY", 4)
    assert busy_users(pairs, 1).count() < 4


def test_partners_of_a_busy_user_are_dealt_out(spark):
    pairs = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 1), ("b", 2)], "user_key string, item_id int")
    seed_pairs = spark.createDataFrame([(1, "a"), (1, "b"), (7, "a")], "seed_id int, user_key string")
    got = Counter(tuple(r) for r in partners(pairs, seed_pairs, busy_users(pairs, 8)).collect())
    assert got == Counter([(1, 2)]) + Counter((s, i) for s in (1, 7) for i in range(40) if i != s)


def test_evaluation_files_of_runs_stand_side_by_side(spark, tmp_path):
    rows = [("m", 5, 1, 0.5, 0.25, 0.0, 1.0, 3), ("m", 5, 2, 0.0, 0.75, 1.0, 0.0, 1)]
    names = "method string, k bigint, seed_id int, precision double, map double, ndcg_bin double, ndcg_grd double, n_rel bigint"
    per_seed = spark.createDataFrame(rows, names)
    first = store_evaluation(per_seed, str(tmp_path), "one")
    store_evaluation(per_seed.limit(0), str(tmp_path), "two")
    detail, means = (read_csv(spark, path, multi_line=False).collect() for path in first)
    assert sorted(tuple(r) for r in detail) == rows
    assert [(r["label"], r["precision"], r["map"], r["ndcg_bin"], r["ndcg_grd"]) for r in means] == [("m_5", 0.25, 0.5, 0.5, 0.5)]
    assert len(list(tmp_path.iterdir())) == 4
