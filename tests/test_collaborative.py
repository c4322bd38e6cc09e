import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import kindred.operators.collaborative as collaborative
from kindred.operators.collaborative import (
    best_trial,
    explode_recommendations,
    fit_als,
    grid_search,
    optimality,
    param_grid,
    predict,
    recommend_for,
    recommend_for_all,
    rmse,
)
from kindred.operators.embeddings import embed, fit_embedding, together
from kindred.operators.recommendations import (
    name_items,
    recommended_for_user,
    recommended_items,
    user_list,
)
from kindred.plans.ratings import prepare_ratings, recommend_everyone, store_search
from kindred.sources.stores import load_als, save_als
from kindred.sources.tables import read_csv


@pytest.fixture(scope="module")
def feedback(spark):
    """Users like the items of their own parity."""
    return spark.range(40).crossJoin(spark.range(12).withColumnRenamed("id", "item")).filter(
        "(id * 7 + item) % 3 > 0"
    ).selectExpr(
        "concat('name', id) AS user",
        "item",
        "CASE WHEN id % 2 = item % 2 THEN '9,0' ELSE '2.0/10' END AS score",
        "id * 100 + item AS row_id",
    )


@pytest.fixture(scope="module")
def data(feedback):
    return prepare_ratings(feedback, "user", "item", "score", "row_id")


def test_split_and_codes(data):
    n_train, n_test = data.train.count(), data.test.count()
    assert n_train + n_test == 320 and 30 < n_test < 110
    codes = {r["user_key"]: r["code"] for r in data.user_codes.collect()}
    assert codes == {f"name{i}": i for i in range(40)} and data.item_codes is None


def test_fit_predict_save_load(spark, data, tmp_path):
    model = fit_als(data.train, rank=4, reg_param=0.05, max_iter=10)
    scored = predict(model, data.test)
    error = scored.agg(rmse(F.col("rating"), F.col("prediction"))).first()[0]
    assert error < 1.5
    assert model.userFactors.filter(F.exists("features", lambda x: x < 0)).isEmpty()
    save_als(model, str(tmp_path / "m"))
    again = predict(load_als(str(tmp_path / "m")), data.test)
    assert again.exceptAll(scored).isEmpty()
    unknown = spark.createDataFrame([(999, 1, 5.0)], "userId int, itemId int, rating double")
    assert predict(model, unknown).isEmpty()
    users = spark.createDataFrame([(0,), (999,)], "userId int")
    top = recommend_for(model, users, 3).orderBy("rank").collect()
    assert [(r["userId"], r["rank"]) for r in top] == [(0, 1), (0, 2), (0, 3)]
    assert top[0]["score"] >= top[1]["score"] >= top[2]["score"]
    assert all(r["itemId"] % 2 == 0 for r in top)


def test_lists_equal_those_of_the_library(spark, data):
    model = fit_als(data.train, rank=4, reg_param=0.05, max_iter=10)
    library = explode_recommendations(model.recommendForAllUsers(5))
    expected = {(r.userId, r["rank"]): (r.itemId, r.score) for r in library.collect()}
    got = {(r.userId, r["rank"]): (r.itemId, r.score) for r in recommend_for_all(model, 5).collect()}
    assert got.keys() == expected.keys() and len(got) == 200
    for key, (item, score) in got.items():
        assert score == pytest.approx(expected[key][1], abs=1e-4)
        assert item == expected[key][0] or score == pytest.approx(expected[key][1], abs=2e-6)


def test_optimality(spark, data):
    model = fit_als(data.train, rank=4, reg_param=0.05, max_iter=10)
    rows = optimality(model, data.train, 0.05).collect()
    assert len(rows) == data.train.select("userId").distinct().count()
    assert sum(r.ratings for r in rows) == data.train.count()
    assert max(r.violation for r in rows) < 0.01
    # another ridge is not what was solved
    assert max(r.violation for r in optimality(model, data.train, 5.0).collect()) > 0.05


def test_grid(spark):
    rows = [tuple(r) for r in param_grid(spark).orderBy("trial").collect()]
    expected = [(r, g, i) for r in (10, 20, 40) for g in (0.01, 0.05, 0.1) for i in (10, 15)]
    assert rows == [(n, *e) for n, e in enumerate(expected, 1)]


def test_best_trial_is_the_first_of_equals(spark):
    trials = spark.createDataFrame([(3, 0.5), (2, 0.5), (1, 0.7)], "trial int, rmse double")
    assert best_trial(trials).first()["trial"] == 2


def test_search_and_recommend_to_everyone(spark, data):
    trials = grid_search(data.train, data.test, param_grid(spark, [2, 4], [0.05], [5]))
    rows = trials.orderBy("trial").collect()
    assert [r["trial"] for r in rows] == [1, 2] and all(r["rmse"] > 0 for r in rows)
    items = spark.range(12).selectExpr("id AS item_id", "concat('Hotel ', id) AS item_name")
    named = recommend_everyone(data, trials, items, n=2)
    assert named.columns == ["UserName", "RecommendedHotel", "rank"]
    assert named.count() == 80
    first = recommended_for_user(named, items, "name3")
    assert {int(r["RecommendedHotel"].split()[1]) % 2 for r in first.collect()} == {1}
    assert user_list(named, "UserName").first()[0] == "name0"


def test_best_model_and_trials_are_kept(spark, data, tmp_path):
    rows = [(1, 2, 0.05, 5, 0.9), (2, 4, 0.05, 5, 0.1), (3, 4, 0.5, 5, 0.1)]
    trials = spark.createDataFrame(rows, "trial int, rank int, regParam double, maxIter int, rmse double")
    kept = store_search(data, trials, str(tmp_path), "run")
    back = read_csv(spark, kept.trials_path, multi_line=False)
    assert sorted(tuple(r) for r in back.collect()) == rows
    model = load_als(kept.model_path)
    assert model.rank == kept.model.rank == 4
    items = spark.range(12).selectExpr("id AS item_id", "concat('Hotel ', id) AS item_name")
    stored = recommend_everyone(data, trials, items, n=2, model=model)
    assert sorted(stored.collect()) == sorted(recommend_everyone(data, trials, items, n=2).collect())


def test_names_fan_out_and_unknown_ids_stay(spark):
    items = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "item_id int, item_name string")
    recs = spark.createDataFrame(
        [("a", "x"), ("a", "gone"), ("b", "y")], "UserName string, RecommendedHotel string"
    )
    users = spark.createDataFrame([("a",)], "UserName string")
    assert recommended_items(recs, items, users).count() == 2
    assert recommended_items(recs, items).count() == 3
    coded = spark.createDataFrame([(0, 1), (0, 9)], "userId int, itemId int")
    assert {r["itemId"]: r["item_name"] for r in name_items(coded, items).collect()} == {1: "x", 9: None}


def by_hand_embedding(texts, size, window, min_count):
    met = Counter()
    for t in texts.values():
        words = (t or "").split()
        for i, a in enumerate(words):
            for b in words[i + 1 : i + 1 + window]:
                met[min(a, b), max(a, b)] += 1
    both = Counter()
    for (a, b), n in met.items():
        if n >= min_count:
            both[a, b] += n
            both[b, a] += n
    own, total = Counter(), sum(both.values())
    for (a, _), n in both.items():
        own[a] += n
    vectors = {w: [0] * size for w in own}
    for (a, b), n in both.items():
        gain = math.floor(math.log(n * total / (own[a] * own[b])) * 1000 + 0.5)
        digest = hashlib.md5(b.encode()).hexdigest()
        if gain > 0:
            for d in range(size):
                vectors[a][d] += gain * (1 if int(digest[d // 4], 16) >> (d % 4) & 1 else -1)
    out = {}
    for i, t in texts.items():
        known = [vectors[w] for w in (t or "").split() if w in vectors and any(vectors[w])]
        out[i] = [sum(v[d] for v in known) / (len(known) * 1000) if known else 0.0 for d in range(size)]
    return out


def test_embedding(spark):
    rng = random.Random(1)
    topics = ["sun sea sand sky salt".split(), "desk lamp chair book pen".split()]
    texts = {i: " ".join(rng.choices(topics[i % 2], k=12)) for i in range(40)}
    texts |= {100: "never seen words", 101: "", 102: None, 103: "sea"}
    df = spark.createDataFrame(list(texts.items()), "doc int, text string")
    for size, window, min_count in ((128, 5, 2), (7, 2, 3)):
        words = fit_embedding(df, "text", vector_size=size, window=window, min_count=min_count)
        got = embed(words, df, "doc", "text")
        assert got.dtypes == [("item_id", "int"), ("embedding", "array<double>")]
        found = {r.item_id: r.embedding for r in got.collect()}
        expected = by_hand_embedding(texts, size, window, min_count)
        assert found.keys() == expected.keys()
        for i, vector in expected.items():
            assert found[i] == pytest.approx(vector)
    # alike are those of one topic; other partitions give the same vectors
    vectors = {r.item_id: r.embedding for r in embed(fit_embedding(df, "text"), df, "doc", "text").collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items() if any(v)}
    assert min(unit[0] @ unit[i] for i in range(2, 40, 2)) > max(unit[0] @ unit[i] for i in range(1, 40, 2))
    again = df.repartition(5)
    assert {r.item_id: r.embedding for r in embed(fit_embedding(again, "text"), again, "doc", "text").collect()} == vectors
    assert embed(fit_embedding(df.limit(0), "text"), df.limit(0), "doc", "text").count() == 0


def test_fits_delete_their_shuffles_and_sums_per_user_are_not_moved(spark, monkeypatch, capsys):
    import kindred.operators.collaborative as collaborative

    asked = []

    class Watched(collaborative.ALS):
        def __init__(self, **settings):
            asked.append(settings["checkpointInterval"])
            super().__init__(**settings)

    monkeypatch.setattr(collaborative, "ALS", Watched)
    train = spark.range(60).selectExpr(
        "cast(id % 9 as int) userId", "cast(id % 7 as int) itemId", "1.0 + id % 5 as rating"
    )
    model = fit_als(train, 3, 0.05, 4)
    grid_search(train, train, param_grid(spark, [2], [0.1], [2]))
    assert asked == [2, 1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        capsys.readouterr()
        optimality(model, train, 0.05).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # by item, then by user with the factors; the sums stay where they are
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 4


def test_pairs_of_words_are_moved_once_to_be_counted(spark, capsys):
    rows = [(1, "sea sea sun"), (2, "sun sea pool sea"), (3, None), (4, "pool")]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    met = together(texts, "text", 2, 1)
    expected = Counter()
    for _, text in rows:
        words = (text or "").split()
        for i, a in enumerate(words):
            for b in words[i + 1 : i + 3]:
                expected.update([(a, b), (b, a)])
    assert {(r["word"], r["other"]): r["n"] for r in met.collect()} == expected
    capsys.readouterr()
    together(texts, "text", 2, 1).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_word_vectors_go_once_to_a_block_of_texts(spark, monkeypatch, capsys):
    import kindred.operators.embeddings as embeddings

    words = [f"w{i}" for i in range(12)]
    rows = [(i % 20, " ".join(words[(i * j) % 12] for j in range(9))) for i in range(23)]
    rows += [(None, "w1 w2"), (21, "unknown"), (22, ""), (23, None)]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    fitted = fit_embedding(texts.select("text"), "text")
    whole = {r["item_id"]: r["embedding"] for r in embed(fitted, texts, "id", "text").collect()}
    for name, size in (("BLOCK_TEXTS", 4), ("SLICES", 3), ("CHUNK_ROWS", 5)):
        monkeypatch.setattr(embeddings, name, size)
    again = embed(fitted, texts, "id", "text")
    assert {r["item_id"]: r["embedding"] for r in again.collect()} == whole
    assert set(whole) == {*range(20), None, 21, 22, 23} and any(whole[1])
    assert not any(whole[None]) and not any(whole[21]) and not any(whole[22])
    # counts meet vectors by block; no join puts a vector beside each count
    again.explain()
    assert "FlatMapCoGroupsInArrow" in capsys.readouterr().out


def test_parts_of_a_fit_follow_the_ratings(spark, monkeypatch):
    ratings = spark.range(3000).selectExpr(
        "cast(id % 60 as int) userId", "cast((id * 7) % 50 as int) itemId", "cast(id % 5 + 1 as double) rating"
    )
    made = []

    class Spy(collaborative.ALS):
        def fit(self, train):
            made.append((self.getNumUserBlocks(), self.getNumItemBlocks(), self.getCheckpointInterval()))
            return super().fit(train)

    monkeypatch.setattr(collaborative, "ALS", Spy)
    known = collaborative.fit_als(ratings, rank=2, max_iter=2).userFactors.count()
    # a task holds the ratings of a part and the factors they name
    monkeypatch.setattr(collaborative, "BLOCK_RATINGS", 150, raising=False)
    assert collaborative.fit_als(ratings, rank=2, max_iter=2).userFactors.count() == known
    assert made == [(16, 16, 2), (20, 20, 1)]
