import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import kindred.operators.topk as topk
from kindred.operators.corpus import (
    corpus_segments,
    feedback_bag,
    item_corpus,
    length_profile,
    table_shape,
)
from kindred.operators.dictionaries import Dictionaries
from kindred.operators.neighbors import (
    UnknownSeedError,
    as_seeds,
    first_by_name,
    require_seeds,
    similar_by_vector,
    unknown_seeds,
)
from kindred.operators.terms import fit_tfidf, segment_counts, spread_by_item, term_counts
from kindred.plans.content import index_tables, index_texts, similar_items
from kindred.plans.serving import search, search_rows, similar_by_name
from kindred.session import cut

TEXTS = {
    1: "pool near the beach, quiet beach",
    2: "Beach pool with quiet garden",
    3: "city centre hotel",
    4: "pool near the beach, quiet beach",
    5: "",
    6: "hotel near the city",
    7: "unrelated zebra",
    8: "pool near the beach, quiet beach",
}
WORDS = "sun sea pool bar spa gym beach city view bed".split()


def py_tfidf(texts, max_features, min_df=2):
    """Weights from the formula, one dictionary per text."""
    counts = {}
    for key, text in texts.items():
        toks = re.findall(r"\b\w\w+\b", text.lower())
        counts[key] = Counter(toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])])
    df, ctf = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        ctf.update(c)
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-ctf[t], t))[:max_features]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for key, c in counts.items():
        raw = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[key] = {t: x / norm for t, x in raw.items()}
    return out


def py_ranking(seed_weights, weights, k, keep_self=False):
    out = {}
    for s, a in seed_weights.items():
        scored = []
        for i, b in weights.items():
            if keep_self or i != s:
                dot = sum(w * b.get(t, 0.0) for t, w in a.items())
                scored.append((-round(dot, 6), i))
        out[s] = [(i, -d) for d, i in sorted(scored)[:k]]
    return out


def ranking(df):
    out = {}
    for r in df.orderBy("seed_id", "rank").collect():
        out.setdefault(r["seed_id"], []).append((r["item_id"], r["similarity"]))
        assert r["rank"] == len(out[r["seed_id"]])
    return out


def same(got, expected):
    assert got.keys() == expected.keys()
    for key, rows in expected.items():
        assert [i for i, _ in got[key]] == [i for i, _ in rows], key
        assert np.allclose([s for _, s in got[key]], [s for _, s in rows], atol=2e-6)


def texts_df(spark, texts):
    return spark.createDataFrame(list(texts.items()), "item_id bigint, text string")


@pytest.mark.parametrize("max_features", [5, 1000])
def test_weights_follow_the_formula(spark, max_features):
    df = texts_df(spark, TEXTS)
    counts = term_counts(spread_by_item(df, "item_id", "text"))
    model = fit_tfidf(counts, df, max_features)
    got = {}
    for r in model.postings(model.weigh(counts)).collect():
        got.setdefault(r["item_id"], {})[r["term"]] = r["weight"]
    expected = {k: w for k, w in py_tfidf(TEXTS, max_features).items() if w}
    assert got.keys() == expected.keys()
    for key in expected:
        assert got[key] == pytest.approx(expected[key])


@pytest.mark.parametrize("k", [2, 20])
def test_similar_items_with_copies_zeros_and_ties(spark, k):
    index = index_texts(texts_df(spark, TEXTS), "item_id", "text")
    weights = py_tfidf(TEXTS, 50_000)
    same(ranking(similar_items(index, k)), py_ranking(weights, weights, k))


def test_many_blocks_give_the_same_lists(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = {
        i: " ".join(rng.choice(WORDS, rng.integers(0, 9))) for i in range(150)
    }
    # a third of all items are copies of one text
    texts |= {i: "sun sea pool" for i in range(150, 225)}
    index = index_texts(texts_df(spark, texts), "item_id", "text", 60)
    for name, size in (("GROUP_ROWS", 50), ("BLOCK_ROWS", 16), ("PAGE_ROWS", 4)):
        monkeypatch.setattr(topk, name, size)
    weights = py_tfidf(texts, 60)
    same(ranking(similar_items(index, 7)), py_ranking(weights, weights, 7))
    wanted = spark.createDataFrame([(3,), (160,)], "seed_id bigint")
    chosen = {s: weights[s] for s in (3, 160)}
    same(ranking(similar_items(index, 7, wanted)), py_ranking(chosen, weights, 7))


def brute_force(seeds, items, score, k, keep_self):
    out = {}
    for s, a in seeds.items():
        scored = sorted((-round(score(a, b), 6), i) for i, b in items.items() if keep_self or i != s)
        out[s] = [(i, -d) for d, i in scored[:k]]
    return out


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


@pytest.mark.parametrize("kind, score", [("VECTORS", cosine), ("FACTORS", lambda a, b: float(a @ b))])
def test_pruned_lists_are_exact_and_skip_blocks(spark, monkeypatch, kind, score):
    for name, size in (("GROUP_ROWS", 20), ("BLOCK_ROWS", 16), ("PAGE_ROWS", 8), ("PER_PIVOT", 40)):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * rng.uniform(0.3, 4, size=(12, 1))
    rows = {i: centres[i % 12] + rng.normal(size=6) * 0.1 for i in range(400)}
    rows |= {i: rows[5] for i in range(400, 460)}  # ties
    rows |= {460: np.zeros(6), 461: np.zeros(6), 462: -rows[5]}
    kind = getattr(topk, kind)
    [name] = kind.columns
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], f"item_id bigint, {name} array<double>")
    blocks = topk.Blocks.of(df, kind)
    seeds = as_seeds(df, spark.createDataFrame([(i,) for i in range(0, 463, 7)] + [(460,)], "seed_id bigint"))
    chosen = {i: rows[i] for i in [*range(0, 463, 7), 460]}
    for k, keep_self in ((6, False), (470, True)):
        same(ranking(blocks.top(seeds, k, keep_self)), brute_force(chosen, rows, score, k, keep_self))
    grouped = blocks.grouped(seeds)
    read = blocks.to_read(grouped, 6, False).where("block >= 0").count()
    assert read < 0.5 * len(chosen) * blocks.summaries.count()
    # other partitions, the same blocks
    again = topk.Blocks.of(df.repartition(7), kind)
    assert again.rows.select("item_id", "block").exceptAll(blocks.rows.select("item_id", "block")).isEmpty()


def test_seeds_are_not_broadcast_and_move_once_to_a_part(spark, monkeypatch, capsys):
    for name, size in (("GROUP_ROWS", 20), ("BLOCK_ROWS", 16)):
        monkeypatch.setattr(topk, name, size)
    monkeypatch.setattr(topk, "LEAST_PARTS", 2, raising=False)
    rng = np.random.default_rng(4)
    rows = {i: rng.random(6) for i in range(300)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "item_id bigint, features array<double>")
    blocks = topk.Blocks.of(df, topk.FACTORS)
    assert blocks.summaries.count() == 19
    top = blocks.top(as_seeds(df), 4, True)
    same(ranking(top), brute_force(rows, rows, lambda a, b: float(a @ b), 4, True))
    # lists of blocks are small in files however many they are, so Spark must not be left the choice
    capsys.readouterr()
    top.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin [seed_id" in plan and "BroadcastHashJoin [seed_id" not in plan
    wanted, _ = blocks._searched(blocks.celled(blocks.grouped(as_seeds(df))), 4, True)
    assert wanted.groupBy("seed_id", "_part").count().where("count > 1").isEmpty()
    assert wanted.where("_part >= 0").groupBy("seed_id").count().where("count > 3").isEmpty()


def test_counts_made_in_other_ways_are_the_same(spark, monkeypatch):
    import kindred.operators.terms as terms

    rng = np.random.default_rng(9)
    rows = [(i % 40, " ".join(rng.choice(WORDS + ["a", "ÀÉ", "x_1", "?!"], rng.integers(0, 9)))) for i in range(70)]
    rows += [(50, ""), (51, None), (52, "!"), (None, "sun sea sun sea")]
    texts = spread_by_item(spark.createDataFrame(rows, "item_id bigint, text string"), "item_id", "text")
    expected = Counter(map(tuple, term_counts(texts).collect()))
    for words in (7, 500_000):
        monkeypatch.setattr(terms, "COUNT_WORDS", words)
        assert Counter(map(tuple, terms.loose_counts(texts).collect())) == expected
    known = {"sun", "sea", "sun sea", "nowhere"}
    table = spark.createDataFrame([(t,) for t in known], "term string")
    for most in (10, 10**9):
        found = terms.known_counts(texts, table, most).select("item_id", "term", "tf").collect()
        assert Counter(map(tuple, found)) == Counter({r: n for r, n in expected.items() if r[1] in known})


def test_no_table_grows_with_seeds_times_blocks(spark, monkeypatch):
    for name, size in (("GROUP_ROWS", 20), ("BLOCK_ROWS", 4), ("LEAST_PARTS", 2)):
        monkeypatch.setattr(topk, name, size)
    written = []

    def kept(df, name="table"):
        written.append(cut(df, name))
        return written[-1]

    monkeypatch.setattr(topk, "cut", kept)
    rng = np.random.default_rng(8)
    rows = {i: rng.random(6) for i in range(300)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "item_id bigint, features array<double>")
    blocks = topk.Blocks.of(df, topk.FACTORS)
    assert blocks.summaries.count() == 75
    same(ranking(blocks.top(as_seeds(df), 4, True)), brute_force(rows, rows, lambda a, b: float(a @ b), 4, True))
    # a seed's vector has 6 values; there are 2 or 3 parts and the lowest ids, and 75 blocks
    for table in written:
        if "seed_id" in table.columns:
            for name in (n for n, kind in table.dtypes if kind.startswith("array")):
                assert table.agg(F.max(F.size(name))).first()[0] <= 6


def test_sparse_blocks_of_other_topics_are_not_read(spark, monkeypatch):
    for name, size in (("GROUP_ROWS", 50), ("BLOCK_ROWS", 20), ("PER_PIVOT", 10)):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(5)
    texts = {i: " ".join(f"t{i % 4}w{j}" for j in rng.integers(0, 40, 12)) for i in range(200)}
    index = index_texts(texts_df(spark, texts), "item_id", "text")
    blocks = topk.Blocks.of(index.vectors, topk.TERMS)
    grouped = blocks.grouped(as_seeds(index.vectors))
    read = blocks.to_read(grouped, 5, False).where("block >= 0").count()
    assert read < 0.45 * 200 * blocks.summaries.count()
    weights = py_tfidf(texts, 50_000)
    same(ranking(similar_items(index, 5)), py_ranking(weights, weights, 5))


def test_empty_tables_give_empty_lists(spark):
    none = spark.createDataFrame([], "item_id bigint, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "item_id bigint, embedding array<double>")
    assert similar_by_vector(as_seeds(none), one, 3).count() == 0
    assert similar_by_vector(as_seeds(one), none, 3).count() == 0
    assert similar_by_vector(as_seeds(one), one, 3).count() == 0


def test_text_ids(spark):
    rows = [("b", "sun sea"), ("a", "sun sea"), ("c", "sun sea bar")]
    index = index_texts(spark.createDataFrame(rows, "item_id string, text string"), "item_id", "text")
    assert [i for i, _ in ranking(similar_items(index, 2))["c"]] == ["a", "b"]


def test_search(spark):
    index = index_texts(texts_df(spark, TEXTS), "item_id", "text", 10_000)
    queries = {1: "quiet POOL, beach?", 2: "nothing known", 3: ""}
    df = spark.createDataFrame(list(queries.items()), "q bigint, words string")
    got = ranking(search(index, df, "q", "words", k=4))
    # weigh the queries with the vocabulary of the items
    toks = {q: re.findall(r"\b\w\w+\b", t.lower()) for q, t in queries.items()}
    terms = {r["term"]: r["idf"] for r in index.model.terms.collect()}
    seeds = {}
    for q, ts in toks.items():
        raw = {
            t: n * terms[t]
            for t, n in Counter(ts + [f"{a} {b}" for a, b in zip(ts, ts[1:])]).items()
            if t in terms
        }
        norm = math.sqrt(sum(x * x for x in raw.values()))
        seeds[q] = {t: x / norm for t, x in raw.items()}
    same(got, py_ranking(seeds, py_tfidf(TEXTS, 10_000), 4, keep_self=True))


def test_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=5).round(3).tolist() for i in range(30)}
    vectors[30] = [0.0] * 5
    vectors[31] = vectors[3]
    df = spark.createDataFrame(list(vectors.items()), "item_id bigint, embedding array<double>")
    unit = {
        i: {d: x / (np.linalg.norm(v) or 1.0) for d, x in enumerate(v)} for i, v in vectors.items()
    }
    same(ranking(similar_by_vector(as_seeds(df), df, 6)), py_ranking(unit, unit, 6))


def test_seed_checks(spark):
    items = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "item_id bigint, item_name string")
    wanted = spark.createDataFrame([(2,), (9,), (9,)], "seed_id bigint")
    assert [r["seed_id"] for r in unknown_seeds(wanted, items).collect()] == [9]
    with pytest.raises(UnknownSeedError, match="9"):
        require_seeds(wanted, items)
    require_seeds(wanted.filter("seed_id = 2"), items)
    names = spark.createDataFrame([("x",), ("gone",)], "item_name string")
    assert [tuple(r) for r in first_by_name(items, names).collect()] == [("x", 1)]


def test_by_name_uses_the_first_item_and_skips_one_without_a_vector(spark):
    items = spark.createDataFrame(
        [(1, "x"), (2, "y"), (3, "x"), (4, "z")], "item_id bigint, item_name string"
    )
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], "item_id bigint, embedding array<double>"
    )
    rows = similar_by_name(items, vectors, items.select("item_name").distinct(), k=2)
    got = [tuple(r) for r in rows.orderBy("seed_id", "rank").collect()]
    assert got == [
        (1, 2, "y", 0.707107, 1), (1, 3, "x", 0.0, 2),
        (2, 1, "x", 0.707107, 1), (2, 3, "x", 0.707107, 2),
    ]


def test_hits_with_item_rows(spark):
    index = index_texts(texts_df(spark, TEXTS), "item_id", "text", 10_000)
    rows = texts_df(spark, TEXTS).filter("item_id <> 1").selectExpr("item_id", "text", "item_id * 2 AS twice")
    asked = spark.createDataFrame([(1, "quiet POOL, beach?"), (2, "")], "q bigint, words string")
    plain = {tuple(r) for r in search(index, asked, "q", "words", 4).collect()}
    got = search_rows(index, rows, asked, "q", "words", 4).collect()
    assert {(r["seed_id"], r["item_id"], r["similarity"], r["rank"]) for r in got} == plain
    for r in got:
        known = r["item_id"] != 1
        assert r["twice"] == (r["item_id"] * 2 if known else None)
        assert r["text"] == (TEXTS[r["item_id"]] if known else None)
    with pytest.raises(ValueError, match="rank"):
        search_rows(index, rows.selectExpr("item_id", "1 AS rank"), asked, "q", "words")


def test_by_name_over_words(spark):
    items = spark.createDataFrame(
        [(1, "x", "red house"), (2, "y", "red house lake"), (3, "x", "lake view"), (4, "z", "")],
        "item_id bigint, item_name string, text string",
    )
    index = index_texts(items, "item_id", "text", 100)
    got = similar_by_name(items, index, items.select("item_name").distinct(), k=2)
    asked = items.filter("item_id IN (1, 2, 4)").selectExpr("item_id AS seed_id")
    lists = {tuple(r) for r in similar_items(index, 2, asked).collect()}
    assert {(r["seed_id"], r["item_id"], r["similarity"], r["rank"]) for r in got.collect()} == lists
    assert {r["item_id"]: r["item_name"] for r in got.collect()} == {1: "x", 2: "y", 3: "x"}


def test_tables_to_index(spark):
    items = spark.createDataFrame(
        [(1, "A", "Red house", None), (2, "B", "blue house", "lake"), (3, "C", None, None)],
        "`Hotel ID` bigint, hotel_name string, Hotel_Description string, `Hotel_Description 2` string",
    ).withColumnRenamed("Hotel ID", "Hotel_ID")
    feedback = spark.createDataFrame(
        [("1", 0, "Red"), ("1", 1, "lake"), ("3", 2, "blue house"), ("9", 3, "lost"), (None, 4, "lost")],
        "Hotel_ID string, n int, said string",
    )
    none = Dictionaries()
    found = index_tables(items, feedback, none, "n", min_df=1)
    assert (found.roles.item_id, found.roles.join_key) == ("Hotel_ID", "Hotel_ID")
    assert found.roles.text == ["Hotel_Description", "Hotel_Description 2"]
    terms = {r["term"] for r in found.index.model.terms.collect()}
    assert {"red house", "house red", "red lake", "house lake", "blue house"} <= terms and "lost" not in terms
    assert sorted(r["item_id"] for r in found.index.vectors.collect()) == [1, 2, 3]
    alone = index_tables(items, feedback.drop("Hotel_ID"), none, "n", min_df=1)
    assert "lake" in {r["term"] for r in alone.index.model.terms.collect()} and alone.roles.join_key is None


SAID = [(1, 3, "cc dd"), (1, 1, ""), (1, 0, "aa"), (1, 2, "bb"), (2, 0, "zz"), (9, 0, "lost")]


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_bag_keeps_the_order(spark, chunk):
    said = spark.createDataFrame(SAID, "item_id int, ord int, said string")
    bags = feedback_bag(said, "item_id", "said", "ord", chunk=chunk)
    got = {r["item_id"]: r["bag"] for r in bags.collect()}
    assert got == {1: "aa  bb cc dd", 2: "zz", 9: "lost"}


def test_corpus(spark):
    said = spark.createDataFrame(SAID, "item_id int, ord int, said string")
    items = spark.createDataFrame([(1, "own"), (3, "alone")], "item_id int, text string")
    bags = feedback_bag(said, "item_id", "said", "ord")
    got = {r["item_id"]: r["corpus"] for r in item_corpus(items, bags, "item_id", "text").collect()}
    assert got == {1: "own aa  bb cc dd", 3: "alone "}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_counting_pieces_equals_counting_the_joined_text(spark, chunk):
    rng = np.random.default_rng(3)
    # item 0 has most of the feedback
    said = [
        (int(rng.choice([0, 0, 0, 1, 2])), n, " ".join(rng.choice(WORDS, rng.integers(0, 4))))
        for n in range(400)
    ]
    items = [(0, "sun bed"), (1, ""), (2, "x"), (3, "view")]
    said_df = spark.createDataFrame(said, "item_id int, ord int, said string")
    items_df = spark.createDataFrame(items, "item_id int, text string")
    segments = corpus_segments(items_df, said_df, "item_id", "text", "said", "ord")
    joined = item_corpus(
        items_df, feedback_bag(said_df, "item_id", "said", "ord"), "item_id", "text"
    ).withColumnRenamed("corpus", "text")
    pieces = segment_counts(segments, "item_id", chunk=chunk)
    whole = term_counts(spread_by_item(joined, "item_id", "text"))
    rows = sorted(map(tuple, pieces.collect()))
    assert rows == sorted(map(tuple, whole.collect())) and rows


def test_profile_and_shape(spark):
    lengths = [1, 2, 2, 7, 0]
    df = spark.createDataFrame([("x" * n,) for n in lengths] + [(None,)], "t string")
    row = length_profile(df, "t").first()
    assert (row["count"], row["min"], row["max"]) == (5, 0, 7)
    assert (row["p25"], row["p50"], row["p75"]) == tuple(np.percentile(lengths, [25, 50, 75]))
    assert row["mean"] == pytest.approx(np.mean(lengths))
    assert row["std"] == pytest.approx(np.std(lengths, ddof=1))
    one = length_profile(df.filter("t = 'x'"), "t").first()
    assert one["std"] is None
    assert tuple(table_shape(df).first()) == (6, 1)


def test_terms_are_counted_inside_a_row(spark, capsys):
    rows = [(1, "b a a b"), (1, "a b"), (2, ""), (None, "aa bb aa bb"), (3, "aa bb"), (3, None), (3, "aa"), (4, "x")]
    df = spark.createDataFrame(rows, "item_id bigint, text string")
    spread = spread_by_item(df, "item_id", "text")
    counts = term_counts(spread)
    got = {(r["item_id"], r["term"]): r["tf"] for r in counts.collect()}
    assert got == {
        (None, "aa"): 2, (None, "bb"): 2, (None, "aa bb"): 2, (None, "bb aa"): 1,
        (3, "aa"): 2, (3, "bb"): 1, (3, "aa bb"): 1,
    }
    # no table of all terms of a task, and parts are not put together by their size before terms are made
    capsys.readouterr()
    counts.explain()
    plan = capsys.readouterr().out
    assert "term" not in "".join(line for line in plan.splitlines() if "Aggregate(keys" in line)
    assert "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("keep_self", [False, True])
def test_few_seeds_meet_all_items_without_clusters(spark, monkeypatch, keep_self):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)

    def clusters(*_):
        raise AssertionError("a few seeds need no clusters")

    monkeypatch.setattr(topk, "_assigned", clusters)
    rng = np.random.default_rng(6)
    texts = {i: " ".join(rng.choice(WORDS, rng.integers(0, 9))) for i in range(400)}
    index = index_texts(texts_df(spark, texts), "item_id", "text", 60)
    weights = py_tfidf(texts, 60)
    seeds = as_seeds(index.vectors).where("seed_id % 40 = 3")
    chosen = {s: w for s, w in weights.items() if s % 40 == 3}
    found = topk.top(index.vectors, seeds, topk.TERMS, 7, keep_self)
    same(ranking(found), py_ranking(chosen, weights, 7, keep_self=keep_self))
