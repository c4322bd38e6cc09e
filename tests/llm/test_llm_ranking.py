"""Quality classifier, lexical search and hard negatives, against plain Python."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_text import EDGES, LONG, clashing, documents

from kindred.llm import hard_negatives, lexical, pu_quality
from kindred.llm.catalog import in_fold

# quality classifier


def web_texts(n):
    """Plain prose, and one in six spoiled in one of three ways."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "sto") for b in ("ren", "tal", "vix", "zom")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        bad = i % 6 == 0
        if bad:
            how = rng.randrange(3)
            text = [w.upper() + "!!" for w in text] if how == 0 else text
            text = [w + rng.choice(["###", "$$$"]) for w in text] if how == 1 else text
            text = [text[0]] * len(text) if how == 2 else text
        rows.append((i, " ".join(text).capitalize() + "." if not bad else " ".join(text)))
        labels.append((i, int(not bad)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = web_texts(2400)
    trusted = [(i, y) for i, y in labels if i % 2 == 0 or i % 5 == 0]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    docs = clashing(documents(spark, rows))
    given = spark.createDataFrame(trusted, "doc_id bigint, label int").where(~in_fold(2, 4))
    got = {r.doc_id: r for r in pu_quality.classify(docs.repartition(3), given).collect()}
    own = [i for i in range(2400) if held(i)]
    assert sum(got[i].predicted == labels[i][1] for i in own) / len(own) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    # neither order and number of partitions matter, nor labels of 0
    some = {r.doc_id: r.score for r in pu_quality.classify(docs.repartition(7), given, steps=6).collect()}
    blind = pu_quality.classify(docs, given.where("label = 1"), steps=6)
    assert {r.doc_id: r.score for r in blind.collect()} == some


def plain_risk(weights, places, good, prior):
    g = weights[0] + weights[places].sum(axis=1)
    bad = np.logaddexp(0, g).mean() - prior * np.logaddexp(0, g[good]).mean()
    return prior * np.logaddexp(0, -g[good]).mean() + max(0.0, bad)


def test_risk_is_the_non_negative_one(spark):
    rows, labels = web_texts(600)
    rows = pu_quality.marked_good(
        pu_quality.described(documents(spark, rows)), spark.createDataFrame(labels, "doc_id bigint, label int")
    )
    table = rows.toArrow()
    places = pu_quality._places(table.select(["bins"]).combine_chunks().to_batches()[0])
    half = table["half"].to_numpy()
    good = half > 0
    assert {int(i) for i in table["doc_id"].to_numpy()[good]} == {i for i, y in labels if y}
    weights = np.random.default_rng(0).normal(size=pu_quality.SIZE)
    sums = pu_quality._sums(rows, weights, F.col("half") > 0)
    step = 1e-5
    for at in (0, 5, 60):
        moved = [weights.copy(), weights.copy()]
        moved[0][at] -= step
        moved[1][at] += step
        for row, chosen in ((0, slice(None)), (1, good)):
            losses = [np.logaddexp(0, w[0] + w[places[chosen]].sum(axis=1)).sum() for w in moved]
            assert sums[row][at] == pytest.approx((losses[1] - losses[0]) / (2 * step), abs=1e-2)
    model = pu_quality.fit(rows)
    assert abs(model.prior - 5 / 6) < 0.08
    start = plain_risk(np.zeros(pu_quality.SIZE), places, good, model.prior)
    assert plain_risk(model.weights, places, good, model.prior) < 0.2 * start
    both = pu_quality._together(rows)
    has = np.zeros((len(good), pu_quality.SIZE))
    has[:, 0] = 1
    np.put_along_axis(has, places, 1, axis=1)
    assert (both == has.T @ has).all()


def test_estimate_prior():
    # all good texts above half of the bad ones
    every, good = np.array([30, 60, 80, 100]), np.array([25, 50, 50, 50])
    assert pu_quality.estimate_prior(every, good, 0) == pytest.approx(0.6)
    assert pu_quality.estimate_prior(every, good, 2) == pytest.approx(0.6)
    assert pu_quality.estimate_prior(every, good * 0, 0) == 0.5


def test_signals_by_hand():
    names = list(pu_quality.SIGNALS)
    [row, empty] = pu_quality.describe([b"Aa bb bb,\nbb, 12 !!! aa", None])
    got = dict(zip(names, row))
    assert got["words"] == 7 and got["distinct"] == pytest.approx(6 / 7) and got["breaks"] == pytest.approx(1 / 7)
    assert got["capitals"] == pytest.approx(1 / 10) and got["only_marks"] == pytest.approx(2 / 7)
    assert got["ends_in_mark"] == pytest.approx(3 / 7) and got["mark_runs"] == pytest.approx(2 / 17)
    assert got["same_again"] == pytest.approx(1 / 7) and got["top_word"] == pytest.approx(2 / 7)
    assert not empty.any()


def test_quality_edges(spark):
    docs = clashing(documents(spark, EDGES))
    labels = "doc_id bigint, label int"
    none = pu_quality.classify(docs, spark.createDataFrame([], labels)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    odd = spark.createDataFrame([(1, 1), (4, 1), (2, None), (None, 1), (5, 1), (5, 0)], labels)
    marked = pu_quality.marked_good(pu_quality.described(docs), odd)
    assert sorted(r.doc_id for r in marked.collect() if r.half) == [1, 4]
    scored = pu_quality.classify(docs, odd, steps=4)
    assert scored.columns == ["doc_id", "score", "predicted"]
    rows = scored.collect()
    assert len(rows) == len(EDGES)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1  # null and empty
    assert pu_quality.classify(docs.limit(0), odd, steps=4).count() == 0


# ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand_search(docs, items, k):
    rows = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    n_docs, n_terms = len(rows), sum(sum(c.values()) for _, c in rows)
    df = collections.Counter(t for _, c in rows for t in c)
    wanted = collections.defaultdict(set)
    for i, text in items:
        if i is not None:
            wanted[i] |= set(plain_terms(text))
    out = []
    for item, words in wanted.items():
        scored = []
        for i, c in rows:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in words & c.keys()
            )
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def search_fixture():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(90)] + ["Größe", "ÉTÉ", "ñ-x", "a_b", "été"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(300)]
    rows += [(500 + i, rows[i][1].upper()) for i in range(40)]  # ties
    rows += [(7, "W1 w2"), (7, "W1 w2"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), *EDGES, (601, "w5 " * 5000)]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "nowhere"), (None, "w1"), (33, "w1 w2"), (33, "w3"), (34, " ".join(words)), (35, "w1, W1; w1")]
    items += [(36, " ".join(words + [f"w{i}" for i in range(977)]))]  # more than 64 terms, most of the long text's
    return rows, items


@pytest.mark.parametrize("small", [False, True])
def test_search_by_hand(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lexical, "BLOCK_TERMS", 300)
        monkeypatch.setattr(lexical, "CELLS", 2_000)
        monkeypatch.setattr(lexical, "STEP", 2)
        monkeypatch.setattr(lexical, "AT_ONCE", 500)
    rows, items = search_fixture()
    docs = clashing(documents(spark, rows)).withColumn("tf", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit("x"))
    got = lexical.search(docs, asked, 10)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand_search(rows, items, 10)


def test_search_of_empty_tables(spark):
    rows, items = search_fixture()
    docs, asked = documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    assert lexical.search(docs.limit(0), asked).count() == 0
    assert lexical.search(docs, asked.limit(0)).count() == 0


def test_masks_group_equal_columns():
    rng = np.random.default_rng(3)
    for terms in (1, 9, 70, 200):
        present = np.repeat(rng.random((terms, 12)) < 0.5, 4, axis=1)[:, rng.permutation(48)]
        masks, group = lexical.mask_groups(present)
        assert (masks[:, group] == present).all()
        assert masks.shape[1] == len({c.tobytes() for c in present.T})


def test_search_stops_early():
    rng = np.random.default_rng(4)
    parts = rng.integers(400_000, 500_000, size=(10, 5_000)).astype(np.int32) * (rng.random((10, 5_000)) < 0.3)
    weight = np.array([9000, 50, 40, 30, 20, 10, 5, 4, 3, 2])
    best = lexical.Best(20)
    docs = np.arange(5_000)
    scored = lexical.rank_batch(parts.astype(np.int32), weight, docs, np.zeros(5_000, bool), best)
    order = np.lexsort((docs, -(weight @ parts)))[:20]
    assert best.docs.tolist() == order.tolist() and scored < 2_500


# hard negatives


def by_hand_negatives(rows, is_anchor, k=5):
    clean = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [math.floor(256 * float(np.float32(x))) for x in v]
            clean[i] = min(clean.get(i, (w, label)), (w, label))
    out = set()
    for a in filter(is_anchor, clean):
        scored = []
        for i, (v, label) in clean.items():
            if i != a and len(v) == len(clean[a][0]):
                scored.append((-sum(x * y for x, y in zip(v, clean[a][0])), i, label == clean[a][1]))
        scored.sort()
        for p, positive, same in [s for s in scored if s[2]][:k]:
            fits = [(i, -n) for n, i, same in scored if not same and -80 * p <= -100 * n <= -100 * p]
            out |= {(a, positive, r + 1, i, -p, n) for r, (i, n) in enumerate(fits[:k])}
    return out


def vector_rows(scale=1.0):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5)) * 2
    rows = [(i, ((centres[i % 6] + rng.normal(size=5) * 0.4) * scale).tolist(), int(rng.integers(4))) for i in range(500)]
    rows += [(600 + i, rows[3][1], i % 3) for i in range(60)]  # ties
    rows += [(700 + i, (rng.normal(size=3) * scale).tolist(), i % 2) for i in range(80)]  # another length
    rows += [(800, None, 1), (801, [], 1), (802, [1.0, None, 0.0, 0.0, 0.0], 1), (803, [float("nan")] * 5, 1)]
    rows += [(804, rows[1][1], None), (None, rows[2][1], 1), (805, [float("inf")] * 5, 1), (806, [0.0] * 5, 2)]
    rows += [(810, rows[9][1], 3), (810, rows[9][1], 2), (810, rows[8][1], 0), (3, rows[3][1], rows[3][2])]
    return rows


@pytest.mark.parametrize("block, scale", [(16, 1.0), (1_024, 1.0), (32, 8.0e5)])
def test_hard_negatives_by_hand(spark, monkeypatch, block, scale):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP_BITS", 3)
    monkeypatch.setattr(hard_negatives, "ZONES", 10)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 20)
    rows = vector_rows(scale)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    df = df.withColumn("block", F.lit(1)).withColumn("score", F.lit("x")).withColumn("v", F.lit(0))
    got = hard_negatives.mine(hard_negatives.candidates(df), F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in got.collect()} == by_hand_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_edges(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    few = spark.createDataFrame([(0, [1.0], 1), (1, [0.5], 1), (2, [0.45], 2), (3, [0.39], 2), (4, [-1.0], 1), (9, [3.0e38], 1)], schema)
    got = hard_negatives.mine(hard_negatives.candidates(few), F.col("vec_id") == 0).collect()
    # the negative positive has an empty window; 9's scores would not fit 64 bits
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 32768, 29440)]
    assert hard_negatives.mine(hard_negatives.candidates(few), F.col("vec_id") > 50).count() == 0
    assert hard_negatives.mine(hard_negatives.candidates(few.limit(0)), F.lit(True)).count() == 0


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2), (1, 4)):
        points = np.array(list(np.ndindex(*[1 << bits] * dims)))
        keys = hard_negatives.hilbert_keys(points, bits)
        order = sorted(range(len(points)), key=lambda i: keys[i].tobytes())
        assert all(np.abs(points[a] - points[b]).sum() == 1 for a, b in zip(order, order[1:]))


def test_bounds_hold_and_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = rng.integers(-300, 300, size=(50, 7))
    anchors = rng.integers(-300, 300, size=(20, 7))
    low, high = hard_negatives.score_bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = anchors @ rows.T
    assert (low[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= high[:, 0]).all()
    schema = "vec_id bigint, embedding array<float>, label int"
    found = hard_negatives.candidates(spark.createDataFrame(vector_rows(), schema))
    placed = hard_negatives.on_curve(found)
    packed = hard_negatives.cut(hard_negatives.blocks(placed.sortWithinPartitions(*hard_negatives.ORDER)))
    anchors = placed.where("vec_id % 10 = 0").withColumn("group", F.lit(0).cast("bigint"))
    zones = packed.drop("ids", "labels", "vectors")
    anchors = anchors.withColumn("floor", F.lit(200_000.0)).drop("place")
    wanted = hard_negatives.to_read(anchors, zones, (1, 1), "positives").collect()
    pairs = sum(len(r.readers) for r in wanted)
    assert pairs < 0.2 * anchors.count() * zones.count()
