"""Classifiers by held-out accuracy, their parts against plain versions, and neighbours against brute force."""

import random
import zlib

import numpy as np
import pytest

from boxline.llm import labelled, neighbours, quality, toxicity
from conftest import prose

SMALL = "/root/testdata/sf0.01"


def held_out_accuracy(rows, labels):
    known = {r["doc_id"]: r["label"] for r in labels.collect()}
    pairs = [(known[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in known]
    return np.mean([a == b for a, b in pairs])


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    return docs, labels


def test_quality_held_out(corpus):
    docs, labels = corpus
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert held_out_accuracy(rows, labels.selectExpr("doc_id", "quality as label")) > 0.95
    assert [r["score"] for r in quality.score_documents(docs, labels).collect()] == [r["score"] for r in rows]


def test_toxicity_held_out(spark):
    r = random.Random(3)
    texts, marks = [], []
    for i in range(600):
        words = prose(i, r.randint(30, 200)).split()
        bad = r.random() < 0.3
        for _ in range(2 if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(["scumbag", "scumlike", "moron"]))
        texts.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == 600 and held_out_accuracy(rows, labels.withColumnRenamed("toxic", "label")) > 0.97


def test_labels_of_the_held_out_fold_teach_nothing(corpus):
    docs, labels = corpus
    fold = "crc32(cast(doc_id as string)) % 5 = 0"
    turned = labels.selectExpr("doc_id", f"case when {fold} then 1 - quality else quality end as quality", f"case when {fold} then 1 - toxic else toxic end as toxic")
    for module in (quality, toxicity):
        a, b = ({r["doc_id"]: r["score"] for r in module.score_documents(docs, x).collect()} for x in (labels, turned))
        assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_and_labels(spark, odd, none, module):
    column = "quality" if module is quality else "toxic"
    schema = f"doc_id long, {column} int"
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (6, 0), (None, 1), (8, None), (12, 1)], schema)
    rows = module.score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1
    assert all(0 < r["score"] < 1 for r in module.score_documents(odd, labels.where("false")).collect())
    assert module.score_documents(none, labels).count() == 0


def test_keep_good_keeps_columns(odd, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(0)
    rows = [np.sort(r.choice(12, 4, replace=False)).astype(np.int32) for _ in range(60)]
    target = np.array([int(x.sum() + r.normal() > 22) for x in rows])
    values, cost = [np.ones(4)] * 60, np.full(60, 0.5)
    w, b = quality.dual_coordinate_descent(rows, values, target, cost, sweeps=2000)
    y = 2 * target - 1

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(c * max(0, 1 - t * (w[x].sum() + b)) for x, t, c in zip(rows, y, cost))

    best = loss(w, b)
    for _ in range(300):
        assert best <= loss(w + np.where(np.arange(len(w)) < 12, r.normal(size=len(w)) * 0.05, 0), b + r.normal() * 0.05) + 1e-3


def test_platt_recovers_a_logistic():
    r = np.random.default_rng(1)
    x = r.normal(size=20_000)
    slope, intercept = labelled.platt(x, (r.random(20_000) < labelled.sigmoid(2 * x - 1)).astype(float), np.ones(20_000))
    assert abs(slope - 2) < 0.1 and abs(intercept + 1) < 0.1


def test_kneser_ney_gives_what_is_not_seen_to_both_models_alike():
    kept = [("word", "", "bad", 8, 0), ("word", "", "good", 8, 8), ("pair", "good", "bad", 5, 0)]
    totals = {("word", ""): (20, 20), ("4", ""): (10, 10), ("5", ""): (10, 10), ("6", ""): (10, 10), ("pair", "good"): (8, 8)}
    scorer = toxicity.Scorer(toxicity.estimate(kept, totals, {"bad": 10, "good": 50}, 100))
    bad, pair, plain, unknown, nothing = scorer(["bad", "good bad", "good good", "never", ""])
    assert pair > bad / 2 > 0 and nothing == 0 and abs(plain) < 0.01
    # With equal counts everywhere, the models are equal.
    even = toxicity.Scorer(toxicity.estimate([("word", "", "a", 8, 8)], {**totals, ("word", ""): (20, 20)}, {"a": 9}, 100))
    assert np.allclose(even(["a b a", "zzz"]), 0)


def test_words_are_weighed_by_their_distinct_predecessors(spark):
    texts = [f"san francisco lone{i} various" for i in range(8)] + [f"{w} free" for w in ("san", "big", "red", "old", "new", "wet", "dry", "low")]
    sample = spark.createDataFrame([(1, t) for t in texts] + [(0, "san francisco"), (0, "red frantic")], "target int, text string")
    rows = {(r["level"], r["word"]): (r["toxic"], r["ordinary"]) for r in toxicity.continuations(toxicity.counts_of(sample)).collect()}
    assert rows["word", "francisco"] == (1, 1) and rows["word", "free"] == (8, 0) and rows["word", "various"] == (8, 0)
    assert rows["4", "fran"] == (1, 2) and rows["6", "variou"] == (8, 0) and ("4", "free") not in rows and rows["word", "san"] == (1, 1)
    # In the model, a word of one fixed phrase weighs less than an equally frequent one after many words.
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    docs = spark.createDataFrame(list(zip(ids, [f"{t} end{i}" for i, t in enumerate(texts)] + [f"plain text{i}" for i in range(6)])), "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(text not like 'plain%' as int) as toxic")
    words = toxicity.train(docs, labels)[0]["words"]
    assert words["free"][0] > 5 * words["francisco"][0] > 0


def plain_toxicity(texts, corpus):
    """Tables from plain counts of all labelled texts (target, text) and of the corpus."""
    counts, documents, follows = {}, {}, {}
    for text in corpus:
        for w in set(toxicity.words_of(text)):
            documents[w] = documents.get(w, 0) + 1
    for target, text in texts:
        words = toxicity.words_of(text)
        single = set(words)
        found = {("word", "", w) for w in single} | {("pair", a, b) for a, b in zip(["", *words], words)}
        found |= {(str(n), "", w[:n]) for n in toxicity.BEGINNINGS for w in single if len(w) > n}
        for x in found:
            counts.setdefault(x, [0, 0])[1 - target] += 1
        for a, b in zip(["", *words], words):
            for level, key in [("word", b), *((str(n), b[:n]) for n in toxicity.BEGINNINGS if len(b) > n)]:
                follows.setdefault((level, key), [set(), set()])[1 - target].add(a)
    kept, totals = [], {}
    for (level, a, b), n in counts.items():
        if level == "pair":
            totals[level, a] = tuple(x + y for x, y in zip(totals.get((level, a), (0, 0)), n))
        if sum(n) >= toxicity.LEAST:
            kept.append((level, a, b, *(n if level == "pair" else map(len, follows[level, b]))))
    for (level, _), sets in follows.items():
        totals[level, ""] = tuple(x + len(y) for x, y in zip(totals.get((level, ""), (0, 0)), sets))
    return toxicity.estimate(kept, totals, documents, sum(documents.values()))


def labelled_prose(spark, n):
    r = random.Random(5)
    ids = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5]
    texts = [(i, " ".join(r.choices(["alpha", "beta", "gamma", "delta", "scumbag" if i % 3 == 0 else "flower", "bananas", "go", f"odd{i}"], k=12))) for i in ids]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic"), [(int(i % 3 == 0), t) for i, t in texts if zlib.crc32(str(i).encode()) % 5 < 4]


def test_toxicity_counts_every_labelled_text(spark):
    docs, labels, texts = labelled_prose(spark, 9000)  # more than 4000 of a class
    tables = toxicity.train(docs, labels)[0]
    some = ["scumbag alpha", "flower go beta", "bananas unseen alpha beta", "", texts[0][1]]
    assert np.allclose(toxicity.Scorer(tables)(some), toxicity.Scorer(plain_toxicity(set(texts), [r["text"] for r in docs.collect()]))(some), atol=1e-12)


@pytest.mark.parametrize("head", [0, 3])
def test_toxicity_joins_what_tasks_do_not_hold(spark, monkeypatch, head):
    docs, labels, _ = labelled_prose(spark, 300)
    rows = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "scumbag go"), (7, None), (9, "")], docs.schema))
    read = lambda: sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in toxicity.score_documents(rows, labels).collect())
    whole = read()
    monkeypatch.setattr(toxicity, "HEAD", dict.fromkeys(toxicity.HEAD, head))
    assert read() == whole and len({s for _, s in whole}) > 50


def test_calibration_by_aggregates_is_that_of_all_rows(spark):
    r = np.random.default_rng(4)
    target = r.integers(0, 2, 500)
    scores = r.normal(size=500) * 0.01 + 0.008 * target
    rows = spark.createDataFrame(list(zip(scores.tolist(), target.tolist())), "score double, target long")
    assert np.allclose(labelled.platt_of(rows), labelled.platt(scores, target.astype(float), np.ones(500)), rtol=1e-5)
    assert labelled.platt_of(rows.where("target = 1"))[0] == 0 and labelled.platt_of(rows.limit(0)) == (0.0, 0.0)


def brute_neighbours(rows, every, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 4]
    for q, a in usable:
        if q % every == 0:
            yield q, sorted((float(np.sqrt(((b - a) ** 2).sum())), i) for i, b in usable if i != q)[:k]


def test_neighbours(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in r.normal(size=4).astype(np.float32)]) for i in range(600)]
    rows += [(i, rows[0][1]) for i in range(600, 640)]  # copies, more than a list holds
    rows += [(700, None), (701, [0.0] * 4), (702, [1.0, None, 0.0, 0.0]), (703, [float("nan"), 1.0, 1.0, 1.0]), (704, [float("inf"), 1.0, 1.0, 1.0]), (705, [1.0, 2.0]), (None, [1.0] * 4)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, leaf string, query string")
    rows = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in rows]
    want = dict(brute_neighbours(rows, 10, 10))
    got = {}
    for x in neighbours.nearest_neighbours(frame, every=10, k=10, recall=1.0, leaf_rows=40, block=50).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["score"], x["vec_id"]))
    assert set(got) == set(want)
    hits = sum(len({i for _, _, i in got[q]} & {i for _, i in near}) for q, near in want.items())
    assert hits >= 0.98 * sum(map(len, want.values()))
    for q, near in got.items():
        assert [n for n, _, _ in sorted(near)] == list(range(1, len(near) + 1)) and sorted(near) == sorted(near, key=lambda x: x[1:])
    assert sorted(got[600])[0][1:] == (0.0, 0) and sorted(got[0])[0][1:] == (0.0, 600)


def test_calibration_leaves_out_the_query_itself(spark):
    # One neighbour each: with the query's own row counted, half the hits are free and one leaf is enough.
    points = np.random.default_rng(5).normal(size=(1500, 16)).astype(np.float32)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(points.tolist())], "vec_id long, embedding array<float>")
    got = {r["query_id"]: r["vec_id"] for r in neighbours.nearest_neighbours(frame, every=5, k=1, recall=0.5, leaf_rows=20).collect()}
    apart = ((points[:, None, :].astype(float) - points[None, ::5]) ** 2).sum(axis=2)
    apart[np.arange(0, 1500, 5), np.arange(300)] = np.inf
    assert np.mean([got.get(5 * q) == i for q, i in enumerate(apart.argmin(axis=0))]) > 0.4


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [4.0, 6.0])], "vec_id long, embedding array<float>")
    rows = sorted(map(tuple, neighbours.nearest_neighbours(frame).collect()))
    assert rows == [(0, 1, 1, 0.0), (0, 2, 2, 5.0)]
    assert neighbours.nearest_neighbours(frame.where("false")).count() == 0
    assert neighbours.nearest_neighbours(frame.where("vec_id = 0")).count() == 0


def test_best_bins_come_out_nearest_first():
    r = np.random.default_rng(3)
    points = r.normal(size=(500, 3))
    tree = neighbours.fit_tree(points, branches=4, leaf=10)
    leaves = neighbours.leaves_of(points, tree)
    order = neighbours.best_bins(points[0], tree)
    assert sorted(order) == sorted(set(leaves.tolist())) and order[0] == leaves[0] and neighbours.best_bins(points[0], tree, 3) == order[:3]
