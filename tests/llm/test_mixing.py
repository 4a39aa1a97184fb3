"""Entropy balancing against a plain solver."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from boxline.llm import mixing
from boxline.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Targets by handing out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        free = [s for s in order if s not in stopped]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in stopped else weight[s] * level for s in order}
        stopped |= over


def tilt(sizes: np.ndarray, target: float, most=2) -> np.ndarray:
    """Rates by bisection of the one constraint."""
    mean = sizes.mean()
    low, high = -1e4, 1e4
    for _ in range(300):
        lam = (low + high) / 2
        rates = np.exp(np.minimum(lam * sizes / mean, math.log(most)))
        low, high = (lam, high) if rates @ sizes < target else (low, lam)
    return np.exp(np.minimum(high * sizes / mean, math.log(most)))


def check(rows, documents):
    by_source: dict = {}
    for doc_id, text, source in documents:
        by_source.setdefault(source, []).append(len(WORD.findall(text or "")))
    totals = {s: sum(v) for s, v in by_source.items()}
    wanted = filled(totals)
    known = {}
    for source, held in by_source.items():
        real = np.array(sorted(n for n in held if n), float)
        if len(real):
            known[(totals[source], round(wanted[source], 3))] = dict(zip(real, tilt(real, wanted[source])))
    assert len(rows) == len(documents)
    taken: dict = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        at = (r["source_size"], round(r["target"], 3))
        taken[at] = taken.get(at, 0) + r["taken"]
        if r["size"]:
            assert abs(r["rate"] - known[at][r["size"]]) < 1e-5, (r, known[at][r["size"]])
    got = sorted((n, t) for n, t in taken)
    assert got == sorted((totals[s], round(wanted[s], 3)) for s in totals) or len(set(got)) < len(totals)
    return taken


def test_targets_and_rates(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = mixing.mix(docs).collect()
    documents = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    for (size, target), taken in check(rows, documents).items():
        # Ten documents a source: off by less than the shortest that could still be moved.
        assert abs(taken - target) <= 0.03 * target, (size, target, taken)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_uneven_source_is_met_closely(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + (i * 37) % 90 + (5000 if i % 400 == 0 else 0)), "abc"[i % 7 % 3]) for i in range(1200)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    for (_, target), taken in check(rows, [tuple(r) for r in docs.collect()]).items():
        assert abs(taken - target) <= 1


def test_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    check(rows, [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()])
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    assert mixing.mix(none).count() == 0
    unnamed = mixing.mix(odd.withColumn("source", F.when(F.col("doc_id") > 5, F.lit("z")))).collect()
    assert len(unnamed) == odd.count() and len({r["source_size"] for r in unnamed}) == 2
    empty = mixing.mix(odd.withColumn("text", F.lit(None).cast("string"))).collect()
    assert {(r["size"], r["taken"], r["target"]) for r in empty} == {(0, 0, 0.0)}
