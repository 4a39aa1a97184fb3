"""Manifests against a plain tree, and the layout."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from boxline.llm import merkle
from compare import rows_of


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text) -> str:
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climb(level: list[str], at: int) -> list[tuple[int, list[str]]]:
    path = []
    while len(level) > 1:
        first = at - at % 3
        path.append((at - first, level[first:at] + level[at + 1 : first + 3]))
        level, at = [digest(*level[i : i + 3]) for i in range(0, len(level), 3)], at // 3
    return path + [level[0]]


def plain(rows) -> list:
    by_source: dict = {}
    for r in rows:
        tampered = r["text"]
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and tampered is not None:
            tampered = tampered.replace("\n", "")
        by_source.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, tampered)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s]) for s in order}
    subroots = [climb([x[2] for x in trees[s]], 0)[-1] for s in order]
    out = []
    for place, s in enumerate(order):
        *crown, root = climb(subroots, place)
        for i, (known, doc_id, own, tampered) in enumerate(trees[s]):
            *path, subroot = climb([x[2] for x in trees[s]], i)
            for at, others in (path := path + crown):
                tampered = digest(*others[:at], tampered, *others[at:])
            out.append((doc_id if known else None, own, subroot, root, digest(*(o for _, others in path for o in others)), tampered, tampered == root, s, i))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source", "rank"]


def made(docs):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(docs, changed={"text": text})


def checked(docs):
    rows = docs.collect()
    found = made(docs)
    wanted = rows_of(COLUMNS, plain(rows))
    assert rows_of(found.columns, found.collect()) == wanted
    return wanted


def test_addresses_fill_the_layout():
    for height in range(1, 9):
        nodes = [merkle.address(height, d, i) for d in range(height) for i in range(3**d)]
        assert sorted(nodes) == list(range(len(nodes)))
    # Split at half height: the top two levels first, then each bottom subtree in one run.
    assert [merkle.address(4, d, i) for d, i in ((0, 0), (1, 0), (1, 2), (2, 0), (3, 0), (3, 2), (2, 1), (3, 3))] == [0, 1, 3, 4, 5, 7, 8, 9]


@pytest.mark.parametrize("edges", [1, 2, 7])
def test_equals_plain_trees(spark, monkeypatch, edges):
    monkeypatch.setattr(merkle, "EDGES", edges)
    rows = [(i, f"line\n{i}" if i % 3 else None, None if i % 11 == 0 else "en", "big" if i % 2 else ["a", "é", None, "z"][i // 2 % 4] if i < 90 else f"one{i}", i) for i in range(140)]
    docs = spark.createDataFrame([*rows, rows[5], rows[5], (None, "x\ny", "en", "big", 3), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    checked(docs)


def test_sql(spark, odd):
    wanted = checked(odd.withColumns({"source": F.when(F.col("doc_id") != 8, F.col("source")), "rank": F.lit("r"), "tree": F.lit("t")}))
    con = duckdb.connect()
    con.register("documents", odd.withColumn("source", F.when(F.col("doc_id") != 8, F.col("source"))).toArrow())
    result = con.execute(merkle.oracle())
    assert rows_of([d[0] for d in result.description], result.fetchall()) == wanted


def test_lone_and_no_leaves(spark, odd, none):
    checked(odd.where("doc_id = 5"))
    assert made(none).count() == 0


def test_blocks_are_addressed_apart(spark, monkeypatch):
    monkeypatch.setattr(merkle, "EDGES", 2)
    leaves = spark.range(500).select(F.lit("=s").alias("tree"), F.col("id").alias("rank"), F.lit(500).cast("long").alias("n"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    layers = merkle.build(leaves, "test")
    blocks = [r for layer in layers for r in layer.collect()]
    assert [layer.count() for layer in layers] == [56, 7, 1]
    spans = sorted((b["address"], b["address"] + len(b["nodes"]) // 32) for b in blocks)
    assert spans[0][0] == 0 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
