"""WARC round trips, packing, and the pipeline."""

import gzip
import json
import random
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from boxline.llm import packing, warc
from boxline.llm.common import stored
from boxline.llm.queries import tokenizer_path
from compare import rows_of

LONG = "ä<p>" * 400
PAGES = [(1, "http://a/", LONG), (2, "http://b/", LONG), (3, "http://c/", "short"), (4, "http://d/", "short"), (5, None, None), (6, "x\r\ny", "a\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"), (7, "", ""), (None, "n", LONG), (8, "é", LONG + "!"), (8, "é", LONG + "!")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, record_id string")


def test_round_trip(pages):
    found = warc.round_trip(pages)
    got = rows_of(found.columns, found.collect())
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    result = con.execute(warc.ORACLE.replace("nullif(url, '')", "nullif(replace(url, chr(13) || chr(10), '%0A'), '')"))
    assert got == rows_of([d[0] for d in result.description], result.fetchall())


def test_archives_hold_the_payloads(spark, pages, tmp_path):
    path = warc.write_archives(pages, str(tmp_path / "w"), file_bytes=2000)
    files = list((tmp_path / "w").glob("*.gz"))
    assert len(files) > 1
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert raw.count(b"WARC-Type: request\r\n") == len(PAGES)
    records = warc.read_records(spark, path).collect()
    assert len(records) == 3 * len(PAGES)
    held = Counter(r["payload"] for r in records if r["record_type"] == "response")
    assert held == Counter(["short", "short", "", "", PAGES[5][2], LONG, LONG + "!", LONG + "!"])
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(captures) == len(PAGES) and all(c["request"]["concurrent_to"] == c["capture_id"] == c["metadata"]["concurrent_to"] for c in captures)


def test_assembly_follows_either_pointer(spark):
    blank = (None,) * 7
    rows = [
        ("r1", "response", None, *blank, "a"), ("q1", "request", "r1", *blank, None), ("m1", "metadata", "q1", *blank, None), ("r2", "response", "q2", *blank, "b"), ("q2", "request", None, *blank, None),
        ("m2", "metadata", "q2", *blank, None), ("r3", "revisit", None, *blank, None), ("q9", "request", "gone", *blank, None), ("m9", "metadata", None, *blank, None), ("r1", "response", None, *blank, "a"),
    ]
    rows = [(*r[:10], r[10]) for r in rows]
    got = {(c["capture_id"], c["request"] and c["request"]["record_id"], c["metadata"] and c["metadata"]["record_id"]) for c in warc.assemble(spark.createDataFrame(rows, warc._RECORDS)).collect()}
    assert got == {("r1", "q1", "m1"), ("r2", "q2", "m2"), ("r3", None, None)}


def test_streams_are_cut_anywhere():
    record = lambda body: b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    bodies = [b"", b"\r\n\r\n", b"x" * 3000, b"WARC/1.1\r\n"]
    raw = b"".join(map(record, bodies))
    for step in (1, 7, 5000):
        assert [b for _, b in warc._cut(raw[i : i + step] for i in range(0, len(raw), step))] == bodies
    zipped = b"".join(gzip.compress(record(b)) for b in bodies)
    assert [b for _, b in warc._cut(warc._unzipped(zipped))] == bodies
    with pytest.raises(ValueError):
        list(warc._cut([raw[:-2500]]))


def test_no_pages(pages):
    assert warc.round_trip(pages.where("false")).count() == 0


def least_bins(items, capacity):
    """Fewest bins, by trying all ways to fill the bin of the largest item."""
    items = tuple(sorted(items, reverse=True))
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for n in range(min(len(rest), capacity) + 1):
        for chosen in set(combinations(rest, n)):
            if first + sum(chosen) <= capacity:
                left = list(rest)
                for x in chosen:
                    left.remove(x)
                best = min(best, 1 + least_bins(left, capacity))
    return best


def check_plan(counts, capacity):
    made, filled = packing.plan(counts, capacity), {}
    table = made.table()
    for length, n in counts.items():
        places = [(s + i // each, o + i % each * length) for x, first, count, s, each, o in sorted(table.tolist()) if x == length for i in range(count)]
        assert len(places) == n
        for s, o in places:
            filled.setdefault(s, []).append((o, length))
    for held in filled.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) == made.sequences and set(filled) == set(range(made.sequences))
    return made


def test_reduction_keeps_the_optimum():
    r = random.Random(1)
    for _ in range(120):
        capacity = r.choice([6, 9, 12])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 8))]
        made = packing.Plan(Counter(items), capacity)
        made.reduce()
        left = [x for x, n in enumerate(made.left) for _ in range(n)]
        assert made.sequences + least_bins(left, capacity) == least_bins(items, capacity)


def test_plans_are_valid():
    r = random.Random(2)
    for _ in range(150):
        capacity = r.choice([7, 20, 50])
        counts = {r.randint(1, capacity): r.randint(1, r.choice([3, 40])) for _ in range(r.randint(1, capacity))}
        check_plan(counts, capacity)
    assert check_plan({}, 10).sequences == 0 and check_plan({1: 10**6}, 2048).sequences == 489
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def check_packing(rows, docs, capacity):
    tokenizer, fill, seen = Tokenizer.from_file(tokenizer_path()), {}, {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r)
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in fill.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        start, piece = 0, 0
        while start < len(ids):
            length = (len(ids) - start) % capacity or capacity
            want[doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
            start, piece = start + length, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(fill)


def test_packing_of_odd_rows(spark, odd, none):
    rows = packing.pack_documents(odd, tokenizer_path(), with_ids=True).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    used = check_packing(rows, docs, 2048)
    assert used == -(-sum(r["length"] for r in rows) // 2048)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    encode, tokenizer = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ("", " ", "a  b", "a b", " a", "a ", "x\ny z", "it's we'll", "<|endoftext|> a", "a <|endoftext|>b", "é 😀 1 23", "a\0 b", "tab\t c", "a  b", "end. \nNext"):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'.,!0123aestllé\u3000\x1c\x85\xa0"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
def test_any_text_gives_the_tokenizers_ids(text):
    encode = packing.encoder(tokenizer_path())
    assert encode.fast and np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_whole_documents_give_the_tokenizers_ids(spark):
    encode = packing.encoder(tokenizer_path())
    for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        text = (row["text"] or "")[:20_000]
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_left_to_tokenizers():
    held = json.loads(Tokenizer.from_file(tokenizer_path()).to_str())
    assert len(packing.ranks_of(held)) == 50256
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**held["model"], "merges": held["model"]["merges"][1:]}}, {"model": {**held["model"], "dropout": 0.1}}):
        assert packing.ranks_of({**held, **change}) is None


def test_offsets_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(packing, "_BROADCAST_ROWS", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)
    rows = packing.pack_documents(docs, tokenizer_path(), with_ids=True).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_pipeline_keeps_the_tokens(spark, odd):
    rows = corpus_pipeline.STAGES[-1][1](spark, odd.where("doc_id in (1, 9)"), "").collect()
    assert rows and all(len(r["ids"]) == r["length"] for r in rows)


def test_pipeline(spark):
    """Stages one by one: what each may drop or change, and the last against brute force."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, folder), "stage")
        assert docs.dtypes == before.dtypes and 0 < docs.count() <= before.count()
        if name != "secret scans":
            assert docs.exceptAll(before).count() == 0
        else:
            assert docs.count() == before.count()
    rows = stored(corpus_pipeline.STAGES[-1][1](spark, docs, folder), "stage").collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)


