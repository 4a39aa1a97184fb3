"""SimHash near-duplicates and repeated substrings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from boxline.llm import simhash, substrings
from boxline.llm.components import connected


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(500, x) for x in range(501, 540)] + [(-5, -5)]
    got = {x["node"]: x["root"] for x in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    want = closure([e for e in edges if e[0] != e[1]], linked)
    assert got == {node: root for node, root in want.items() if node != root}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("max_bits", [0, 2])
def test_links_give_all_components(spark, max_bits):
    r = random.Random(4)
    prints = {0, 1, 3, 7, (1 << 64) - 1}
    for _ in range(25):
        at = r.getrandbits(64)
        for _ in range(12):
            prints.add(at)
            for _ in range(r.randint(1, 3)):
                at ^= 1 << r.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    found = [(x["a"], x["b"]) for x in simhash.links(frame, max_bits).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= max_bits for a, b in found)
    close = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= max_bits]
    assert closure(found, signed) == closure(close, signed)
    roots = {x["fingerprint"]: x["root"] for x in simhash.rooted(frame, max_bits).collect()}
    assert roots == closure(close, signed)


def test_near_duplicates_on_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    texts = {(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()}
    assert {(r["doc_id"], int(r["fingerprint"], 16)) for r in rows} == texts and len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["fingerprint"], set()).add(r["component_id"])
    assert all(len(c) == 1 for c in by.values())
    zero = [r for r in rows if int(r["fingerprint"], 16) == 0]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {2}
    assert simhash.near_duplicates(none).count() == 0


def test_one_stays(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 5, None, 8, 9, -7])
    assert simhash.keep_one(none).count() == 0


def plain_removal(rows, least, keep_first):
    counts, seen, out = Counter(), set(), []
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        counts.update(b[i : i + least] for i in range(len(b) - least + 1))
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            w = b[i : i + least]
            if counts[w] > 1 and not (keep_first and w not in seen):
                gone[i : i + least] = b"\1" * least
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def repeats():
    r = random.Random(5)
    base = "".join(r.choice("abcde fgé\n") for _ in range(3000))
    rows = []
    for i in range(40):
        text = "".join(r.choice("abcde fgé\n") for _ in range(r.randint(0, 400)))
        for _ in range(r.randint(0, 4)):
            a = r.randint(0, 2900)
            text += base[a : a + r.randint(20, 200)] + r.choice(["", "x", "yy"])
        rows.append((i, text))
    return rows + [(100, "a" * 500), (101, None), (102, ""), (103, "ab" * 200), (104, base), (105, base), (106, base[:1500] + "Q" + base[1501:])]


@pytest.mark.parametrize(("least", "crowded", "keep_first"), [(40, 2000, False), (40, 2000, True), (40, 1, False), (64, 1, True)])
def test_removal(spark, repeats, least, crowded, keep_first):
    docs = spark.createDataFrame(repeats, "doc_id long, text string")
    got = substrings.remove_repeats(docs, keep_first=keep_first, least=least, gram=16, crowded=crowded)
    assert sorted(map(tuple, got.collect()), key=str) == plain_removal(repeats, least, keep_first)


def test_removal_on_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, substrings.remove_repeats(odd, keep_first=False).collect()), key=str) == plain_removal(rows, 200, False)
    assert substrings.remove_repeats(none).count() == 0


def test_previous_factors():
    r = random.Random(7)
    for _ in range(50):
        text = "".join(r.choice("ab") for _ in range(60))
        order = sorted(range(60), key=lambda i: text[i:])
        share = lambda i, j: next((k for k in range(60) if max(i, j) + k >= 60 or text[i + k] != text[j + k]), 60)
        lcp = np.array([0] + [share(a, b) for a, b in zip(order, order[1:])])
        found = substrings.previous_factors(np.array(order), lcp, 4)
        for at, i in enumerate(order):
            best = max((share(i, j) for j in range(i)), default=0)
            assert (found[at] >= 0) == (best >= 4)
            if found[at] >= 0:
                assert order[found[at]] < i and share(i, order[found[at]]) >= 4


def test_long_texts_are_cut_into_stretches(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    whole = substrings.segments(data, substrings.Powers(), 100, 16)
    monkeypatch.setattr(substrings, "_STRETCH", 700)
    parts = substrings.segments(data, substrings.Powers(), 100, 16)
    cover = lambda s: [k for k, n in zip(s[0].tolist(), s[3].tolist()) for _ in range(n)]
    assert cover(whole) == cover(parts)
