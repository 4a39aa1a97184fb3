"""The conversation trie against a plain one."""

import hashlib
import random
import zlib

import duckdb
import pytest

from boxline.llm import trie
from compare import rows_of

KIND = "conv_id long, turn long, role string, text string, key string, depth string, at string, digest string"


def plain(rows) -> list:
    own: dict = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(conv_id, []).append(((turn is not None, turn or 0, digest), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members: dict = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in inside if len(rebuilt[c]) == len(node))))
        out.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), sum(len(n) == len(node) + 1 for n in below),
            sum(not any(m[:-1] == n for m in members if m) for n in below), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def random_rows(seed: int) -> list:
    r = random.Random(seed)
    texts = [None, "", "a", "ä\n", "long text " * 30]
    rows = [(c, t if r.random() > 0.1 else None, r.choice(["user", "assistant", None]), r.choice(texts[: r.choice([2, 5])])) for c in [*range(-3, 12), *range(100, 140), 250, 307] for t in range(r.randint(1, 9))]
    rows += [(c, t, "user", f"copy {t}") for c in range(400, 460) for t in range(7)]
    return rows + rows[:3] + [(None, 1, "user", "lost"), (None, None, None, None)]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_trie(spark, seed):
    rows = random_rows(seed)
    frame = spark.createDataFrame([(*r, "k", "d", "a", "g") for r in rows], KIND).repartition(5)
    found = trie.build(frame)
    wanted = rows_of(COLUMNS, plain(rows))
    assert rows_of(found.columns, found.collect()) == wanted
    con = duckdb.connect()
    con.register("conversations", frame.toArrow())
    result = con.execute(trie.oracle())
    assert rows_of([d[0] for d in result.description], result.fetchall()) == wanted


def test_long_end_lists_and_conversations(spark):
    rows = [(c, 0, "user", "hello") for c in range(6, 30_000, 3)] + [(1, t, "user", str(t)) for t in range(30_000)]
    got = {(r["depth"], r["conv_id"]): r for r in trie.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    own = {c for c in range(6, 30_000, 3)}
    ends: dict = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        ends.setdefault("hello" if h == 0 or c - c % 100 in own else "", []).append(c)
    first = min(ends["hello"])
    assert got[(1, first)]["n_convs"] == len(ends["hello"])
    assert got[(1, first)]["ends_sha256"] == hashlib.sha256(",".join(map(str, sorted(ends["hello"]))).encode()).hexdigest()
    assert max(d for d, _ in got) == 30_000 - zlib.crc32(b"1") % 6


def test_empty_table(spark):
    assert trie.build(spark.createDataFrame([], KIND)).count() == 0
