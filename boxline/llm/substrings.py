"""Repeated-substring removal with longest-previous-factor arrays.

A byte goes if it lies in a string of ``least`` bytes that also starts somewhere
else. All such strings are windows of ``least`` bytes, and every window is keyed
by the smallest hash of the ``GRAM``-byte grams in it, so that equal windows,
wherever they stand, have equal keys. Consecutive windows of one key and anchor
form a segment; a text of n bytes has about n / 85 of them, and only they are
shuffled, as hashes.

Segments whose key occurs once hold no repeat. If all segments of a key have the
same bytes, every window of theirs is repeated. What is left are keys with
differing segments, near the edges of copies. One copy of each differing segment
goes to the task of its key, where its windows are sorted as suffixes; in suffix
order the nearest smaller positions before and after a window are its longest
earlier matches. Keys with very many differing segments are not gathered:
their windows are counted by 128-bit digests instead, which no key can make
large for one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.llm.common import stored, text_of

LEAST = 200
GRAM = 32
CROWDED = 2000  # differing segments of a key from which they are counted by digests
_BLOCK = 60_000  # windows sorted at a time, about
_STRETCH = 1 << 22  # bytes of a text hashed at a time
_LOW = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = [_mix(np.arange(1 + 256 * i, 257 + 256 * i, dtype=np.uint64) * np.uint64(_BASE)) for i in range(2)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self):
        self.n, self.up, self.down = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            self.up, self.down = _powers(_BASE, self.n), _powers(_BASE_INVERSE, self.n)
        return self.up[:n], self.down[:n]


def _range_hashes(data: np.ndarray, low: np.ndarray, high: np.ndarray, table: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the bytes from ``low`` to ``high`` (end excluded) of each pair, whatever stands around them."""
    _, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * down[:-1], out=sums[1:])
    up = powers.up
    return _mix((sums[high] - sums[low]) * up[low] + (high - low).astype(np.uint64) * np.uint64(_BASE))


def segments(data: np.ndarray, powers: Powers, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Key, hash of the bytes, first window and number of windows of each segment of a text."""
    parts = []
    for at in range(0, len(data) - least + 1, _STRETCH):
        parts.append(_segments(data[at : at + _STRETCH + least - 1], powers, least, gram, at))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _segments(data: np.ndarray, powers: Powers, least: int, gram: int, offset: int) -> tuple[np.ndarray, ...]:
    h, width, base = _BYTES[0][data], 1, _BASE
    while width < gram:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), 2 * width
    h = _mix(h)
    # The place fills the low bits, so that the leftmost of equal hashes is the smallest.
    m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, wanted = 1, least - gram + 1
    while 2 * width <= wanted:
        m, width = np.minimum(m[:-width], m[width:]), 2 * width
    if width < wanted:
        m = np.minimum(m[: len(m) - (wanted - width)], m[wanted - width :])
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    count = np.diff(np.append(first, len(m)))
    keys = h[(m[first] & _LOW).astype(np.int64)]
    inner = _range_hashes(data, first, first + count + least - 1, _BYTES[1], powers)
    return keys.view(np.int64), inner.view(np.int64), first + offset, count


def previous_factors(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Index of an earlier match of at least ``least`` for each suffix, -1 if none.

    ``position`` has the places of suffixes in suffix order, ``lcp[i]`` what
    suffix i shares with the one before. Of the nearest smaller positions before
    and after a suffix, the longer match is its longest previous factor; both
    are found by jumping over larger positions and end where less is shared.
    """
    n = len(position)
    out = np.full(n, -1)
    run = np.cumsum(lcp < least)
    for step in (-1, 1):
        near = np.arange(n) + step
        near[(near < 0) | (near >= n)] = -1
        near[(near >= 0) & (run[near] != run)] = -1
        while True:
            larger = np.flatnonzero((near >= 0) & (position[near] > position))
            if not len(larger):
                break
            near[larger] = near[near[larger]]
        out = np.where(out < 0, near, out)
    return out


def repeated_windows(contexts: list[bytes], counts: np.ndarray, position: np.ndarray, keep_first: bool, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Context and offset of every window that is repeated among the contexts' windows.

    ``position`` gives each context's place; windows of one context follow it in
    order. With ``keep_first`` the earliest of equal windows is left out.
    """
    owner = np.repeat(np.arange(len(contexts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    joined = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.cumsum([0, *(len(c) for c in contexts[:-1])])
    starts = base[owner] + within
    windows = np.lib.stride_tricks.sliding_window_view(joined, least)[starts]
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{least}").ravel(), kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.where(same.all(axis=1), least, same.argmin(axis=1)) if len(order) > 1 else 0
    place = np.lexsort((within, position[owner]))
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    source = previous_factors(rank[order], lcp, least)
    later = source >= 0
    hit = later.copy()
    if not keep_first:
        hit[source[later]] = True
    found = np.sort(order[hit])
    return owner[found], within[found]


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as disjoint ranges that don't touch, in order."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order]) if len(high) else high
    new = np.concatenate([[True], low[1:] > high[:-1]]) if len(low) else np.empty(0, bool)
    ends = np.append(np.flatnonzero(new)[1:], len(low)) - 1 if len(low) else np.empty(0, int)
    return low[new], high[ends]


def _outcome(data: bytes, low: np.ndarray, high: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, spans and digest of what is kept."""
    low, high = merged(low, high)
    digest, at = hashlib.sha256(), 0
    for a, b in zip(low.tolist(), high.tolist()):
        digest.update(data[at:a])
        at = b
    digest.update(data[at:])
    return int((high - low).sum()), len(low), digest.hexdigest()


def _bytes_of(column: str) -> Column:
    return text_of(F.col(f"`{column}`")).cast("binary")


_KEY = ["doc_id", "text_hash"]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("text_hash"), _bytes_of(text).alias("data"))


def _segment_rows(keyed: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches):
        powers = Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows, found = batch.slice(at, 500), [], []
                for i, data in enumerate(part.column(2)):
                    made = segments(np.frombuffer(data.as_buffer(), np.uint8), powers, least, gram)
                    rows.append(np.full(len(made[0]), i))
                    found.append(made)
                index = pa.array(np.concatenate(rows))
                columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), *columns], ["doc_id", "text_hash", "key", "inner", "lo", "n"])

    return keyed.mapInArrow(run, "doc_id long, text_hash long, key long, inner long, lo long, n long")


def _marks(found: DataFrame, keep_first: bool, crowded: int) -> DataFrame:
    """What is known of each segment whose key is repeated, by document."""
    place = F.struct("doc_id", "text_hash", "lo")
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("c"), (F.min("inner") != F.max("inner")).alias("mixed"), *([F.min(place).alias("first")] if keep_first else []))
    hits = stored(found.join(keys.where("c > 1").drop("c"), "key"), "segments")
    later = (~place.eqNullSafe(F.col("first"))) if keep_first else F.lit(True)
    no = F.lit(False)
    pure = hits.where("not mixed").select(*_KEY, F.struct("lo", "n", "key", later.alias("covered"), no.alias("supply"), no.alias("open"), no.alias("crowded")).alias("mark"))
    mixed = hits.where("mixed").drop("mixed", "first")
    classes = mixed.groupBy("key", "inner").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("rep"))
    sizes = classes.groupBy("key").agg((F.count(F.lit(1)) > crowded).alias("crowded"))
    judged = mixed.join(classes.join(sizes, "key"), ["key", "inner"])
    is_rep = place.eqNullSafe(F.col("rep"))
    covered = (F.col("c") > 1) & (~is_rep if keep_first else F.lit(True))
    rest = judged.select(*_KEY, F.struct("lo", "n", "key", covered.alias("covered"), is_rep.alias("supply"), (is_rep & ~covered).alias("open"), "crowded").alias("mark"))
    # A list holds the segments of one text at most; repeated rows share theirs.
    return pure.unionByName(rest).groupBy(*_KEY).agg(F.collect_set("mark").alias("marks"))


_FIRST = (
    "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, open boolean, packed binary, low array<long>, high array<long>, "
    "contexts array<struct<key:long,crowded:boolean,lo:long,n:long,data:binary>>"
)


def _first_pass(joined: DataFrame, least: int) -> DataFrame:
    """Outcome of texts that are settled; packed text and ranges so far of the others; bytes of segments to be sorted."""
    names = [c.split()[0] for c in _FIRST.split(", ") if not c.startswith("contexts")] + ["contexts"]
    context = pa.struct([("key", pa.int64()), ("crowded", pa.bool_()), ("lo", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
    kinds = [pa.int64()] * 5 + [pa.string(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(context)]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                rows = []
                for doc_id, text_hash, packed, marks in zip(*(c.to_pylist() for c in batch.slice(at, 300).columns)):
                    data, marks = unpack.decompress(packed), marks or []
                    covered = [(m["lo"], m["lo"] + m["n"] + least - 1) for m in marks if m["covered"]]
                    low, high = (np.array(x, np.int64) for x in (zip(*covered) if covered else ((), ())))
                    contexts = [{"key": m["key"], "crowded": m["crowded"], "lo": m["lo"], "n": m["n"], "data": data[m["lo"] : m["lo"] + m["n"] + least - 1]} for m in marks if m["supply"]]
                    if any(m["open"] for m in marks):
                        low, high = merged(low, high)
                        rows.append((doc_id, text_hash, len(data), None, None, None, True, packed, low.tolist(), high.tolist(), contexts))
                    else:
                        rows.append((doc_id, text_hash, len(data), *_outcome(data, low, high), False, None, None, None, contexts))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return joined.mapInArrow(run, _FIRST)


_FOUND = "doc_id long, text_hash long, lo long, n long"


def _sorted_matches(contexts: DataFrame, keep_first: bool, least: int) -> DataFrame:
    """Repeated windows of keys with few differing segments: runs of windows by document."""

    def settle(rows: list[dict]):
        counts = np.array([r["n"] for r in rows])
        order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, rows[i]["text_hash"], rows[i]["lo"]))
        position = np.empty(len(rows), np.int64)
        position[order] = np.arange(len(rows))
        owner, within = repeated_windows([r["data"] for r in rows], counts, position, keep_first, least)
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (within[1:] != within[:-1] + 1)])) if len(owner) else np.empty(0, int)
        sizes = np.diff(np.append(new, len(owner)))
        found = [(rows[o]["doc_id"], rows[o]["text_hash"], rows[o]["lo"] + w, s) for o, w, s in zip(owner[new].tolist(), within[new].tolist(), sizes.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*found) if found else [()] * 4)], [c.split()[0] for c in _FOUND.split(", ")])

    def run(batches):
        # Rows come by key; a block ends between two keys.
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= _BLOCK and row["key"] != held[-1]["key"]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += row["n"]
        if held:
            yield settle(held)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, _FOUND)


def _counted_matches(contexts: DataFrame, keep_first: bool, least: int) -> DataFrame:
    """Repeated windows of crowded keys, by two 64-bit digests of each window."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            for row in batch.to_pylist():
                data, low = np.frombuffer(row["data"], np.uint8), np.arange(row["n"])
                one, two = (_range_hashes(data, low, low + least, t, powers).view(np.int64) for t in _BYTES)
                same = lambda x: pa.array([x] * row["n"], pa.int64())
                yield pa.RecordBatch.from_arrays([same(row["doc_id"]), same(row["text_hash"]), pa.array(low + row["lo"]), pa.array(one), pa.array(two)], ["doc_id", "text_hash", "lo", "one", "two"])

    windows = contexts.mapInArrow(run, "doc_id long, text_hash long, lo long, one long, two long")
    place = F.struct("doc_id", "text_hash", "lo")
    repeated = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first")).where("c > 1").drop("c")
    found = windows.join(repeated, ["one", "two"])
    if keep_first:
        found = found.where(~place.eqNullSafe(F.col("first")))
    return found.select(*_KEY, "lo", F.lit(1).cast("long").alias("n"))


_LAST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, text: str = "text", keep_first: bool = True, least: int = LEAST, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """Per document ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of its UTF-8 bytes.

    With ``keep_first`` the first of equal strings stays (the smallest document
    id, then text hash, then place), else every copy goes. Matches are judged on
    the input and never cross documents; overlapping ones count. Null text
    counts as empty; texts under ``least`` bytes lose nothing. Rows that agree in
    id and text are copies of each other and get the same result. An empty table
    gives an empty result.
    """
    keyed = _keyed(docs, text)
    marks = _marks(_segment_rows(keyed, least, gram), keep_first, crowded)

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packer.compress(d) for d in batch.column(2).to_pylist()], pa.binary())], [*_KEY, "packed"])

    packed = keyed.mapInArrow(pack, "doc_id long, text_hash long, packed binary").alias("p")
    held = marks.alias("m")
    joined = packed.join(held, F.col("p.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("p.text_hash") == F.col("m.text_hash")), "left").select("p.*", "m.marks")
    first = stored(_first_pass(joined, least), "first-pass")

    contexts = first.select(*_KEY, F.explode("contexts").alias("c")).select(*_KEY, "c.*").dropDuplicates([*_KEY, "lo"])
    found = _sorted_matches(contexts.where("not crowded"), keep_first, least).unionByName(_counted_matches(contexts.where("crowded"), keep_first, least))
    lists = found.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "n")).alias("found")).alias("f")
    opened = first.where("open").select(*_KEY, "n_bytes", "packed", "low", "high").alias("o")
    again = opened.join(lists, F.col("o.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("o.text_hash") == F.col("f.text_hash")), "left").select("o.doc_id", "n_bytes", "packed", "low", "high", "found")

    def finish(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                rows = []
                for doc_id, n_bytes, packed, low, high, found in zip(*(c.to_pylist() for c in batch.slice(at, 300).columns)):
                    extra = [(x["lo"], x["lo"] + x["n"] + least - 1) for x in found or ()]
                    low, high = np.array([*low, *(a for a, _ in extra)], np.int64), np.array([*high, *(b for _, b in extra)], np.int64)
                    rows.append((doc_id, n_bytes, *_outcome(unpack.decompress(packed), low, high)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])], [c.split()[0] for c in _LAST.split(", ")])

    settled = first.where("not open").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return settled.unionByName(again.mapInArrow(finish, _LAST))
