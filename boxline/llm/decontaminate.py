"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles, so that a short
item inside a long document is judged against the item's size and not against
the document's. Each partition has its own MinHash length: the k smallest
shingle hashes of an item, with k one more than the shingles that an item of the
partition's largest size can miss at the threshold. A document that holds
enough of an item therefore holds some of the item's MinHash values, and no
match is lost; documents with too few of them are not candidates. Candidates
are verified by the exact share of the item's shingles that the document holds.

The items are read in blocks of bounded size, each broadcast over all documents.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.llm.common import document_columns, text_of

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_WORDS = 500_000  # words of the items in one broadcast block, about

# Words are runs of letters, digits and characters beyond ASCII, in lower case.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = re.compile(_WORD)


def _may_miss(size: int, threshold: float) -> int:
    """Most shingles of an item that a matching document can lack."""
    most = size - math.ceil(threshold * size)
    while most > 0 and (size - most) / size < threshold:
        most -= 1
    while (size - most - 1) / size >= threshold:
        most += 1
    return most


def _hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` word numbers."""
    n = len(ids) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(length if n > 0 else 0):
        out = (out ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def make_index(items: list[tuple[int, str]], shingle: int = SHINGLE, threshold: float = THRESHOLD) -> dict:
    """Index of one block: the word numbers, and per shingle length the MinHash values with their items."""
    numbers: dict[str, int] = {}
    held = []
    for item_id, text in items:
        words = _WORDS.findall(text.lower())
        if words:
            ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.uint64)
            length = min(shingle, len(words))
            held.append((item_id, length, {tuple(ids[i : i + length].tolist()) for i in range(len(ids) - length + 1)}, np.unique(_hashes(ids, length))))
    largest: dict[int, int] = {}
    for _, _, grams, _ in held:
        part = len(grams).bit_length()
        largest[part] = max(largest.get(part, 0), len(grams))
    index = {"numbers": numbers, "threshold": threshold, "items": [], "lengths": {}}
    for item_id, length, grams, hashes in held:
        sketch = hashes[: _may_miss(largest[len(grams).bit_length()], threshold) + 1]
        # Equal hashes of different shingles shorten the list; then every hash is in the sketch or the bound only grows.
        least = max(1, len(sketch) - _may_miss(len(grams), threshold))
        index["lengths"].setdefault(length, []).append((len(index["items"]), sketch, hashes))
        index["items"].append((item_id, length, grams, least))
    for length, entries in index["lengths"].items():
        keys = np.concatenate([s for _, s, _ in entries])
        owners = np.concatenate([np.full(len(s), i) for i, s, _ in entries])
        order = np.argsort(keys, kind="stable")
        every = np.unique(np.concatenate([h for _, _, h in entries]))
        index["lengths"][length] = (keys[order], owners[order], every)
    return index


def matches(text: str, index: dict) -> list[tuple[int, int, int]]:
    """``item_id``, shared and own shingles of every item that the text holds."""
    get = index["numbers"].get
    ids = np.array([get(w, 0) for w in _WORDS.findall(text.lower())], np.uint64)
    found = []
    for length, (keys, owners, every) in index["lengths"].items():
        hashes = _hashes(ids, length)
        at = np.searchsorted(every, hashes)
        at[at == len(every)] = 0
        places = np.flatnonzero(every[at] == hashes)
        if not len(places):
            continue
        seen = np.unique(hashes[places])
        low, high = np.searchsorted(keys, seen), np.searchsorted(keys, seen, "right")
        hit = np.concatenate([owners[a:b] for a, b in zip(low, high)])
        candidates, counts = np.unique(hit, return_counts=True)
        grams = None
        for i, n in zip(candidates, counts):
            item_id, _, wanted, least = index["items"][int(i)]
            if n < least:
                continue
            if grams is None:
                grams = {tuple(ids[p : p + length].tolist()) for p in places}
            shared = len(wanted & grams)
            if shared / len(wanted) >= index["threshold"]:
                found.append((item_id, shared, len(wanted)))
    return found


def _blocks(benchmark: DataFrame, text: str, shingle: int, threshold: float):
    """Indexes over blocks of the items, each of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of(F.col(f"`{text}`")).alias("text"))
    words = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(words / (6 * BLOCK_WORDS)))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = make_index(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x)), shingle, threshold)
        if index["items"]:
            yield benchmark.sparkSession.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``item_id``, ``shared``, ``item_shingles`` and ``containment`` of every match at or over the threshold.

    Items of fewer words than a shingle match as one run of all their words;
    items without words, and null or empty texts, match nothing. Repeated rows
    and items give repeated matches; null ids stay null; empty tables give none.
    """
    schema = "doc_id long, item_id long, shared long, item_shingles long"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    out = None
    for shared in _blocks(benchmark, "text", shingle, threshold):

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in matches(t, index)]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "shared", "item_shingles"])

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Rows that hold no item, with all their columns. No shuffle."""
    kept = docs.select(F.struct(*document_columns(docs)).alias("_doc"))
    for shared in _blocks(benchmark, "text", shingle, threshold):

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                texts = batch.column(0).field(text).to_pylist()
                yield batch.filter(pa.array([not (t and matches(t, index)) for t in texts], pa.bool_()))

        kept = kept.mapInArrow(run, kept.schema)
    return kept.select(*(F.col("_doc").getField(name).alias(name) for name in docs.columns))


def oracle(threshold: float = THRESHOLD) -> str:
    words = f"regexp_extract_all(lower(coalesce(text, '')), '{_WORD}')"
    grams = "unnest([array_to_string(w[i:i + l - 1], ' ') FOR i IN range(1, len(w) - l + 2)])"
    return f"""WITH i AS MATERIALIZED (SELECT row_number() OVER () AS m, item_id, {words} AS w, least({SHINGLE}, len({words})) AS l FROM benchmark),
    ig AS MATERIALIZED (SELECT DISTINCT m, item_id, l, {grams} AS g FROM i WHERE l > 0),
    size AS (SELECT m, count(*) AS item_shingles FROM ig GROUP BY m),
    d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, {words} AS w FROM documents),
    dg AS MATERIALIZED (SELECT DISTINCT n, l, {grams} AS g FROM d, (SELECT DISTINCT l FROM ig) WHERE len(w) >= l),
    pairs AS (SELECT n, m, count(*) AS shared FROM dg JOIN ig USING (l, g) GROUP BY n, m)
    SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
    FROM pairs JOIN size USING (m) JOIN d USING (n) JOIN (SELECT m, item_id FROM i) USING (m) WHERE shared / item_shingles >= {threshold}"""
