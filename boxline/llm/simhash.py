"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, components.

Equal fingerprints collapse first, so groups of copies cost one row. A
fingerprint is cut into ``blocks`` blocks; two within ``max_bits`` bits agree
on some ``blocks - max_bits`` of them, so every such choice is a join key.
Within a key, fingerprints at most ``max_bits`` apart share a midpoint that is
``max_bits / 2`` flips from both, and those around one midpoint are all linked
to each other. Joining on midpoints therefore finds every link with at most
1 + (free bits) rows a fingerprint and key, where pairing up a key's members
would take the square of a large group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.llm.common import document_columns, stored, text_of
from boxline.llm.components import connected

BITS = 64
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 if it has no words.

    Only A-Z are lower-cased and only ASCII white space parts words, which is
    what ``bytes`` methods do.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    if len(words) > shingle:
        spans = zip(starts, ends[shingle - 1 :].tolist())
    else:
        spans = [(0, len(line))]
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK]).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fingerprint`` (signed long) of each row; null text counts as empty."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["doc_id", "text_hash", "fingerprint"])

    whole = text_of(F.col(f"`{text}`"))
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(prints: DataFrame, max_bits: int = 2, blocks: int = 5) -> DataFrame:
    """Pairs ``a``, ``b`` of differing fingerprints whose components are those of all pairs within ``max_bits`` bits.

    ``prints`` has distinct longs in ``fingerprint``. Every pair given is itself
    within the distance; pairs left out are joined through those given.
    """
    if max_bits not in (0, 2):
        raise ValueError("max_bits is 0 or 2")
    cuts = np.linspace(0, BITS, blocks + 1).astype(int)
    spans = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(spans, blocks - max_bits)]
    keys = F.array(*(F.struct(F.lit(i).alias("k"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("block")) for i, m in enumerate(masks)))
    keyed = prints.select("fingerprint", F.explode(keys).alias("key")).select("fingerprint", "key.*")
    shared = keyed.groupBy("k", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = keyed.join(shared, ["k", "block"], "left_semi")

    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1)) for m in masks))
    around: Column = F.transform(flips.getItem(F.col("k")), lambda flip: F.col("fingerprint").bitwiseXOR(flip))
    midpoints = members.select("fingerprint", F.explode(around).alias("midpoint"))
    # At most 1 + BITS fingerprints are one flip from a midpoint, so the sets are bounded.
    near = midpoints.groupBy("midpoint").agg(F.collect_set("fingerprint").alias("near")).where(F.size("near") > 1)
    pairs = near.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct()


def rooted(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """``fingerprint`` and the fingerprint ``root`` of its component, for each distinct one of ``prints``."""
    distinct = prints.select("fingerprint").distinct()
    roots = connected(links(distinct, max_bits))
    return distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hex) and ``component_id``.

    ``component_id`` is the smallest id of the documents reachable over links.
    Null and empty texts have fingerprint zero and are linked like any other;
    null ids take part but never name a component unless all its ids are null;
    repeated rows stay; an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, text, shingle=shingle), "fingerprints")
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    roots = rooted(prints, max_bits).join(first, "fingerprint")
    named = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = roots.select("fingerprint", "root").join(named, "root").drop("root")
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return prints.join(labels, "fingerprint").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Documents of which one, that with the smallest id, stays of each component.

    Of several rows with that id the one with the smallest text hash stays, of
    equal rows any one. Rows keep all their columns.
    """
    prints = stored(fingerprints(docs, text, shingle=shingle), "fingerprints")
    rows = prints.groupBy("doc_id", "text_hash", "fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "copies")
    best = rows.join(rooted(prints, max_bits), "fingerprint").groupBy("root").agg(F.min(order).alias("best"))
    best = best.select(F.col("best.doc_id").alias("_id"), F.col("best.text_hash").alias("_hash"), F.col("best.copies").alias("_copies"))
    packed = docs.select(F.struct(*document_columns(docs)).alias("_doc"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("_hash"), F.col("doc_id").cast("long").alias("_id"))
    kept = packed.join(best, packed["_id"].eqNullSafe(best["_id"]) & (packed["_hash"] == best["_hash"])).select("_doc", packed["_id"], packed["_hash"], "_copies")
    single = kept.where("_copies = 1").select("_doc")
    repeated = kept.where("_copies > 1").dropDuplicates(["_id", "_hash"]).select("_doc")
    out = single.unionByName(repeated)
    return out.select(*(F.col("_doc").getField(name).alias(name) for name in docs.columns))
