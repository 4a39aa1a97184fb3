"""Merkle dataset manifest in van Emde Boas layout.

Leaves are digests of rows; each source's leaves, ascending by id, make a
ternary tree, and the sources' roots make one more. A tree is stored as blocks:
aligned subtrees of up to ``EDGES`` levels, one row each, whose digests lie in van
Emde Boas order: a subtree is split at half its height into a top and its
bottom subtrees, each stored in one run and split again. The same rule over
whole blocks numbers the blocks of a tree. Addresses are arithmetic on depth
and place alone, for construction and for reading siblings.

Construction recurses over block roots: blocks over the leaves are built side
by side, their roots are the leaves of the next layer, and so on until each
tree has one root. A block holds at most ``3 ** EDGES`` leaves, so no task ever sees a
whole source. Paths go the other way: a block hands the siblings above its root
down to the blocks below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxline.llm.common import crc32_sql, stored

FANOUT = 3
EDGES = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BLOCK = "tree string, layer int, block long, blocks long, address long, edges int, n int, nodes binary, root binary"


def address(height: int, depth: int, place: int, fanout: int = FANOUT) -> int:
    """Place of a node, ``place``-th from the left of its depth, in the van Emde Boas layout of a full tree of ``height`` levels."""
    at = 0
    while height > 1:
        top = height // 2
        if depth < top:
            height = top
            continue
        under, bottom = fanout ** (depth - top), height - top
        at += _nodes(top, fanout) + place // under * _nodes(bottom, fanout)
        depth, place, height = depth - top, place % under, bottom
    return at


def _nodes(height: int, fanout: int) -> int:
    return (fanout**height - 1) // (fanout - 1)


_TABLES: dict[int, list[list[int]]] = {}


def _places(edges: int) -> list[list[int]]:
    """Addresses inside a block of ``edges`` levels above its leaves, by level from the leaves up."""
    if edges not in _TABLES:
        _TABLES[edges] = [[address(edges + 1, edges - level, i) for i in range(FANOUT ** (edges - level))] for level in range(edges + 1)]
    return _TABLES[edges]


def _parent(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def layers_of(n: int) -> int:
    """Layers of blocks above ``n`` leaves."""
    layers, size = 1, FANOUT**EDGES
    while n > size:
        n, layers = -(-n // size), layers + 1
    return layers


def build_block(leaves: list[bytes], edges: int) -> bytes:
    """Digests of a subtree over up to ``3 ** edges`` leaves, at their addresses; places without a node are zero."""
    places, level = _places(edges), leaves
    nodes = bytearray(32 * _nodes(edges + 1, FANOUT))
    for up in range(edges + 1):
        for at, digest in zip(places[up], level):
            nodes[32 * at : 32 * at + 32] = digest
        level = [_parent(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)] if up < edges else []
    return bytes(nodes)


def siblings(nodes: bytes, edges: int, n: int, leaf: int) -> Iterator[tuple[int, list[bytes]]]:
    """For each level of a block from ``leaf`` up: the node's place in its run, and the run's other digests."""
    places = _places(edges)
    for level in range(edges):
        first = leaf - leaf % FANOUT
        yield leaf - first, [nodes[32 * places[level][i] :][:32] for i in range(first, min(first + FANOUT, n)) if i != leaf]
        leaf, n = leaf // FANOUT, -(-n // FANOUT)


def _pack(path) -> bytes:
    return b"".join(bytes([place, len(others)]) + b"".join(others) for place, others in path)


def _unpack(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        place, count = path[at], path[at + 1]
        yield place, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(count)]
        at += 2 + 32 * count


def fold(digest: bytes, path) -> bytes:
    """Root that a leaf and the siblings along its path give."""
    for place, others in path:
        digest = _parent([*others[:place], digest, *others[place:]])
    return digest


def leaf(fields: dict[str, Column]) -> Column:
    """Digest (binary) of fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [c.cast("string") for c in fields.values()]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0, in its ``tree``, by ``order``) and ``n`` (leaves of the tree).

    Rows are dealt by ranges of tree and order, so that a large tree is spread;
    rows of a partition are counted as they stream by, and the counts of the
    partitions before are added. The partitions are written, so the counts hold.
    """
    names = leaves.columns

    def count(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            places = []
            for tree in batch.column(names.index("tree")).to_pylist():
                place = seen.get(tree, -1) + 1
                if len(seen) > 1000:
                    seen = {}  # trees come one after another
                seen[tree] = place
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())], [*names, "part", "place"])

    dealt = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    counted = stored(dealt.mapInArrow(count, T.StructType([*dealt.schema.fields, T.StructField("part", T.LongType()), T.StructField("place", T.LongType())])), "ranked")
    parts = counted.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return counted.join(offsets, ["tree", "part"]).withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "before")


def _layer(leaves: DataFrame, layer: int) -> DataFrame:
    """Blocks over leaves (``tree``, ``rank``, ``n``, ``digest``)."""
    size = FANOUT**EDGES

    def build(table: pa.Table) -> pa.Table:
        tree, n, first = table["tree"][0].as_py(), table["n"][0].as_py(), table["rank"][0].as_py() // size
        held = [d for _, d in sorted(zip(table["rank"].to_pylist(), table["digest"].to_pylist()))]
        above = layers_of(n)  # layers from here to the root
        edges = EDGES
        if above == 1:
            edges = next(e for e in range(EDGES + 1) if FANOUT**e >= n)
        nodes = build_block(held, edges)
        at = address(above + layer, above - 1, first, size) * _nodes(EDGES + 1, FANOUT)
        return pa.Table.from_pydict(
            {"tree": [tree], "layer": [layer], "block": [first], "blocks": [-(-n // size)], "address": [at], "edges": [edges], "n": [len(held)], "nodes": [nodes], "root": [nodes[32 * _places(edges)[edges][0] :][:32]]},
            schema=pa.schema([("tree", pa.string()), ("layer", pa.int32()), ("block", pa.int64()), ("blocks", pa.int64()), ("address", pa.int64()), ("edges", pa.int32()), ("n", pa.int32()), ("nodes", pa.binary()), ("root", pa.binary())]),
        )

    keyed = leaves.select("tree", "rank", "n", "digest", F.expr(f"rank div {size}").alias("block"))
    return keyed.groupBy("tree", "block").applyInArrow(build, _BLOCK)


def build(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Stored layers of blocks from the leaves up; trees end in the layer where they have one block."""
    layers, current = [], leaves
    while True:
        layers.append(stored(_layer(current, len(layers)), f"{name}-{len(layers)}"))
        current = layers[-1].where("blocks > 1").select("tree", F.col("block").alias("rank"), F.col("blocks").alias("n"), F.col("root").alias("digest"))
        if current.isEmpty():
            return layers


def roots(layers: list[DataFrame]) -> DataFrame:
    """``tree`` and its root ``digest``."""
    found = [layer.where("blocks = 1").select("tree", F.col("root").alias("digest")) for layer in layers]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _paths(table: pa.Table, wanted: list[int]) -> list[bytes]:
    """Packed siblings of leaves of one stored block, and the siblings above its root."""
    edges, n, nodes, above = (table[c][0].as_py() for c in ("edges", "n", "nodes", "above"))
    return [_pack(siblings(nodes, edges, n, at)) + above for at in wanted]


def lowered(layers: list[DataFrame], above: DataFrame) -> DataFrame:
    """Blocks over the leaves with ``above``: the packed siblings from their roots to the root of everything.

    ``above`` has that of each tree's root. Layers are read from the top down.
    """
    size = FANOUT**EDGES
    names = ["tree", "block", "edges", "n", "nodes"]
    kind = "tree string, block long, above binary"

    def hand_down(upper: pa.Table, lower: pa.Table) -> pa.Table:
        if not upper.num_rows or not lower.num_rows:
            return pa.Table.from_pydict({"tree": [], "block": [], "above": []}, schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("above", pa.binary())]))
        block = lower["block"].to_pylist()
        return pa.Table.from_pydict({"tree": lower["tree"].to_pylist(), "block": block, "above": _paths(upper, [b % size for b in block])}, schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("above", pa.binary())]))

    known = None
    for layer in reversed(layers):
        tops = layer.where("blocks = 1").select(*names).join(above, "tree")
        if known is not None:
            under = layer.where("blocks > 1").select("tree", "block", F.expr(f"block div {size}").alias("upper"))
            found = known.groupBy("tree", "block").cogroup(under.groupBy("tree", "upper")).applyInArrow(hand_down, kind)
            tops = tops.unionByName(layer.where("blocks > 1").select(*names).join(found, ["tree", "block"]))
        known = stored(tops, "lowered")
    return known


def manifest(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", fields: tuple = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per document with its proof: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``, ``source``, ``rank``.

    ``changed`` replaces fields by tampered values; ``folded_root`` is what the
    tampered leaf and the stored siblings give. Leaves go by id (null first, then
    by digest), sources bytewise, null first. Null fields count as ``-``; equal
    rows are leaves side by side; an empty table has no leaf and gives no rows.
    """
    size = FANOUT**EDGES
    plain = {f: F.col(f"`{f}`") for f in fields}
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("-"))
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), tree.alias("tree"), leaf(plain).alias("digest"), leaf({**plain, **(changed or {})}).alias("tampered"))
    rows = stored(ranked(stored(slim, "leaves"), ["doc_id", "digest"]), "leaves-ranked")
    blocks = build(rows, "blocks")
    subroots = roots(blocks)
    tops = stored(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"]), "subroots")
    crown = build(tops, "crown")
    root = roots(crown).first()  # one row, or none for an empty table
    root = F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root")

    def paths_of_trees(block: pa.Table, held: pa.Table) -> pa.Table:
        kind = pa.schema([("tree", pa.string()), ("subroot", pa.binary()), ("above", pa.binary())])
        if not held.num_rows:
            return kind.empty_table()
        return pa.Table.from_pydict({"tree": held["source"].to_pylist(), "subroot": held["digest"].to_pylist(), "above": _paths(block, [r % size for r in held["rank"].to_pylist()])}, schema=kind)

    low = lowered(crown, roots(crown).select("tree", F.lit(b"").cast("binary").alias("above")))
    keyed = tops.withColumn("block", F.expr(f"rank div {size}"))
    above = stored(low.groupBy("tree", "block").cogroup(keyed.groupBy("tree", "block")).applyInArrow(paths_of_trees, "tree string, subroot binary, above binary"), "above")
    bottom = lowered(blocks, above.select("tree", "above")).join(above.select("tree", "subroot"), "tree").select("*", root)

    def prove(block: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")}
        if held.num_rows:
            subroot, top = block["subroot"][0].as_py().hex(), block["root"][0].as_py().hex()
            tampered = held["tampered"].to_pylist()
            for digest, other, path in zip(held["digest"].to_pylist(), tampered, _paths(block, [r % size for r in held["rank"].to_pylist()])):
                steps = list(_unpack(path))
                out["leaf"].append(digest.hex())
                out["proof_sha256"].append(hashlib.sha256(b"".join(o.hex().encode() for _, others in steps for o in others)).hexdigest())
                out["folded_root"].append(fold(other, steps).hex())
            out["subroot"], out["root"] = [subroot] * held.num_rows, [top] * held.num_rows
        ids = pa.array(held["doc_id"].to_pylist(), pa.int64())
        return pa.Table.from_arrays([ids, *(pa.array(v, pa.string()) for v in out.values()), pa.array(held["tree"].to_pylist(), pa.string()), pa.array(held["rank"].to_pylist(), pa.int64())], ["doc_id", *out, "tree", "rank"])

    keyed = rows.withColumn("block", F.expr(f"rank div {size}"))
    below = bottom.select("tree", "block", "edges", "n", "nodes", "above", "subroot", "root")
    proven = below.groupBy("tree", "block").cogroup(keyed.groupBy("tree", "block")).applyInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, tree string, rank long")
    return proven.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30)).alias("source"), "rank")


LEVELS = 24  # levels that the SQL spells out: 3 ** 24 leaves of a tree


def _levels_sql(name: str) -> str:
    up = ", ".join(
        f"{name}{k + 1} AS (SELECT tree, {k + 1} AS level, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (n + 2) // 3 AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, i // 3, n)" for k in range(LEVELS)
    )
    return f"{up}, {name} AS ({' UNION ALL '.join(f'SELECT * FROM {name}{k}' for k in range(LEVELS + 1))})"


def oracle() -> str:
    """DuckDB SQL for the manifest of ``documents`` whose rows with an even CRC-32 of the id lose their line breaks."""

    def digest(text: str) -> str:
        fields = [f"{c}::VARCHAR" for c in FIELDS[:-1]] + [text]
        return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f}))::VARCHAR || ':' || {f} END" for f in fields) + ")"

    even = f"doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % 2 = 0"
    return f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || source, '-') AS tree, {digest("text")} AS leaf, {digest(f"CASE WHEN {even} THEN replace(text, chr(10), '') ELSE text END")} AS tampered FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), low0 AS (SELECT tree, 0 AS level, i, leaf AS h, n FROM placed),
{_levels_sql("low")}, subroots AS (
    SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1
), top0 AS (SELECT '' AS tree, 0 AS level, i, h, n FROM subroots),
{_levels_sql("top")}, steps AS (
    SELECT d.tree, d.i, s.level AS step, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < d.i // (3 ** s.level)::BIGINT), '') AS before, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > d.i // (3 ** s.level)::BIGINT), '') AS after
    FROM placed d JOIN low s ON s.tree = d.tree AND s.n > 1 AND s.i // 3 = d.i // (3 ** (s.level + 1))::BIGINT GROUP BY ALL
), top_steps AS (
    SELECT d.tree, s.level AS step, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < d.i // (3 ** s.level)::BIGINT), '') AS before, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > d.i // (3 ** s.level)::BIGINT), '') AS after
    FROM subroots d JOIN top s ON s.n > 1 AND s.i // 3 = d.i // (3 ** (s.level + 1))::BIGINT GROUP BY ALL
), path AS (
    SELECT tree, i, before, after, row_number() OVER (PARTITION BY tree, i ORDER BY step) AS step FROM (
        SELECT * FROM steps UNION ALL SELECT p.tree, p.i, 1000 + t.step, t.before, t.after FROM placed p JOIN top_steps t USING (tree))
), folded AS (
    SELECT tree, i, 0::BIGINT AS step, tampered AS h FROM placed
    UNION ALL SELECT f.tree, f.i, p.step, sha256(p.before || f.h || p.after) FROM folded f JOIN path p ON p.tree = f.tree AND p.i = f.i AND p.step = f.step + 1
), ends AS (SELECT tree, i, arg_max(h, step) AS h FROM folded GROUP BY tree, i),
proofs AS (SELECT tree, i, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM path GROUP BY tree, i)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(f.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified, nullif(substr(p.tree, 2), CASE WHEN p.tree = '-' THEN '' END) AS source, p.i AS rank
FROM placed p JOIN (SELECT tree, h FROM subroots) s USING (tree) JOIN ends e USING (tree, i) LEFT JOIN proofs f USING (tree, i) JOIN (SELECT h FROM top WHERE n = 1) r ON true"""
