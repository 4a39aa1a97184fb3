"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample, and every vector is put into one of its
leaves. A query walks the tree through a priority queue of nodes, nearest centre
first, and visits leaves in the order in which they come out. How many leaves
all queries visit is calibrated: for a bounded number of queries the true
neighbours are found by comparing with every vector in blocks, and visits widen
until the wanted share of them lies in a visited leaf.

Equal vectors collapse to one with its smallest ids, which is all that a list of
``k`` neighbours can hold of them, so copies make neither hot leaves nor hot
queries. Leaves share shelves, which are searched in blocks of vectors and
queries of bounded size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxline.llm.common import stored

SAMPLE = 20_000  # vectors that the tree is fitted on, about
BRANCHES = 8
LEAF_ROWS = 512  # rows of a leaf, at most about; leaves also hold LEAST_LEAF sampled vectors or they are not split
LEAST_LEAF = 32
CALIBRATION = 200  # queries whose true neighbours are found, about
RECALL = 0.95
BLOCK = 4096  # vectors, and queries, of one block of a leaf, about
_SPACE = 1_000_003


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    label = np.zeros(len(points), int)
    for _ in range(rounds):
        label = _nearest(points, centres)
        used = np.unique(label)
        new = np.stack([points[label == i].mean(axis=0) for i in used])
        label = np.searchsorted(used, label)
        if new.shape == centres.shape and np.allclose(new, centres):
            break
        centres = new
    return centres, _nearest(points, centres)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def fit_tree(points: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_ROWS, seed: int = 1) -> list[tuple[np.ndarray, list[int]]]:
    """Nodes ``(centres, children)``; a child from 0 is a node, a negative one is leaf ``-child - 1``. Node 0 is the root."""
    rng, nodes, leaves = np.random.default_rng(seed), [], 0

    def build(part: np.ndarray) -> int:
        nonlocal leaves
        if len(part) > leaf:
            centres, label = _kmeans(part, branches, rng)
            used = np.unique(label)
            if len(used) > 1:
                at = len(nodes)
                nodes.append((centres[used], []))
                nodes[at][1].extend(build(part[label == i]) for i in used)
                return at
        leaves += 1
        return -leaves

    if len(points) and build(points) < 0:
        nodes.append((points.mean(axis=0, keepdims=True), [-1]))
    return nodes


def leaves_of(points: np.ndarray, nodes: list) -> np.ndarray:
    """Leaf that each point falls into, always towards the nearest centre."""
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        centres, children = nodes[node]
        label = _nearest(points[rows], centres)
        for i, child in enumerate(children):
            part = rows[label == i]
            if len(part):
                if child < 0:
                    out[part] = -child - 1
                else:
                    todo.append((child, part))
    return out


def best_bins(point: np.ndarray, nodes: list, visits: int | None = None) -> list[int]:
    """Leaves in best-bin-first order: the nearest node that waits is opened next."""
    queue, found = [(0.0, 0)], []
    while queue and (visits is None or len(found) < visits):
        _, node = heapq.heappop(queue)
        if node < 0:
            found.append(-node - 1)
            continue
        centres, children = nodes[node]
        for d, child in zip(((centres - point) ** 2).sum(axis=1).tolist(), children):
            heapq.heappush(queue, (d, child))
    return found


def closest(queries: np.ndarray, points: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[float, int]]]:
    """The ``k`` nearest ``(distance, id)`` of each query, ties to smaller ids, in exact double precision."""
    out = []
    norms, sizes = (points**2).sum(axis=1), (queries**2).sum(axis=1)
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        rough = norms - 2 * part @ points.T + sizes[at : at + 256, None]
        limit = np.partition(rough, min(k, len(points)) - 1, axis=1)[:, min(k, len(points)) - 1]
        limit = limit + 1e-9 * (sizes[at : at + 256] + norms.max())
        for query, row, most in zip(part, rough, limit):
            near = np.flatnonzero(row <= most)
            exact = np.sqrt(((points[near] - query) ** 2).sum(axis=1))
            out.append(sorted((d, i) for d, n in zip(exact.tolist(), near.tolist()) for i in ids[n])[:k])
    return out


def shelves(sizes: dict[int, int], block: int) -> tuple[dict[int, int], dict[int, int]]:
    """Shelf of each leaf, and rows of each shelf: leaves in order, a new shelf once one holds ``block`` rows."""
    shelf_of, filled, shelf = {}, {}, 0
    for leaf in sorted(sizes):
        if filled.get(shelf, 0) and filled[shelf] + sizes[leaf] > block:
            shelf += 1
        shelf_of[leaf] = shelf
        filled[shelf] = filled.get(shelf, 0) + sizes[leaf]
    return shelf_of, filled


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _usable(embeddings: DataFrame, vector: str) -> DataFrame:
    """Rows that take part, as ``vec_id`` and ``v``: of the most frequent length, finite, not zero, with an id."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["size"] if sizes else 0))


def _part(key: Column, share: float) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(_SPACE)) < share * _SPACE


def _top(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``key`` and ``near``: the ``k`` nearest of ``rows`` (``key``, ``score``, ``vec_id``) in order. The rank limit works before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))


def nearest_neighbours(
    embeddings: DataFrame, vector: str = "embedding", every: int = 100, k: int = 10, recall: float = RECALL, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, calibration: int = CALIBRATION, block: int = BLOCK
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (Euclidean distance) of the ``k`` nearest rows found for each query.

    Queries are rows whose id is divisible by ``every``; a row is never its own
    neighbour. Vectors that are null, zero, of another length than most, or hold
    null or non-finite components take no part, nor do null ids. Of repeated
    rows each is a candidate, except for a query of the same id. Fewer than
    ``k`` candidates, or an empty table, give fewer rows.
    """
    spark = embeddings.sparkSession
    rows = _usable(embeddings, vector)
    order = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = rows.withColumn("n", order).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    distinct = stored(distinct, "vectors")
    total = distinct.count()
    share = min(1.0, sample / max(total, 1))
    chosen = distinct.where(_part(F.col("v"), share)).select("v").toArrow()
    points = _matrix(chosen["v"]) if chosen.num_rows else np.zeros((0, 1))
    if total and not len(points):
        points = _matrix(distinct.select("v").limit(1).toArrow()["v"])
    points = points[np.lexsort(points.T[::-1])]
    tree = spark.sparkContext.broadcast(fit_tree(points, leaf=max(LEAST_LEAF, int(leaf_rows * share))))

    def to_leaf(batches):
        for batch in batches:
            found = leaves_of(_matrix(batch.column(0)), tree.value) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], ["v", "ids", "leaf"])

    indexed = stored(distinct.mapInArrow(to_leaf, "v array<double>, ids array<long>, leaf long"), "leaves")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = stored(asked.select("v").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")

    # Calibration: true neighbours of some queries, and the place of their leaves in the order of visits.
    n = queries.count()
    some = queries.where(_part(F.col("v"), min(1.0, calibration / max(n, 1)))).toArrow()
    if n and not some.num_rows:
        some = queries.limit(1).toArrow()
    probe = spark.sparkContext.broadcast((some["query"].to_pylist(), _matrix(some["v"]) if some.num_rows else np.zeros((0, 1))))

    def compare(batches):
        keys, wanted = probe.value
        for batch in batches:
            if batch.num_rows and keys:
                ids = batch.column(1).to_pylist()
                leaf_of = {i: leaf for held, leaf in zip(ids, batch.column(2).to_pylist()) for i in held}
                found = closest(wanted, _matrix(batch.column(0)), ids, k + 1)
                flat = [(q, d, i, leaf_of[i]) for q, near in zip(keys, found) for d, i in near]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat)], ["query", "score", "vec_id", "leaf"])

    true = indexed.mapInArrow(compare, "query long, score double, vec_id long, leaf long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    # The first is the query's own row, which the first leaf visited gives away.
    true = true.withColumn("rank", rank).where(F.col("rank").between(2, k + 1)).select("query", "leaf").collect()
    place = {q: {leaf: at for at, leaf in enumerate(best_bins(v, tree.value))} for q, v in zip(*probe.value)}
    places = sorted(place[r["query"]][r["leaf"]] for r in true)
    visits = places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)] + 1 if places else 1

    # Neighbouring leaves share a shelf of about one block of vectors, so a query gets one list from all leaves of a shelf
    # that it visits. The counts are bounded by the leaves of the tree.
    sizes = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    shelf_of, filled = shelves(sizes, block)
    vector_blocks = {shelf: -(-rows_held // (2 * block)) for shelf, rows_held in filled.items()}

    def to_bins(batches):
        for batch in batches:
            flat = []
            for at, point in enumerate(_matrix(batch.column(0)) if batch.num_rows else ()):
                by_shelf: dict[int, list[int]] = {}
                for found in best_bins(point, tree.value, visits):
                    if found in shelf_of:
                        by_shelf.setdefault(shelf_of[found], []).append(found)
                flat += [(at, shelf, held) for shelf, held in by_shelf.items()]
            at, shelf, held = zip(*flat) if flat else ((), (), ())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(shelf, pa.int64()), pa.array(held, pa.list_(pa.int64()))], ["v", "query", "shelf", "leaves"])

    routed = stored(queries.select("v", "query").mapInArrow(to_bins, "v array<double>, query long, shelf long, leaves array<long>"), "routes")
    query_blocks = {r["shelf"]: -(-r["n"] // block) for r in routed.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).collect()}

    def number(column: Column, values: dict[int, int]) -> Column:
        """Value of each key, 1 where there is none; the keys are numbered from 0."""
        return F.coalesce(F.get(F.array(*(F.lit(values.get(i, 1)) for i in range(max(values, default=0) + 1))), column.cast("int")), F.lit(1)).cast("long")

    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    shelf = F.col("shelf")
    held = indexed.withColumn("shelf", number(F.col("leaf"), shelf_of)).withColumn("vb", F.pmod(F.xxhash64("v"), number(shelf, vector_blocks)))
    held = held.withColumn("qb", each(number(shelf, query_blocks)))
    sent = routed.withColumn("qb", F.pmod(F.xxhash64("v"), number(shelf, query_blocks))).withColumn("vb", each(number(shelf, vector_blocks)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        near: dict[int, list[tuple[float, int]]] = {}
        if left.num_rows and right.num_rows:
            points, wanted, ids, names = _matrix(left["v"]), _matrix(right["v"]), left["ids"].to_pylist(), right["query"].to_pylist()
            leaf, visited = left["leaf"].to_numpy(), right["leaves"].to_pylist()
            for one in np.unique(leaf).tolist():
                here, asking = np.flatnonzero(leaf == one), [i for i, x in enumerate(visited) if one in x]
                if asking:
                    for i, found in zip(asking, closest(wanted[asking], points[here], [ids[j] for j in here], k + 1)):
                        near[i] = sorted(near.get(i, []) + found)[: k + 1]
        flat = [(names[i], d, v) for i, found in near.items() for d, v in found]
        q, d, v = zip(*flat) if flat else ((), (), ())
        return pa.table({"query": pa.array(q, pa.int64()), "score": pa.array(d, pa.float64()), "vec_id": pa.array(v, pa.int64())})

    keys = ["shelf", "vb", "qb"]
    found = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(search, "query long, score double, vec_id long")
    lists = _top(found, "query", k + 1).join(queries, "query").select("v", "near")
    answers = asked.join(lists, "v").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    ranked = answers.select("query_id", F.posexplode("near").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
