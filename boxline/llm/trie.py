"""Prefix trie of conversations by whole-sequence collapse.

A conversation is a chain of digests: that of its first ``d`` turns is the
digest of the chain so far and of turn ``d``, so equal chains mean equal
beginnings. Conversations with equal last digests are the same sequence and are
collapsed to one with a weight, the list of its conversations as end list, and
the smallest of them as its member to work on. Sequences that an anti-join finds
to be proper prefixes of others end inside the trie; the rest are its leaves.
Only the beginnings of differing sequences, with their weights, are added up
to nodes.

A node's value counts once in every node above it: it is written to the
smallest conversation that runs through it, and running sums from the end of
each such conversation give what each of its beginnings gets from it. So no pairs
of nodes are formed and the work stays linear in the turns. Texts are read
once; digests and lengths are what moves.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxline.llm.common import crc32_sql, stored, text_of

HEADS = 6  # a rebuilt conversation starts with up to HEADS - 1 turns of the first of its hundred
SPAN = 100
_BLOCK = 4096  # ids an end list's block spans
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """One slim row per turn: ``conv_id``, ``at`` (its place from 0), ``digest`` of role and text, ``length`` of the text in code points.

    Turns are ordered by ``turn``, null first; equal ones by their digests. Rows
    without ``conv_id`` belong to no conversation.
    """
    role, text = text_of(F.col("`role`")), text_of(F.col("`text`"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = conversations.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("length"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return slim.where("conv_id IS NOT NULL").withColumn("at", F.row_number().over(order) - 1).drop("turn")


def rebuild(turns: DataFrame, heads: int = HEADS, span: int = SPAN) -> DataFrame:
    """Turns of the rebuilt conversations, with a first row (``at`` -1) for every conversation, even a turnless one.

    Conversation c starts with the first h turns of conversation c - c % span,
    h being the CRC-32 of c's digits modulo ``heads``, and goes on with its own
    turns after its first h. A starting conversation meets at most ``span`` others.
    """
    kept = F.crc32(F.col("conv_id").cast("string")) % heads
    own = turns.withColumn("kept", kept)
    every = own.groupBy("conv_id").agg(F.first("kept").alias("kept")).withColumn("base", F.expr(f"conv_id - conv_id % {span}"))
    first = turns.where((F.col("at") < heads - 1) & F.expr(f"conv_id % {span} = 0")).withColumnRenamed("conv_id", "base")
    before = every.join(first, "base").where("at < kept")
    columns = ["conv_id", "at", "digest", "length"]
    start = every.select("conv_id", F.lit(-1).alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("length"))
    return start.unionByName(before.select(columns)).unionByName(own.where("at >= kept").select(columns))


def chained(turns: DataFrame) -> DataFrame:
    """One row per beginning of each conversation: ``conv_id``, ``depth``, ``key``, ``parent_key``, ``length`` of its last text, ``last`` if it is the whole.

    Conversations stream through, a batch of turns at a time, however long they are.
    """
    kinds = [("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("length", pa.int64()), ("last", pa.bool_())]

    def run(batches):
        held = None  # the row before, whose ``last`` is known only now
        for batch in batches:
            rows = []
            for conv_id, digest, length in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                more = digest is not None
                if held:
                    rows.append((*held, not more))
                if more:
                    held = (conv_id, held[1] + 1, hashlib.sha256(held[2] + digest).digest(), held[2], length)
                else:
                    held = (conv_id, 0, bytes(32), None, 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], [n for n, _ in kinds])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, (_, k) in zip((*held, True), kinds)], [n for n, _ in kinds])

    # Dealt by a hash of the id: Spark leaves out a repartition by the id itself where it finds one below, and may then read that one's blocks task by task.
    ordered = turns.select("conv_id", "at", "digest", "length").repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "at")
    return ordered.mapInArrow(run, "conv_id long, depth long, key binary, parent_key binary, length long, last boolean")


def end_digests(ends: DataFrame) -> DataFrame:
    """``key`` and ``ends_sha256``: SHA-256 of the conversations that end there, ascending, comma-joined.

    Ids are joined in blocks of a bounded span of ids first, which then stream
    through the hash in order, so one node may end any number of conversations.
    """

    def run(batches):
        key = state = None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([v for _, v in done], pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    block = F.floor(F.col("conv_id") / _BLOCK)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("key", block.alias("block")).agg(joined.alias("ids"))
    return blocks.repartition(F.xxhash64("key")).sortWithinPartitions("key", "block").mapInArrow(run, "key binary, ends_sha256 string")


def build(conversations: DataFrame, heads: int = HEADS, span: int = SPAN) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Columns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, the last text's
    code points for every member but one), ``ends_sha256``. Null roles and texts
    count as empty; repeated rows are turns like any other; an empty table has no
    conversation and gives no node.
    """
    beginnings = stored(chained(rebuild(turns_of(conversations), heads, span)), "beginnings")
    ends = beginnings.where("last").select("key", "conv_id")
    sequences = stored(ends.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id")), "sequences")
    paths = beginnings.drop("last").join(sequences.select("conv_id", "weight", F.col("key").alias("whole")), "conv_id")
    inner = paths.where("key <> whole").select("key").distinct()
    leaves = sequences.join(inner, "key", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    paths = stored(paths.drop("whole").join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0))), "paths")
    nodes = stored(paths.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.first("length").alias("length"),
        F.sum("weight").alias("n_convs"), F.sum("leaf").cast("long").alias("n_leaves"),
    ), "nodes")
    values = nodes.select("conv_id", "depth", (F.col("length") * (F.col("n_convs") - 1)).alias("value"))
    later = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    given = paths.select("conv_id", "depth", "key").join(values, ["conv_id", "depth"], "left").withColumn("given", F.sum(F.coalesce("value", F.lit(0))).over(later))
    saved = given.groupBy("key").agg(F.sum("given").alias("saved_tokens"))
    children = nodes.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(saved, "key").join(children, "key", "left").join(end_digests(ends), "key", "left").join(parents, "parent_key", "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def oracle(heads: int = HEADS, span: int = SPAN) -> str:
    digest = "sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))"
    return f"""
WITH RECURSIVE turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {digest}) - 1 AS place, {digest} AS digest, length(coalesce(text, '')) AS length
    FROM conversations WHERE conv_id IS NOT NULL
), every AS (
    SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % {heads} AS kept, conv_id - conv_id % {span} AS base FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT e.conv_id, t.place, t.digest, t.length FROM every e JOIN turns t ON t.conv_id = e.base AND t.place < e.kept
    UNION ALL SELECT e.conv_id, t.place, t.digest, t.length FROM every e JOIN turns t ON t.conv_id = e.conv_id AND t.place >= e.kept
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM rebuilt
), beginnings AS (
    SELECT conv_id, 0::BIGINT AS depth, '' AS key, NULL::VARCHAR AS parent_key, 0::BIGINT AS length FROM every
    UNION ALL SELECT b.conv_id, n.depth, sha256(b.key || n.digest), b.key, n.length FROM beginnings b JOIN numbered n ON n.conv_id = b.conv_id AND n.depth = b.depth + 1
), nodes AS (
    SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, min(parent_key) AS parent_key, min(length) AS length, count(*) AS n_convs FROM beginnings GROUP BY key
), children AS (
    SELECT parent_key AS key, count(*) AS n_children FROM nodes WHERE parent_key IS NOT NULL GROUP BY ALL
), below AS (
    SELECT DISTINCT u.key, v.key AS other FROM beginnings u JOIN beginnings v ON u.conv_id = v.conv_id AND v.depth >= u.depth
), subtrees AS (
    SELECT b.key, sum((n.n_convs - 1) * n.length) AS saved_tokens, count(*) FILTER (c.key IS NULL) AS n_leaves FROM below b JOIN nodes n ON n.key = b.other LEFT JOIN children c ON c.key = b.other GROUP BY ALL
), ends AS (
    SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
    FROM (SELECT conv_id, arg_max(key, depth) AS key FROM beginnings GROUP BY conv_id) GROUP BY key
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN subtrees s USING (key) LEFT JOIN children c USING (key) LEFT JOIN ends e USING (key) LEFT JOIN nodes p ON p.key = n.parent_key"""
