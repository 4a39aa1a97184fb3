"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``most`` whose words meet each source's
target, those of largest entropy relative to one copy each are exponential
tilts, ``rate = min(most, exp(lam * size / mean size))``, with one ``lam`` a source:
the convex dual has one variable for each token constraint. Newton steps find
all of them at once. A step is one aggregation over the counts of documents of
equal source and size, on which alone a rate depends, and a step that leaves
the interval known to hold the solution halves it instead.

Rates become whole copies by systematic rounding along the order of sizes: the
copies up to any place are the rates up to there, rounded, so the words taken
miss a target by less than the longest document. What is missed is then taken
from or given to the largest documents that fit in it, over and over.

Everything is DataFrame functions. Rates are whole millionths and sums are
decimals or longs, so no result depends on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxline.llm.common import discard, stored, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
UNIT = 1_000_000  # rates are counted in these parts
CLOSE = 1e-9  # a constraint is met within this share of its target
SPREAD = 64  # parts, at least, over which documents of equal source and size are spread
PART_ROWS = 100_000
_BAND = 4  # sizes whose parts one window task adds up


def sizes(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """One slim row per document: ``doc_id``, ``name`` (source, never null), ``source``, ``size`` in words, ``tie``."""
    content, doc_id, origin = text_of(F.col(f"`{text}`")), F.col("`doc_id`").cast("long"), F.col(f"`{source}`").cast("string")
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce(F.concat(F.lit("="), origin), F.lit("-")).alias("name"), origin.alias("source"),
        F.regexp_count(content, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(doc_id, content).alias("tie"),
    )


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to one row per source with its ``source_size``.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all words; a target stops at ``most`` times its source. Sources
    that stop are those with the smallest size for their weight, so the level
    (words per weight) that all others reach is the largest over the places at
    which the stopped ones may end. The windows hold one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    placed = totals.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    fill = everything.orderBy(F.col("source_size") / F.col("weight"), "place")
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    words, stopped, used = F.sum("source_size").over(everything), F.sum(most * F.col("source_size")).over(earlier), F.sum("weight").over(earlier)
    level = (share * words - F.coalesce(stopped, F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(used, F.lit(0)))
    filled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.withColumn("target", F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.col("level"))).drop("level")


def _rate(most: int) -> Column:
    return F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(most))))


def solve(histogram: DataFrame, sources: DataFrame, most: int = MOST, close: float = CLOSE) -> DataFrame:
    """Adds ``lam`` to sources (``place``, ``source_size``, ``target``, ``mean``, ``shortest``) given counts ``n`` by ``place`` and ``size``."""
    log_most, want = F.lit(math.log(most)), F.col("target") / F.col("source_size")
    far, full = log_most * F.col("mean") / F.col("shortest"), F.col("target") >= most * F.col("source_size")
    low = F.when(want < 1, F.log(want) * F.col("mean") / F.col("shortest")).otherwise(F.lit(0.0))
    high = F.when(want > 1, far).otherwise(F.lit(0.0))
    start = F.when(full, far).when(want == 1, 0.0).otherwise(F.greatest(low, F.least(high, F.log(want))))
    state = stored(sources.withColumns({"low": low, "high": high, "lam": start, "met": full | (want == 1)}), "tilts")
    words = F.col("n") * F.col("size") * _rate(most)
    slope = F.when(F.col("lam") * F.col("size") / F.col("mean") < log_most, words * F.col("size") / F.col("mean")).otherwise(0.0)
    rounds = 0
    while not state.where(~F.col("met")).isEmpty():
        rounds += 1
        open_ = state.where(~F.col("met")).select("place", "lam", "mean")
        sums = histogram.join(open_, "place").groupBy("place").agg(F.sum(words.cast("decimal(38,9)")).cast("double").alias("words"), F.sum(slope.cast("decimal(38,9)")).cast("double").alias("slope"))
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap <= 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton, half = F.col("lam") - gap / F.nullif(F.col("slope"), F.lit(0.0)), (low + high) / 2
        # Every eighth step halves, so that the interval shrinks however the curve bends.
        step = F.when((newton > low) & (newton < high) & F.lit(rounds % 8 != 0), newton).otherwise(half)
        met = (F.abs(gap) <= close * F.col("target")) | ((high - low) <= 1e-15 * F.greatest(F.abs(low), F.abs(high)))
        closed = F.col("words").isNull()
        after = state.join(sums, "place", "left").select(
            *[c for c in state.columns if c not in ("low", "high", "lam", "met")],
            F.when(closed, F.col("low")).otherwise(low).alias("low"), F.when(closed, F.col("high")).otherwise(high).alias("high"),
            F.when(closed | met, F.col("lam")).otherwise(step).alias("lam"), F.when(closed, F.lit(True)).otherwise(met).alias("met"),
        )
        after = stored(after, "tilts")
        discard(state)
        state = after
    return state.drop("low", "high", "met")


def _before(cells: DataFrame, value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over cells of the source with longer documents, or equally long ones in an earlier part.

    Bands of a few sizes are added up apart and then one after another, so no task holds a whole source.
    """
    banded = cells.withColumn("band", F.expr(f"size div {_BAND}"))
    inside = Window.partitionBy("place", "band").orderBy(F.col("size").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("place").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bands = banded.groupBy("place", "band").agg(F.sum(value).alias("all")).withColumn("outer", F.coalesce(F.sum("all").over(across), F.lit(0))).drop("all")
    summed = banded.withColumn("inner", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(bands, ["place", "band"])
    return summed.withColumn("before", F.col("inner") + F.col("outer")).drop("inner", "outer", "band")


def round_copies(cells: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """Whole copies ``copies`` of each cell (``place``, ``size``, ``part``, ``n`` documents) from its source's tilt, at most ``most`` a document."""
    known = sources.select("place", "lam", "mean", "target")
    rated = cells.join(known, "place").withColumn("rate", F.round(_rate(most) * UNIT).cast("long")).withColumn("share", F.col("n") * F.col("rate"))
    copies = F.expr(f"(before + share + {UNIT // 2}) div {UNIT} - (before + {UNIT // 2}) div {UNIT}")
    current = stored(_before(rated, "share").withColumn("copies", copies).drop("before", "share", "lam", "mean", "target"), "copies")
    goals = sources.select("place", F.round("target").cast("long").alias("goal"))
    while True:
        gaps = current.groupBy("place").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).join(goals, "place").select("place", (F.col("goal") - F.col("taken")).alias("gap"))
        gaps = stored(gaps.where("gap <> 0"), "gaps")  # one row a source: its size is known to the join below
        room = F.when(F.col("gap") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        near = current.join(gaps, "place").withColumn("room", room).where((F.col("size") <= F.abs("gap")) & (F.col("room") > 0)).withColumn("words", F.col("size") * F.col("room"))
        times = F.greatest(F.lit(0).cast("long"), F.least(F.col("room"), F.expr("(abs(gap) - before) div size")))
        moved = stored(_before(near, "words").select("place", "size", "part", (F.signum("gap").cast("long") * times).alias("more")).where("more <> 0"), "moved")
        if moved.isEmpty():
            return current
        after = stored(current.hint("merge").join(moved, ["place", "size", "part"], "left").withColumn("copies", F.col("copies") + F.coalesce(F.col("more"), F.lit(0))).drop("more"), "copies")
        for old in (current, moved, gaps):
            discard(old)
        current = after


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, and ``copies`` and ``rate``.

    Null and empty texts have size 0 and take nothing; a null source is a source
    of its own. Which of several equally long documents of a source gets a copy
    more depends on hashes of id and text alone; rows equal in both share their
    copies in any order. An empty table gives no rows.
    """
    slim = stored(sizes(docs, text, source), "sizes")
    totals = slim.groupBy("name", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.sum((F.col("size") > 0).cast("long")).alias("filled"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("shortest"))
    aims = stored(targets(totals, weights, share, most).withColumn("mean", F.col("source_size") / F.nullif("filled", F.lit(0))), "targets")
    rows = aims.agg(F.sum("rows")).first()[0] or 0
    spread = max(SPREAD, rows // PART_ROWS)
    parted = slim.withColumn("part", F.pmod("tie", F.lit(spread)))
    keys = ["name", "size", "part"]
    cells = stored(parted.where("size > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(aims.select("name", "place"), "name"), "cells")
    histogram = stored(cells.groupBy("place", "size").agg(F.sum("n").alias("n")), "histogram")
    tilts = solve(histogram, aims.where("source_size > 0"), most)
    # Cells grow with the documents, so they meet them in a shuffle, on the keys that the ranks are dealt by.
    counted = round_copies(cells, tilts, most).select(*keys, "n", "copies", "rate").hint("merge")
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("tie", "doc_id"))).join(counted, keys, "left")
    copies = F.coalesce(F.expr("copies div n") + (F.col("rank") <= F.col("copies") % F.col("n")).cast("long"), F.lit(0).cast("long"))
    return ranked.join(aims.select("name", "source_size", "target"), "name").select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), (F.coalesce(F.col("rate"), F.lit(0)) / UNIT).alias("rate")
    )
