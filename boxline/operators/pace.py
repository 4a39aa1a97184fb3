"""Weighted historical sales pace for many target matches at once.

A past match weighs more the more it has in common with the target. The weight
is a sum of terms, and each term depends on one attribute only. Past sales are
therefore added up per attribute value first, and every target then looks its
own values up: work grows with the matches, not with pairs of matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxline.operators.common import ranked, running
from boxline.operators.filters import candidate_predicate
from boxline.operators.matches import completed_matches, final_sales

# What each shared attribute adds to a weight of 1.
SHARED = {"venue": 0.45, "competition": 0.25, "event_category": 0.35, "day_of_week": 0.15, "opponent": 0.35}
# Fixed values: (most added, gap that takes 1 away). Nothing is added past most * gap.
NEARNESS = {"opponent_strength": (0.35, 300.0), "round": (0.15, 50.0)}
RECENCY = 0.04
WHOLE = -1  # stands for "all days" beside the days to the event

TIER_SEASONS, TIER_COMPETITION, TIER_ALL = 0, 1, 2


@dataclass(frozen=True)
class PaceSettings:
    window_days: int = 120
    min_matches: int = 3


def similarity(target: Column) -> Column:
    """Weight of a past match against one target, before recency."""
    same = lambda name, gain: F.when(F.coalesce(F.col(name) == target.getField(name), F.lit(False)), gain).otherwise(0.0)
    out = F.lit(1.0)
    for name, gain in SHARED.items():
        out = out + same(name, gain)
    for name, (most, step) in NEARNESS.items():
        gap = F.abs(F.col(name).cast("double") - F.coalesce(target.getField(name).cast("double"), F.lit(0.0)))
        out = out + F.least(F.greatest(F.lit(most) - gap / step, F.lit(0.0)), F.lit(most))
    return out


def comparable_matches(
    matches: DataFrame, daily: DataFrame, match_id: str, filters: dict | None = None, reference=None,
    limit: int | None = None, settings: PaceSettings = PaceSettings(),
) -> DataFrame:
    """Past matches by ``rank`` of their likeness to one selected match."""
    done = completed_matches(matches, daily, reference)
    pool = matches.join(done, "match_id", "left_semi")
    # Candidates under the filters, then without the seasons, then all of them.
    steps = [filters or {}, {k: v for k, v in (filters or {}).items() if k != "season_label"}]
    if "competition" in (filters or {}):
        steps.append({"competition": filters["competition"]})
    tests = [candidate_predicate(matches, s) for s in steps]
    counts = pool.agg(F.array(*[F.count_if(t) for t in tests]).alias("v")).scalar()
    chosen = F.lit(True)
    for i in reversed(range(len(tests))):
        chosen = F.when(counts[i] >= settings.min_matches, tests[i]).otherwise(chosen)
    if not filters:
        chosen = F.lit(True)
    fields = [*SHARED, *NEARNESS]
    target = matches.filter(F.col("match_id") == match_id).select(F.struct(*fields)).scalar()
    rows = pool.filter(chosen & (F.col("match_id") != match_id))
    oldest = rows.agg(F.min("season").alias("v")).scalar()
    raw = similarity(target) * (1 + (F.col("season") - oldest) * RECENCY)
    rows = rows.withColumn("_raw", raw)
    whole = rows.agg(F.sum("_raw").alias("v")).scalar()
    rows = rows.withColumn("similarity", F.col("_raw") / whole).drop("_raw")
    return ranked(rows.join(final_sales(daily), "match_id", "left"), F.col("similarity").desc(), "match_id", limit=limit)


def _candidate_sets(matches: DataFrame, done: DataFrame, baseline: Sequence[str]) -> DataFrame:
    """Completed matches with the candidate sets they belong to.

    A set is (tier, competition): the baseline seasons of a competition, the
    whole competition, or everything.
    """
    in_baseline = F.col("season_label").isin(list(baseline)) if baseline else F.lit(True)
    sets = F.array_compact(
        F.array(
            F.when(in_baseline, F.struct(F.lit(TIER_SEASONS).alias("tier"), F.col("competition").alias("scope"))),
            F.struct(F.lit(TIER_COMPETITION).alias("tier"), F.col("competition").alias("scope")),
            F.struct(F.lit(TIER_ALL).alias("tier"), F.lit("*").alias("scope")),
        )
    )
    fields = ["match_id", "season", *SHARED, *NEARNESS]
    return matches.join(done, "match_id", "left_semi").select(*fields, F.explode(sets).alias("set")).select("*", "set.tier", "set.scope").drop("set")


def _target_sets(targets: DataFrame, members: DataFrame, min_matches: int) -> DataFrame:
    """The candidate set each target uses, with the oldest season in it.

    The first tier with enough matches wins. A target never counts itself,
    unless that leaves nothing.
    """
    oldest = F.min("season").alias("_m1")
    stats = members.groupBy("tier", "scope", "season").agg(F.count(F.lit(1)).alias("n"))
    spec = Window.partitionBy("tier", "scope").orderBy("season")
    stats = stats.withColumn("_next", F.lead("season").over(spec)).groupBy("tier", "scope").agg(
        F.sum("n").alias("n"), oldest, F.min_by("n", "season").alias("_n1"), F.min_by("_next", "season").alias("_m2")
    )
    own = F.struct("n", "_m1", "_n1", "_m2")
    by_scope = stats.filter(F.col("tier") < TIER_ALL).groupBy(F.col("scope").alias("competition")).agg(
        F.max(F.when(F.col("tier") == TIER_SEASONS, own)).alias("_t0"),
        F.max(F.when(F.col("tier") == TIER_COMPETITION, own)).alias("_t1"),
    )
    everything = stats.filter(F.col("tier") == TIER_ALL).select(F.struct("n", "_m1", "_n1", "_m2")).scalar()
    member = members.select("match_id", "tier").groupBy("match_id").agg(F.collect_set("tier").alias("_tiers"))
    rows = targets.join(by_scope, "competition", "left").join(member, "match_id", "left").withColumn("_t2", everything)
    enough = lambda t: F.coalesce(F.col(f"{t}.n") >= min_matches, F.lit(False))
    tier = F.when(enough("_t0"), TIER_SEASONS).when(enough("_t1"), TIER_COMPETITION).otherwise(TIER_ALL)
    rows = rows.withColumn("tier", tier)
    picked = F.when(F.col("tier") == TIER_SEASONS, F.col("_t0")).when(F.col("tier") == TIER_COMPETITION, F.col("_t1")).otherwise(F.col("_t2"))
    rows = rows.withColumns(
        {
            "_set": picked,
            "_inside": F.coalesce(F.array_contains("_tiers", F.col("tier")), F.lit(False)),
        }
    )
    # Left alone in its set, a target falls back to every completed match.
    alone = F.col("_inside") & (F.col("_set.n") == 1)
    empty = F.col("_set.n").isNull() | alone
    rows = rows.withColumns(
        {
            "tier": F.when(empty, TIER_ALL).otherwise(F.col("tier")),
            "_exclude": F.col("_inside") & ~empty,
            "_set": F.when(empty, F.col("_t2")).otherwise(F.col("_set")),
        }
    )
    first_gone = F.col("_exclude") & (F.col("season") == F.col("_set._m1")) & (F.col("_set._n1") == 1)
    return rows.withColumns(
        {
            "scope": F.when(F.col("tier") == TIER_ALL, "*").otherwise(F.col("competition")),
            "_oldest": F.when(first_gone, F.col("_set._m2")).otherwise(F.col("_set._m1")),
            "_candidates": F.coalesce(F.col("_set.n"), F.lit(0)) - F.col("_exclude").cast("int"),
        }
    ).drop("_t0", "_t1", "_t2", "_tiers", "_set", "_inside")


def _terms(side: str) -> Column:
    """The attribute values of a match, as entries to look up.

    Numbers are put in buckets as wide as their reach; a target looks in its
    own bucket and in both neighbours.
    """
    entry = lambda name, key, value: F.struct(
        F.lit(name).alias("term"), key.cast("string").alias("key"), value.cast("double").alias("number")
    )
    none = F.lit(None).cast("double")
    entries = [entry("base", F.lit("*"), none)]
    entries += [F.when(F.col(name).isNotNull(), entry(name, F.col(name), none)) for name in SHARED]
    for name, (most, step) in NEARNESS.items():
        value = F.col(name).cast("double")
        if side == "target":
            value = F.coalesce(value, F.lit(0.0))
        bucket = F.floor(value / F.lit(most * step)).cast("bigint")
        shifts = (-1, 0, 1) if side == "target" else (0,)
        entries += [F.when(value.isNotNull(), entry(name, bucket + shift, value)) for shift in shifts]
    return F.explode(F.array_compact(F.array(*entries)))


def _gain() -> Column:
    """What a looked-up entry adds to the weight."""
    out = F.when(F.col("term") == "base", 1.0)
    for name, gain in SHARED.items():
        out = out.when(F.col("term") == name, gain)
    for name, (most, step) in NEARNESS.items():
        gap = F.abs(F.col("number") - F.col("c_number"))
        out = out.when(F.col("term") == name, F.least(F.greatest(F.lit(most) - gap / step, F.lit(0.0)), F.lit(most)))
    return out


def pace_profiles(
    targets: DataFrame, matches: DataFrame, daily: DataFrame, baseline: Sequence[str] = (), reference=None,
    settings: PaceSettings = PaceSettings(),
) -> DataFrame:
    """Share of final sales per day to the event, for every target match.

    One row per target and day: daily and running share, number of past
    matches used, and number of candidates.
    """
    fields = ["match_id", "season", *SHARED, *NEARNESS]
    members = _candidate_sets(matches, completed_matches(matches, daily, reference), baseline)
    plan = _target_sets(targets.select(*fields), members, settings.min_matches)

    sold = final_sales(daily).filter(F.col("final_sales") > 0)
    per_day = (
        daily.filter(F.col("days_to_event").between(0, settings.window_days))
        .groupBy("match_id", "days_to_event").agg(F.sum("daily_sales").alias("_daily"))
        .join(sold, "match_id")
        .select("match_id", "days_to_event", (F.col("_daily") / F.col("final_sales")).alias("share"))
        .filter(F.col("share") != 0)
    )
    shares = per_day.unionByName(sold.select("match_id", F.lit(WHOLE).alias("days_to_event"), F.lit(1.0).alias("share")))
    entries = members.select("match_id", "season", "tier", "scope", _terms("candidate").alias("e")).select("match_id", "season", "tier", "scope", "e.*")
    summed = entries.join(shares, "match_id").groupBy("tier", "scope", "term", "key", "number", "days_to_event").agg(
        F.sum("share").alias("s"), F.sum(F.col("season") * F.col("share")).alias("s_season"), F.count(F.lit(1)).alias("n")
    ).withColumnRenamed("number", "c_number")

    wanted = plan.select("match_id", "tier", "scope", "_oldest", _terms("target").alias("e")).select("match_id", "tier", "scope", "_oldest", "e.*")
    # (1 + r * (season - oldest)) is linear in the season, so two sums are enough.
    recent = F.col("s") * (1 - F.col("_oldest") * RECENCY) + F.col("s_season") * RECENCY
    looked_up = wanted.join(summed, ["tier", "scope", "term", "key"]).select(
        "match_id", "days_to_event", (_gain() * recent).alias("w"), F.when(F.col("term") == "base", F.col("n")).otherwise(0).alias("n")
    )
    # A target inside its own set is taken out again.
    itself = F.lit(1.0)
    for name, gain in SHARED.items():
        itself = itself + F.when(F.col(name).isNotNull(), gain).otherwise(0.0)
    for name, (most, step) in NEARNESS.items():
        itself = itself + F.when(F.col(name).isNotNull(), most).otherwise(0.0)
    own = plan.filter("_exclude").join(shares, "match_id").select(
        "match_id", "days_to_event",
        (-itself * F.col("share") * (1 + (F.col("season") - F.col("_oldest")) * RECENCY)).alias("w"), F.lit(-1).alias("n"),
    )
    per_target = looked_up.unionByName(own).groupBy("match_id", "days_to_event").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    totals = per_target.filter(F.col("days_to_event") == WHOLE).select("match_id", F.col("w").alias("_whole"), F.col("n").alias("_used"))

    spine = plan.select("match_id", "_candidates", F.explode(F.sequence(F.lit(0), F.lit(settings.window_days))).alias("days_to_event"))
    rows = spine.join(totals, "match_id", "left").join(per_target.drop("n"), ["match_id", "days_to_event"], "left")
    share = F.when(F.coalesce("_used", F.lit(0)) > 0, F.greatest(F.coalesce("w", F.lit(0.0)) / F.col("_whole"), F.lit(0.0)))
    rows = rows.withColumn("_share", F.coalesce(share, F.lit(0.0)))
    whole = F.sum("_share").over(Window.partitionBy("match_id"))
    rows = rows.withColumn("_sum", whole)
    even = F.lit(1.0 / (settings.window_days + 1))
    rows = rows.withColumn("historical_daily_share", F.when(F.col("_sum") > 0, F.col("_share") / F.col("_sum")).otherwise(even))
    return rows.select(
        "match_id",
        "days_to_event",
        "historical_daily_share",
        F.sum("historical_daily_share").over(running("match_id", order=[F.col("days_to_event").desc()])).alias("historical_cumulative_share"),
        F.coalesce("_used", F.lit(0)).cast("int").alias("historical_sample_size"),
        F.col("_candidates").cast("int").alias("candidate_count"),
    )
