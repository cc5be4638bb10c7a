"""Mixing sources to target shares along a curriculum that changes with training progress.

Each source has a weight schedule over the progress from 0 to 1, linear between its points; at every moment the weights
of all sources are scaled to sum to one, so that progress is a position in the tokens of the mix. The integral of its
weight is a source's cumulative token demand; inverting it gives the progress at which a document is due, and the mix is
the documents range-sorted by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.session import written

#: Prefix sums are taken in so many hash ranges a source, so that a source with a third of all rows isn't one task.
RANGES = 1024
#: Schedules are integrated and inverted in so many steps.
STEPS = 1024
#: Sources at most that have a target; their schedules are made in the driver.
MOST_SOURCES = 10_000


def plan_shares(available: dict[str, int], target: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, float]:
    """Tokens every source contributes.

    Sources without tokens can't contribute; the shares of the others are scaled to one. Without a total the largest
    mix is made in which all of them reach their share; with one, sources that run out give what max_repeats permits
    and the others fill up in proportion to their shares, again within what they have.
    """
    live = {s: w for s, w in target.items() if available.get(s, 0) > 0 and w > 0 and repeats.get(s, 0) > 0}
    if not live:
        return {s: 0.0 for s in target}
    most = {s: float(available[s] * repeats[s]) for s in live}
    whole = sum(live.values())
    if total is None:
        total = min(most[s] * whole / live[s] for s in live)
    out, left, budget = {s: 0.0 for s in target}, dict(live), float(total)
    while left:
        scale = budget / sum(left.values())
        short = [s for s in left if most[s] < left[s] * scale]
        if not short:
            return out | {s: w * scale for s, w in left.items()}
        for s in short:
            out[s] = most[s]
            budget -= most[s]
            del left[s]
    return out


def positions(shares: dict[str, float], schedule: dict[str, list[tuple[float, float]]], steps: int = STEPS) -> dict[str, list[float]]:
    """For every source the progress at which 0, 1/steps, ..., 1 of its tokens are used.

    schedule has a source's relative weights as (progress, weight) points, linear between them and level outside; a
    source without any is level. Every source's weights are multiplied by one factor, found by proportional fitting, so
    that after scaling all weights to sum to one at every moment each integral is the source's share.
    """
    names = [s for s, w in shares.items() if w > 0]
    if not names:
        return {}
    target = np.array([shares[s] for s in names]) / sum(shares[s] for s in names)
    mid = (np.arange(steps) + 0.5) / steps
    raw = np.ones((len(names), steps))
    for i, s in enumerate(names):
        points = sorted(schedule.get(s) or [(0.0, 1.0)])
        raw[i] = np.maximum(np.interp(mid, [p for p, _ in points], [w for _, w in points]), 1e-9)
    factor = target.copy()
    for _ in range(1000):
        w = factor[:, None] * raw
        w /= w.sum(axis=0)
        reached = w.mean(axis=1)
        if np.abs(reached - target).max() < 1e-12:
            break
        factor *= target / reached
    cumulative = np.hstack([np.zeros((len(names), 1)), np.cumsum(w, axis=1)])
    cumulative /= cumulative[:, -1:]
    edges, wanted = np.linspace(0, 1, steps + 1), np.linspace(0, 1, steps + 1)
    return {s: np.interp(wanted, cumulative[i], edges).tolist() for i, s in enumerate(names)}


def tilted(tilt: float) -> list[tuple[float, float]]:
    """The schedule that moves a source to the end (up to 1) or the start (down to -1) of the training."""
    return [(0.0, 1.0 - tilt), (1.0, 1.0 + tilt)]


def mix(docs: DataFrame, key: str, source: str, tokens: str, targets: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None = None, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    targets has source, target_share and max_repeats. The mix has key, source, repeat_no (int), tokens (bigint) and
    progress (double), sorted by progress; a document is used at most max_repeats times, whole passes over a source
    first. shares has, for every target, target_share, reached_share, tokens and documents. Documents of null, unknown
    or untargeted sources and of no tokens aren't used; an empty mix has reached shares of 0. schedule has the
    weights of sources over the training (see positions); it changes no share. Without a total the mix is the largest
    in which every source with documents reaches its share; a larger total trades shares for size. More than
    MOST_SOURCES targets raise ValueError.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("n")).filter("n > 0")
    t = targets.select("source", "target_share", "max_repeats")
    used = written(d.join(t.select("source"), "source", "left_semi"), "mix-documents")  # one row a source on the right
    wanted = {r["source"]: r for r in t.limit(MOST_SOURCES + 1).collect()}  # one row a source
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    have = {r["source"]: r["n"] for r in used.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    plan = plan_shares(have, {s: r["target_share"] for s, r in wanted.items()}, {s: r["max_repeats"] for s, r in wanted.items()}, total)
    due = positions(plan, schedule or {})
    rows = [(s, float(p), float(have[s]), due[s]) for s, p in plan.items() if p > 0]
    demand = spark.createDataFrame(rows, "source string, demand double, have double, due array<double>")
    order = F.xxhash64("key", F.lit(17))
    ranged = used.withColumn("h", order).withColumn("r", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * RANGES).cast("int"))
    sums = ranged.groupBy("source", "r").agg(F.sum("n").alias("range_n"))  # at most RANGES rows a source
    before = sums.withColumn("base", F.coalesce(F.sum("range_n").over(Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "r", "base")
    inside = Window.partitionBy("source", "r").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("n").over(inside)).join(before, ["source", "r"]).withColumn("start", F.col("base") + F.col("upto") - F.col("n"))
    placed = placed.join(F.broadcast(demand), "source")
    passes = F.floor(F.col("demand") / F.col("have")).cast("int")
    copies = placed.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), passes)))
    at = F.col("repeat_no") * F.col("have") + F.col("start")
    copies = copies.filter((at + F.col("n") / 2) <= F.col("demand"))
    x = F.least(at / F.col("demand"), F.lit(1.0))
    step = F.least(F.floor(x * STEPS), F.lit(STEPS - 1)).cast("int")
    low, high = F.element_at("due", step + 1), F.element_at("due", step + 2)
    progress = low + (high - low) * (x * STEPS - step)
    chosen = copies.select("key", "source", "repeat_no", F.col("n").alias("tokens"), progress.alias("progress"))
    chosen = written(chosen, "mix")
    all_tokens = chosen.agg(F.sum("tokens")).first()[0] or 0
    got = chosen.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("key").alias("documents"), (F.max("repeat_no") + 1).alias("most_used"))
    shares = t.join(got, "source", "left").select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.lit(max(1, all_tokens))).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_used", F.lit(0)).alias("most_used"), "max_repeats",
    )
    return chosen.withColumnRenamed("key", key).orderBy("progress", "source", key), shares
