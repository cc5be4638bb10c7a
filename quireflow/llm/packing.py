"""Filling containers of fixed capacity: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.session import written

#: Items a shard has on average unless pack is told otherwise; shards are filled by hash, so none grows beyond a few per cent more.
SHARD_ITEMS = 50_000
#: Kinds of containers at most; they are brought to the driver.
MOST_KINDS = 10_000


class Tightest:
    """A segment tree over the remaining capacities 0 to n of open containers."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, remaining: int, container: int) -> None:
        self.bins.setdefault(remaining, []).append(container)
        i = remaining + self.size
        while i:
            self.open[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(remaining, container) of the open container with the least remaining capacity of need or more."""
        i = need + self.size
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):  # up until a right neighbour has an open container
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        remaining = i - self.size
        container = self.bins[remaining].pop()
        while i:
            self.open[i] -= 1
            i >>= 1
        return remaining, container


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item; items are taken from the largest, ties in the given order."""
    tree, count = Tightest(capacity), 0
    where = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            found = (capacity, count)
            count += 1
        where[i] = found[1]
        tree.add(found[0] - sizes[i], found[1])
    return where


def pack(items: DataFrame, key: str, size: str, containers: DataFrame, kind: str, capacity: str, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assigns every item to containers of every kind.

    Result: kind, container_id (string), key, piece_no (int), piece_start and piece_size (bigint), and container_used
    (bigint). An item longer than the capacity is cut into pieces of the whole capacity, each a container of its own,
    and a remainder that is packed like any other item; no other item is split. Items of null or zero size have
    nothing to pack and give no rows; repeated keys are separate items. Capacities of null or below one give no rows.
    Items are packed in shards of about shard_items each, whatever their number, so no task holds more; what that
    costs is at most one badly filled container a shard (below 0.5 % of the capacity where a shard fills 200). Columns
    of containers other than kind and capacity are not used; more than MOST_KINDS kinds raise ValueError.
    """
    i = items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).filter("size > 0")
    c = containers.select(F.col(kind).alias("kind"), F.col(capacity).cast("long").alias("capacity")).filter("capacity > 0")
    specs = c.limit(MOST_KINDS + 1).collect()
    if len(specs) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    boxes = F.array(*[F.struct(F.lit(r["kind"]).alias("kind"), F.lit(r["capacity"]).cast("long").alias("capacity")) for r in specs]).cast(f"array<struct<kind:{dict(c.dtypes)['kind']},capacity:bigint>>")
    both = i.select("key", "size", F.explode(boxes).alias("box")).select("key", "size", "box.kind", "box.capacity")
    whole = both.filter("size >= capacity").select("kind", "capacity", "key", F.posexplode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("size") / F.col("capacity")))).alias("piece_no", "__i"))
    full = whole.select("kind", F.concat_ws("-", F.lit("full"), F.col("key").cast("string"), F.monotonically_increasing_id().cast("string")).alias("container_id"), "key", F.col("piece_no"), (F.col("piece_no") * F.col("capacity")).alias("piece_start"), F.col("capacity").alias("piece_size"), F.col("capacity").alias("container_used"))
    rest = both.withColumn("part", F.col("size") % F.col("capacity")).filter("part > 0").select(
        "kind", "capacity", "key", F.floor(F.col("size") / F.col("capacity")).cast("int").alias("piece_no"), (F.col("size") - F.col("part")).alias("piece_start"), F.col("part").alias("piece_size")
    )
    rest = written(rest, "packing-items")
    shards = max(1, -(-rest.count() // (shard_items * max(1, len(specs)))))
    sharded = rest.withColumn("shard", F.pmod(F.xxhash64("key", "piece_start"), F.lit(shards)).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece_size", "key"], ascending=[False, True], kind="stable")
        where = best_fit_decreasing(pdf["piece_size"].tolist(), int(pdf["capacity"].iloc[0]))
        pdf["container_id"] = [f"{pdf['shard'].iloc[0]}-{w}" for w in where]
        pdf["container_used"] = pdf.groupby("container_id")["piece_size"].transform("sum")
        return pdf[["kind", "container_id", "key", "piece_no", "piece_start", "piece_size", "container_used"]]

    kinds = dict(items.dtypes)[key]
    packed = sharded.groupBy("kind", "shard").applyInPandas(one, f"kind string, container_id string, key {kinds}, piece_no int, piece_start bigint, piece_size bigint, container_used bigint")
    return full.unionByName(packed).withColumnRenamed("key", key).withColumnRenamed("kind", kind)
