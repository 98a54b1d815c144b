"""Filling fixed-capacity containers with items (problem 8).

Items are hashed to partitions, and each is packed by best-fit decreasing.  Dual-feasible functions
give a lower bound of the containers a partition needs; where the packing meets it, the partition is certified
and done.  The others put the items of their open containers together, exchange them under another hash
and pack again, for as long as that saves containers.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.session import materialize

#: Items a partition holds on average.
PARTITION_ITEMS = 20_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: largest first, each into the fullest container that still takes it.

    Sizes are whole numbers from 0 to the capacity; equal sizes go in the order given.  The free spaces that
    occur are bits of one integer, so the best fit is its lowest set bit at or above the size.
    """
    out = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, opened = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            container = free[space].pop()
            if not free[space]:
                bits &= ~(1 << space)
        else:
            space, container = capacity, opened
            opened += 1
        left = space - size
        free[left].append(container)
        bits |= 1 << left
        out[i] = container
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of two families of dual-feasible functions over all thresholds."""
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int(sizes.sum()) // capacity)
    # items over capacity - t count whole, items under t not at all, the rest by size
    items, mass = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * x)))
    t = np.arange(1, capacity // 2 + 1)
    whole = items[capacity + 1] - items[capacity - t + 1]
    middle = mass[capacity - t + 1] - mass[t]
    best = max(best, int((whole + -(-middle // capacity)).max(initial=0)))
    # rounding of (k + 1) x / capacity down, exact multiples kept
    for k in range(1, 21):
        scaled = (k + 1) * x
        u = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    return best


def items_of(sized: DataFrame, key: str, capacity: int) -> DataFrame:
    """``(doc, piece, size)``: one item a document; a document over the capacity gives full pieces and a rest."""
    whole = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = (F.col("n_tokens") % capacity).cast("int")
    pieces = F.when(F.col("n_tokens") <= capacity, F.array(F.col("n_tokens").cast("int"))).otherwise(
        F.concat(F.array_repeat(F.lit(capacity), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    )
    return sized.where(F.col(key).isNotNull() & F.col("n_tokens").isNotNull()).select(F.col(key).cast("string").alias("doc"), F.posexplode(pieces).alias("piece", "size"))


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc", "ascending"), ("piece", "ascending")])
        sizes = table.column("size").to_numpy()
        container = best_fit_decreasing(sizes, capacity)
        used = np.bincount(container, weights=sizes, minlength=1).astype(np.int64)
        n, bound = int(container.max(initial=-1)) + 1, lower_bound(sizes, capacity)
        return pa.table(
            {
                "doc": table.column("doc"), "piece": table.column("piece"), "size": table.column("size"), "part": table.column("part"),
                "container": pa.array(container, pa.int64()), "used": pa.array(used[container], pa.int64()),
                "n": pa.array(np.full(len(sizes), n), pa.int64()), "bound": pa.array(np.full(len(sizes), bound), pa.int64()),
            }
        )

    return run


_SCHEMA = "doc string, piece int, size int, part string, container bigint, used bigint, n bigint, bound bigint"


def pack(items: DataFrame, capacity: int, partition_items: int = PARTITION_ITEMS) -> DataFrame:
    """``(container, doc, piece, size, used, part, n, bound)`` of ``(doc, piece, size)``: every item in one container, none over the capacity.

    ``n`` and ``bound`` are the containers of the item's partition ``part`` and the fewest that its items need; where they are equal the partition
    is certified.  Exchange goes on for as long as it saves containers.  Items of size 0 take no space and share a container.  Equal rows are equal items of their own.  Empty
    input gives no container.
    """
    items = materialize(items, "items")
    parts = max(1, -(-items.count() // partition_items))
    # equal rows get to one partition and are still two items there
    keyed = items.withColumn("part", F.concat(F.lit("0-"), F.pmod(F.xxhash64("doc", "piece"), F.lit(parts)).cast("string")))
    packed = materialize(keyed.groupBy("part").applyInArrow(_pack(capacity), _SCHEMA), "packed")
    for turn in itertools.count(1):
        gaps = packed.select("part", "n", "bound").distinct().where("n > bound")
        spare = gaps.agg(F.count("*"), F.sum(F.col("n") - F.col("bound"))).first()
        if not spare[0]:
            break
        # full containers of partitions with a gap stay; the items of the others are exchanged
        loose = packed.join(gaps.select("part"), "part", "left_semi").where(F.col("used") < capacity)
        fixed = packed.join(loose.select("part", "container").distinct(), ["part", "container"], "left_anti")
        before = loose.select("part", "container").distinct().count()
        again = max(1, -(-loose.count() // partition_items))
        moved = loose.select("doc", "piece", "size").withColumn("part", F.concat(F.lit(f"{turn}-"), F.pmod(F.xxhash64("doc", "piece", F.lit(turn)), F.lit(again)).cast("string")))
        repacked = materialize(moved.groupBy("part").applyInArrow(_pack(capacity), _SCHEMA), "packed")
        after = repacked.select("part", "container").distinct().count()
        if after >= before:
            break
        packed = materialize(fixed.unionByName(repacked), "packed")
    # a partition that was exchanged in part is certified by what is left of it
    return packed.select(F.concat_ws("/", "part", F.col("container").cast("string")).alias("container"), "doc", "piece", "size", "used", "part", "n", "bound")


def certificate(packed: DataFrame, capacity: int) -> DataFrame:
    """One row ``(n_containers, n_partitions, n_certified, least, gap)``: ``least`` containers are needed by the total size alone, ``gap`` more are used."""
    one = packed.groupBy("part").agg(F.count_distinct("container").alias("used"), F.first("n").alias("n"), F.first("bound").alias("bound"), F.sum("size").alias("size"))
    least = F.ceil(F.sum("size") / capacity)
    return one.agg(F.sum("used").alias("n_containers"), F.count("*").alias("n_partitions"), F.count_if(F.col("n") == F.col("bound")).alias("n_certified"), least.alias("least"), (F.sum("used") - least).alias("gap"))


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """``(container, n_items, used, unused)``."""
    return packed.groupBy("container").agg(F.count("*").alias("n_items"), F.sum("size").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))
