"""Packing texts into containers of fixed capacity by the sum-of-squares rule.

An item goes where the sum of squares of N(g), the number of open containers with gap g, becomes least; no level of gap is
thus left to pile up, and gaps that later items fill stay at hand. A step looks at each gap once, so its cost is the
capacity, not the number of containers. Items are dealt to shards by a hash of their key, and each shard and capacity is
packed in one task; a shard adds at most its own last open containers to the unused space.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items packed in one task, and how many limits there may be: they are parameters and go into the plan.
SHARD, MOST_LIMITS = 50_000, 1_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container, from 0, of each size in the given order; sizes are 0 to capacity. Size 0 takes no space: container 0."""
    gaps = np.zeros(capacity + 1, "int64")  # open containers by gap; neither full nor empty ones count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, n = np.zeros(len(sizes), "int64"), 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            continue
        # growth of the sum of squares if a container of gap g = s..capacity takes the item
        grows = 2 * (gaps[: capacity - s + 1] - gaps[s:]) + 2
        grows[0] = 1 - 2 * gaps[s]
        grows[gaps[s:] == 0] = np.iinfo("int64").max
        grows[-1] = 2 * gaps[capacity - s] + 1 if s < capacity else 0  # a new one
        left = int(np.argmin(grows))
        if left + s == capacity:
            at, n = n, n + 1
        else:
            at = stacks[left + s].pop()
            gaps[left + s] -= 1
        if left:
            stacks[left].append(at)
            gaps[left] += 1
        out[i] = at
    return out


def pack(items: DataFrame, limits: DataFrame, key: str, size: str, shard: int = SHARD) -> DataFrame:
    """(limit_id, container, key, part, first, n_tokens): where each item, or each part of one above the capacity, goes.

    Only an item that alone exceeds a capacity is split: into parts that each fill a container, and a rest that is packed
    like any item. `first` is the offset of a part's first token. Items of size 0 take no space and share a container.
    Limits without a positive capacity give no rows; of a limit stated twice the larger capacity counts. A null size is 0, a null
    key is packed like any other, a repeated key as often as it stands.
    """
    shards = max(1, -(-items.count() // shard))
    caps = limits.filter("limit_id IS NOT NULL AND capacity > 0").groupBy(F.col("limit_id").cast("long").alias("limit_id")).agg(F.max(F.col("capacity").cast("long")).alias("capacity"))
    given = caps.limit(MOST_LIMITS + 1).collect()
    if len(given) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    sized = items.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n_tokens"))
    into = F.array(*[F.struct(F.lit(r.limit_id).alias("limit_id"), F.lit(r.capacity).alias("capacity")) for r in given]) if given else F.array().cast("array<struct<limit_id:bigint,capacity:bigint>>")
    each = sized.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards))).select("*", F.explode(into).alias("c")).select(key, "n_tokens", "shard", "c.*")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        capacity, number = int(batch["capacity"].iloc[0]), int(batch["shard"].iloc[0])
        batch = batch.sort_values(["n_tokens", key], ascending=[False, True], kind="stable")
        n = batch["n_tokens"].to_numpy()
        parts = np.maximum(1, -(-n // capacity))
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        width = np.minimum(n[row] - part * capacity, capacity)
        order = np.argsort(-width, kind="stable")
        container = np.empty(len(row), "int64")
        container[order] = sum_of_squares(width[order], capacity)
        return pd.DataFrame({"limit_id": batch["limit_id"].to_numpy()[row], "container": container + (number << 32), key: batch[key].to_numpy()[row], "part": part, "first": part * capacity, "n_tokens": width})

    return each.groupBy("limit_id", "shard").applyInPandas(run, f"limit_id long, container long, `{key}` long, part long, first long, n_tokens long")
