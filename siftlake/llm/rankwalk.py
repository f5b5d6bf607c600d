"""One ranking from several differently-scaled scores: a Markov chain that walks up the rankings.

From an item the walk picks one of the scores at random, then one of the items at random, and jumps there if that
item ranks higher by that score; every higher-ranked item is thus equally likely. With damping it restarts anywhere.
Items are ordered by the stationary distribution. Only the order of each score enters, so no scale can dominate.
A step needs, for every item, the mass of all items below it: prefix sums over each sorted score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.plans.session import cut

DAMPING = 0.85
#: The walk ends when no item's mass, as a multiple of the mean, still moves by so much; masses are compared to so many digits of that.
TOLERANCE, DIGITS, ROUNDS = 1e-11, 9, 600
#: Groups up to this many items are walked in one task (24 bytes an item and score), many small ones at once in about so many rows; larger ones are walked by joins.
IN_TASK, BATCH = 1_000_000, 50_000


def walk(groups: np.ndarray, scores: np.ndarray, damping: float = DAMPING) -> np.ndarray:
    """Stationary mass, as a multiple of the mean of its group, of each row of `scores` (items x scores, higher is better, NaN: none).

    `groups` numbers the groups from 0; all walk at once, by prefix sums over each score sorted within its group. An item without a
    score ranks below all items that have it, equal to the others without.
    """
    n, k = scores.shape
    size = np.bincount(groups)
    mine = size[groups].astype("float64")
    sides = []
    for s in np.where(np.isnan(scores), -np.inf, scores).T:
        order = np.lexsort((-s, groups))
        g, v = groups[order], s[order]
        first = np.append(True, g[1:] != g[:-1])
        fresh = first | np.append(True, v[1:] != v[:-1])
        run = np.cumsum(fresh) - 1  # stretches of equal score
        begins = np.flatnonzero(fresh)
        start = np.flatnonzero(first)[g]
        end = np.append(np.flatnonzero(first)[1:], n)[g]  # of the group
        through = np.append(begins[1:], n)[run]
        higher = begins[run] - start
        sides.append((order, through, end, 1 - higher / mine[order], mine[order]))
    mass = np.ones(n)
    for _ in range(ROUNDS):
        step = np.zeros(n)
        for order, through, end, stay, m in sides:
            here = mass[order]
            total = np.append(0.0, np.cumsum(here))
            step[order] += (total[end] - total[through]) / m + here * stay
        step = damping * step / k + (1 - damping)
        moved = np.abs(step - mass).max(initial=0.0)
        mass = step
        if moved < TOLERANCE:
            break
    return mass


def stationary(scores: np.ndarray, damping: float = DAMPING) -> np.ndarray:
    """`walk` over one group, as a distribution."""
    return walk(np.zeros(len(scores), "int64"), np.asarray(scores, "float64"), damping) / max(len(scores), 1)


def fuse(items: DataFrame, group: str, item: str, scores: list[str], damping: float = DAMPING, in_task: int = IN_TASK) -> DataFrame:
    """(group, item, mass, place): one row per item, place 1 leads; equal mass is ordered by item.

    `items` has one row per group and item; null and NaN are no score. A group whose items have no score at all is
    ordered by item. mass is a multiple of the group's mean. Groups beyond `in_task` items are walked with distributed
    prefix sums, under the same rule of ending, and give the same order.
    """
    clean = cut(items.select(group, item, *[F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")).alias(s) for s in scores]))
    sizes = clean.groupBy(group).count()
    large = sizes.filter(F.col("count") > in_task).select(group)
    kinds = dict(clean.dtypes)

    def run(t: pa.Table) -> pa.Table:
        _, numbers = np.unique(np.asarray(t.column(group).combine_chunks().dictionary_encode().indices), return_inverse=True)
        values = np.column_stack([t.column(s).to_numpy() for s in scores])
        return pa.table([t.column(group), t.column(item), pa.array(walk(numbers, values, damping))], [group, item, "mass"])

    small = clean if large.isEmpty() else clean.join(large, clean[group].eqNullSafe(large[group]), "left_anti")
    buckets = max(1, -(-clean.count() // BATCH))
    walked = small.withColumn("_bucket", F.pmod(F.xxhash64(group), F.lit(buckets))).groupBy("_bucket").applyInArrow(lambda t: run(t), f"`{group}` {kinds[group]}, `{item}` {kinds[item]}, mass double")
    if small is not clean:
        walked = walked.unionByName(_walk_by_joins(clean.join(large, group, "left_semi"), group, item, scores, damping))
    by = Window.partitionBy(group).orderBy(F.round("mass", DIGITS).desc(), item)  # masses that differ by rounding alone are equal
    return walked.withColumn("place", F.row_number().over(by))


def _walk_by_joins(items: DataFrame, group: str, item: str, scores: list[str], damping: float) -> DataFrame:
    """The same walk for groups of any size. Prefix sums go over the distinct values of a score, range-partitioned into blocks: a
    value that a third of the items share is one row. Items without a score hold what mass the others leave."""
    k = len(scores)
    sizes = items.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    sides = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("side"), F.col(s).alias("s")) for i, s in enumerate(scores)]), lambda x: x["s"].isNotNull())).alias("x")
    scored = items.select(group, item, sides).select(group, item, "x.*")
    values = scored.groupBy(group, "side", "s").agg(F.count(F.lit(1)).alias("n"))
    values = cut(values.repartitionByRange(group, "side", "s").withColumn("block", F.spark_partition_id()))
    lower = Window.partitionBy(group, "side").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(group, "side", "block").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    known = values.groupBy(group, "side").agg(F.sum("n").alias("n_scored"))
    under = values.groupBy(group, "side", "block").agg(F.sum("n").alias("n")).withColumn("n_under", F.coalesce(F.sum("n").over(lower), F.lit(0))).drop("n")
    places = cut(values.join(under, [group, "side", "block"]).join(known, [group, "side"]).withColumn("higher", F.col("n_scored") - F.col("n_under") - F.sum("n").over(upto)).select(group, "side", "s", "block", "higher"))
    whole = F.array(*[F.lit(i) for i in range(k)])
    at = cut(items.select(group, item, F.explode(whole).alias("side")).join(scored, [group, item, "side"], "left").join(known, [group, "side"], "left").join(sizes, group))
    at = cut(at.join(places.select(group, "side", "s", "block", "higher"), [group, "side", "s"], "left").select(group, item, "side", "s", "block", "size", F.coalesce("higher", "n_scored", F.lit(0)).alias("higher")))
    mass = items.select(group, item, F.lit(1.0).alias("mass"))
    for i in range(ROUNDS):
        now = cut(at.join(mass, [group, item]))
        per_value = now.filter("s IS NOT NULL").groupBy(group, "side", "s", "block").agg(F.sum("mass").alias("here"))
        in_block = per_value.withColumn("before", F.sum("here").over(upto) - F.col("here"))
        blocks = per_value.groupBy(group, "side", "block").agg(F.sum("here").alias("sum")).withColumn("under", F.coalesce(F.sum("sum").over(lower), F.lit(0.0))).drop("sum")
        bare = now.filter("s IS NULL").groupBy(group, "side").agg(F.sum("mass").alias("bare"))
        below = in_block.join(blocks, [group, "side", "block"]).join(bare, [group, "side"], "left").select(group, "side", "s", (F.col("before") + F.col("under") + F.coalesce("bare", F.lit(0.0))).alias("below"))
        flow = F.coalesce("below", F.lit(0.0)) / F.col("size") + F.col("mass") * (1 - F.col("higher") / F.col("size"))
        step = now.join(below, [group, "side", "s"], "left").groupBy(group, item).agg((damping * F.sum(flow) / k + (1 - damping)).alias("mass"), F.max("mass").alias("was"))
        step = cut(step)
        moved = step.agg(F.max(F.abs(F.col("mass") - F.col("was")))).first()[0]
        mass = step.drop("was")
        if moved is None or moved < TOLERANCE:
            break
    return mass


def best_scores(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, lexical, vector, rerank): a document's best score per branch, higher is better in each.

    The lexical score comes negative from the store. Branch names count regardless of case and blanks around them; null
    and NaN are no score; rows without query or document, and of other branches, are left out.
    """
    branch = F.lower(F.trim("branch"))
    score = F.nanvl(F.col("score"), F.lit(None).cast("double"))
    known = hits.filter(branch.isin("lexical", "vector", "rerank")).select("query_id", "doc_id", branch.alias("branch"), score.alias("score"))
    pick = lambda b, s: F.max(F.when(F.col("branch") == b, s)).alias(b)
    return (
        known.filter("query_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL")
        .groupBy("query_id", "doc_id")
        .agg(pick("lexical", -F.col("score")), pick("vector", F.col("score")), pick("rerank", F.col("score")))
    )


def leaders(hits: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, doc_id) of the `top` documents per query by the rank walk over the three branches."""
    ranked = fuse(best_scores(hits), "query_id", "doc_id", ["lexical", "vector", "rerank"])
    return ranked.filter(F.col("place") <= top).select(F.col("query_id").cast("long"), F.col("doc_id").cast("long"))


__all__ = ["best_scores", "fuse", "leaders", "stationary", "walk"]
