"""Mixing sources to target weights by fitting budgets with subset sums.

Documents are counted by source and exact length; a source's budget is met by whole repeats of everything, then by a
selection counted by length: an even share over all lengths, and for the remaining budget a bounded knapsack by dynamic programming over the lengths' remaining counts. A seeded hash picks that many documents of
each length. Only counts are grouped by source; documents move once, by source, length and a slice of their hash, so
neither a source nor a length that very many documents share comes together in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, others, settled, ship

#: Slices of the hash, among which documents of one source and length are spread.
SLICES = 256


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, counts at most, for the largest sum that isn't above budget. O(sizes * budget)."""
    took, reach = np.zeros(len(sizes), np.int64), np.zeros(budget + 1, bool)
    reach[0] = True
    last, used = np.full(budget + 1, -1, np.int32), np.zeros(budget + 1, np.int64)
    for k, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        if not 0 < size <= budget or count <= 0:
            continue
        if reach[budget]:
            break
        steps = np.full(budget + 1, count + 1, np.int64)  # fewest of this size that a sum needs on top of the earlier sizes
        steps[reach] = 0
        grid = np.full((-(-(budget + 1) // size)) * size, count + 1, np.int64)
        grid[: budget + 1] = steps
        grid = grid.reshape(-1, size)
        row = np.arange(len(grid))[:, None]
        grid = row - np.maximum.accumulate(np.where(grid == 0, row, -(count + 1) - len(grid)), axis=0)
        need = grid.reshape(-1)[: budget + 1]
        new = (need > 0) & (need <= count) & ~reach
        last[new], used[new] = k, need[new]
        reach |= new
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k = last[at]
        took[k] += used[at]
        at -= int(used[at] * sizes[k])
    return took


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 14) -> np.ndarray:
    """How many documents of each size to take once so that their sizes sum to budget, or to the largest sum found below it.

    A share of all but `window` of the budget comes first, spread evenly over the documents in order of size; the longest
    that leave `window` follow, if that share fell short; the knapsack fits the whole rest, which is at most 4 * window or
    `window` plus the shortest size that is left. If the budget isn't met so and some size is above `window`, that size
    is tried as the window, and the larger sum counts.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    order = np.argsort(-sizes)
    sizes, counts = sizes[order], counts[order]
    marks = np.floor(np.cumsum(counts) * (max(0, budget - window) / total)).astype(np.int64)
    took = np.diff(marks, prepend=0)
    rest = budget - int((took * sizes).sum())
    for k in range(len(sizes)):
        if sizes[k] and rest < 0:  # rounding took too many long ones
            n = min(int(took[k]), -(rest // int(sizes[k])))
        elif sizes[k] and rest > 4 * window:
            n = -min(int(counts[k] - took[k]), (rest - window) // int(sizes[k]))
        else:
            continue
        took[k] -= n
        rest += n * int(sizes[k])
    took += knapsack(sizes, counts - took, rest)
    if window < sizes[0] and (took * sizes).sum() < budget:  # the share's few long texts may leave more than need be
        again = fit_budget(sizes, counts, budget, int(sizes[0]))
        took = max(took, again, key=lambda t: int((t * sizes).sum()))
    out = np.empty_like(took)
    out[order] = took
    return out


def targets(by_source: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """source, source_size, target: shares of share * all sizes by weights that repeat along the sources by code point, null last.

    No target is above most * its source's size; the excess goes to the others by weight until none is above. With the
    sources in the order of cap / weight, that ends at the first one whose cap isn't reached: each later one gets its
    weight times what is left over the weights that are left. by_source has a row for each source: source, source_size.
    """
    line = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(line) - 1, F.lit(len(weights))) + 1)
    ranked = by_source.select("source", "source_size", w.alias("_w"), (F.col("source_size") * F.lit(most)).alias("_cap"))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    all_ = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("_level", level)
    # the water level: of the first source that it doesn't fill
    first = F.min(F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("l")))).over(all_)["l"]
    return levels.withColumn("_first", first).select("source", "source_size", F.when(F.col("_first").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_first") * F.col("_w"))).alias("target"))


def mix(docs: DataFrame, keep: list[str], id_column: str = "doc_id", source: str = "source", size: str = "size", share: float = 1.5, most: int = 2, weights: tuple[int, ...] = (3, 1, 2), seed: int = 7) -> DataFrame:
    """`keep` columns, source, size, source_size, target and taken: the words that the mix takes of each document.

    taken is a multiple of size, at most `most` times it; a document of size 0 is never taken. Sources count as they are, an
    empty one and null too; where a column of `keep` has the name of one that is made, the made one stands. Which documents are taken depends on the seed, ids and lengths alone; of rows with one id,
    source and length it doesn't matter which one is taken.
    """
    keep = others(keep, "source", "size", "source_size", "target", "taken")
    hashed = F.xxhash64(F.lit(seed), F.col(id_column))
    rows = docs.select(*keep, F.col(source).alias("source"), F.col(size).cast("long").alias("size"), F.pmod(hashed, F.lit(SLICES)).cast("int").alias("_slice"), hashed.alias("_hash"), F.col(id_column).alias("_id"))
    slices = rows.groupBy("source", "size", "_slice").agg(F.count("*").alias("_n"))
    lengths = slices.groupBy("source", "size").agg(F.sum("_n").alias("n"))
    by_source = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(by_source, share, float(most), weights)

    def fit(t: pa.Table) -> pa.Table:
        sizes, counts = t.column("size").to_numpy(), t.column("n").to_numpy()
        total, goal = int(t.column("source_size")[0].as_py()), t.column("target")[0].as_py()
        budget = int(np.floor(goal + 0.5))
        whole = min(most, budget // total) if total else 0
        once = fit_budget(sizes, counts, budget - whole * total) if total and whole < most else np.zeros(len(sizes), np.int64)
        return pa.table({"source": t.column("source"), "size": t.column("size"), "source_size": t.column("source_size"), "target": t.column("target"), "_whole": pa.array(np.full(len(sizes), whole)), "_once": pa.array(once)})

    kind = dict(rows.dtypes)["source"]
    ship(docs.sparkSession)
    matched = lengths.alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "size", "n", "source_size", "target")
    plan = matched.groupBy("source").applyInArrow(fit, f"source {kind}, size long, source_size long, target double, _whole long, _once long")
    below = Window.partitionBy("source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = slices.withColumn("_first", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    chosen = first.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))).select("a.source", "a.size", "_slice", "_first", "source_size", "target", "_whole", "_once")
    place = F.row_number().over(Window.partitionBy("source", "size", "_slice").orderBy("_hash", "_id"))
    numbered = rows.withColumn("_place", place)
    out = numbered.alias("d").join(chosen.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")) & (F.col("d._slice") == F.col("c._slice")))
    taken = F.col("d.size") * (F.col("_whole") + F.when(F.col("_first") + F.col("_place") <= F.col("_once"), 1).otherwise(0))
    return out.select(*[F.col(f"d.{k}").alias(k) for k in keep], F.col("d.source").alias("source"), F.col("d.size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs, each row as often as the mix takes it, with all its columns. `how`: as in mix().

    Texts move once, by id and size; rows that have both in common share what the mix takes of them.
    """
    key = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("-")), F.lit(":"), F.col("__size").cast("string"))
    sized = docs.withColumn("__size", word_count(F.col(text)))
    slim = settled(sized.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), F.col("__size").alias("size"), key.alias("__key")), "sizes")
    taken = mix(slim, ["__key"], **how).where("taken > 0").groupBy("__key").agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("__copies"), F.count("*").alias("__n"))
    rows = sized.withColumn("__key", key).drop("__size").join(taken, "__key")
    line = Window.partitionBy("__key").orderBy(F.xxhash64(text))
    share = F.floor(F.col("__copies") / F.col("__rows")) + F.when(F.col("__k") <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    rows = rows.withColumns({"__k": F.row_number().over(line), "__rows": F.count("*").over(Window.partitionBy("__key"))})
    return rows.withColumn("__again", F.explode(F.array_repeat(F.lit(0), share.cast("int")))).select(*docs.columns)
