"""A mix of sources at target weights: whole documents whose sizes add up to each source's budget."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusfold.llm.common import join_ids
from corpusfold.session import write_shared

# Fixed values of the contract: what a word is, the weights in turn, the share of all words, the copies allowed.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
# What is left of a budget after the even part is fitted exactly by dynamic programming below this size.
EXACT = 1 << 16
# The largest rest for which the sums in reach are kept, 4 bytes each; above it the longest texts that fit are taken first.
SUMS = 1 << 24
# Documents of one source and length are ranked in slices of about this many.
SLICE = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, a row per source.

    Sources in order of code points, null last, have the weights in turn. The budget is shared by weight; a source
    stops at ``most`` times its size, and what is above is shared again until none is. In order of (limit / weight)
    those that stop come first, so running sums give the level at which the others end.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    row = (sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights)).cast("int")))
           .withColumn("limit", F.col("source_size") * F.lit(float(most))))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    row = row.withColumn("level", level)
    reached = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(everything)
    return row.withColumn("reached", reached).select(
        "source", "source_size", F.least("limit", F.col("reached") * F.col("weight")).alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of ``counts`` items of each size to take so that the sizes add up to ``budget`` or just below.

    An even share of every size is taken first, then single items by largest remainder until the rest of the
    budget is small, and that is filled by bounded-knapsack dynamic programming over the sums in reach. Memory
    is a few bytes for each word of the rest, which is below the longest text and EXACT, and below SUMS in any case.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    # Room for a few items more lets the sums in reach meet the budget.
    share = max(0, budget - min(EXACT, 4 * int(sizes.max()))) / total
    taken = np.floor(counts * share).astype(np.int64)
    left = budget - int((taken * sizes).sum())
    # Of equal remainders the longest come first: short texts fill what is left.
    order = np.lexsort((-sizes, taken - counts * share))
    order = order[sizes[order] > 0]
    more = order[(np.cumsum(sizes[order]) <= left - EXACT) & (taken[order] < counts[order])]
    taken[more] += 1
    left -= int(sizes[more].sum())
    for i in order[np.argsort(-sizes[order], kind="stable")]:
        if left <= SUMS:
            break
        more_ = min(int(counts[i] - taken[i]), (left - SUMS) // int(sizes[i]) + 1, left // int(sizes[i]))
        taken[i] += more_
        left -= more_ * int(sizes[i])
    if left > SUMS:
        return taken
    # A set of sums is the bits of one integer; a size with many items goes in as 1, 2, 4, ... of them. For each sum the
    # one step that reached it first is kept: those before it come from earlier steps, so no step is used twice.
    reach, limit, items = 1, (1 << (left + 1)) - 1, []
    step_of = np.full(left + 1, -1, np.int32)
    for i in order:
        spare, step = min(int(counts[i] - taken[i]), left // int(sizes[i])), 1
        while spare > 0 and not reach >> left & 1:
            step = min(step, spare)
            new = reach << step * int(sizes[i]) & limit & ~reach
            step_of[_set_bits(new)] = len(items)
            items.append((i, step))
            reach |= new
            spare -= step
            step *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    while at > 0:
        i, step = items[step_of[at]]
        taken[i] += step
        at -= step * int(sizes[i])
    return taken


def _set_bits(number: int) -> np.ndarray:
    held = np.frombuffer(number.to_bytes((number.bit_length() + 7) // 8, "little"), np.uint8)
    at = np.flatnonzero(held)
    row, bit = np.nonzero(np.unpackbits(held[at, None], axis=1, bitorder="little"))
    return at[row] * 8 + bit


def _fit(group: pa.Table) -> pa.Table:
    """One row per length of a source: its ``extra`` items."""
    sizes, counts = group["size"].to_numpy(), group["documents"].to_numpy()
    order = np.lexsort((sizes,))
    extra = np.empty(len(sizes), np.int64)
    extra[order] = fit_counts(sizes[order], counts[order], int(round(group["budget"][0].as_py())))
    return group.append_column("extra", pa.array(extra))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 11,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row.

    ``size`` counts words; null texts have none. ``taken`` is 0, 1 or more times ``size``, ``most`` times at most: a
    source whose target is above its size is taken whole and then in part. Which documents of a length are taken
    is drawn by a hash of their ids, so reruns agree. Rows of one id are rows of their own; an empty table
    gives no rows. A source's histogram has a row per different length and is fitted by one task.
    """
    sized = write_shared(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                     word_count(F.col(text_col)).alias("size")), "sizes")
    lengths = write_shared(sized.groupBy("source", "size").agg(F.count("*").alias("documents")), "lengths")
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"))
    goal = targets(sources, weights, share, most)
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    goal = (goal.withColumn("base", base.cast("bigint"))
            .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
            .withColumnRenamed("source", "of"))
    histogram = lengths.join(goal, lengths["source"].eqNullSafe(goal["of"])).drop("of")
    schema = T.StructType([*histogram.schema, T.StructField("extra", T.LongType())])
    fitted = write_shared(histogram.groupBy("source").applyInArrow(_fit, schema), "fitted")
    plan = fitted.withColumnRenamed("source", "of").withColumnRenamed("size", "length")
    die = F.xxhash64(F.col("doc_id"), F.lit(seed))
    drawn = (sized.join(plan, sized["source"].eqNullSafe(plan["of"]) & (sized["size"] == plan["length"]))
             .withColumn("die", die)
             .withColumn("slice", F.pmod("die", F.ceil(F.col("documents") / SLICE)))
             .select("doc_id", "of", "size", "source_size", "target", "base", "extra", "documents", "die", "slice"))
    # Most lengths are one slice; of the others, each slice gets its share by running counts.
    slices = (drawn.filter(F.col("documents") > SLICE).groupBy("of", "size", "slice").agg(F.count("*").alias("held"))
              .withColumn("before", F.sum("held").over(Window.partitionBy("of", "size").orderBy("slice")) - F.col("held"))
              .select(F.col("of").alias("of_"), F.col("size").alias("size_"), F.col("slice").alias("slice_"), "before"))
    rank = F.row_number().over(Window.partitionBy("of", "size", "slice").orderBy("die", "doc_id"))
    ranked = drawn.withColumn("rank", rank).join(
        slices, F.col("of").eqNullSafe(F.col("of_")) & (F.col("size") == F.col("size_")) & (F.col("slice") == F.col("slice_")), "left")
    once_more = (F.col("rank") + F.coalesce("before", F.lit(0)) <= F.col("extra")).cast("bigint")
    return ranked.select("doc_id", "size", "source_size", "target",
                         (F.col("size") * (F.col("base") + once_more)).alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` as often as the mix takes them; ids must be unique numbers. Texts without words stay out.

    With ids that are close together, such as numbered rows, texts are not shuffled.
    """
    times = (F.col("taken") / F.col("size")).cast("int")
    copies = mixed.filter("taken > 0").select(F.col("doc_id").alias(id_col), F.explode(F.sequence(F.lit(1), times)).alias("_copy"))
    return join_ids(docs, write_shared(copies, "copies"), id_col, "inner", "_copy")
