"""How good a labelling is: inertia, Calinski-Harabasz and silhouette, many labellings at once."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfold.functions.vectors import (
    dense_slices, list_array, list_matrix, pack, squared_distances, vector_columns, vector_size)
from corpusfold.operators.cluster import SLOT_SCHEMA, slot_batch, sum_by_slot
from corpusfold.session import write_shared

# Rows on either side of one block of the exact silhouette: as many as fit these bytes, fewer while there are too few blocks for all cores.
TILE_ROWS, TILE_BYTES = 1_000, 16 << 20
# Distances that a task holds at a time.
PAIR_BYTES = 16 << 20

# The sampled silhouette: relative error of a distance to a cluster, the probability that some is worse, and what a sample may hold.
ERROR, DOUBT, SAMPLE_BYTES = 0.25, 0.1, 512 << 20

METRICS = "k int, distortion double, silhouette double, calinski double"


class Groups(NamedTuple):
    """Per labelling: cluster sizes, means and sums of squared distances to the mean."""
    n: list[np.ndarray]
    mean: list[np.ndarray]
    sse: list[np.ndarray]


def labelling_metrics(df: DataFrame, ks: Sequence[int], features: str = "features",
                      labels: str = "labels", silhouette: str | None = "squared", error: float = ERROR) -> DataFrame:
    """One row per labelling: ``k, distortion, silhouette, calinski``.

    ``labels`` is an ``array<int>``; its j-th entry, in ``0 .. ks[j]-1``, is the row's cluster in the
    j-th labelling. Sums need two passes and are shared by all labellings. ``silhouette`` is
    ``squared`` (squared Euclidean, one pass), ``exact`` (Euclidean, every pair, in blocks: quadratic), ``sampled``
    (Euclidean, estimated in linear time, see ``silhouette``) or None to leave it out.
    """
    ks = list(ks)
    dim = vector_size(df, features)
    points = pack(df.select(*vector_columns(df, features), F.col(labels).alias("labels")), dim)
    groups = _groups(points, dim, ks)
    n = int(groups.n[0].sum())
    if silhouette is None:
        scores = [None] * len(ks)
    elif silhouette == "exact":
        scores = _silhouette_exact(points, dim, ks, groups)
    elif silhouette == "sampled":
        scores = _silhouette_sampled(points, dim, ks, groups, error)
    elif silhouette == "squared":
        scores = _silhouette_squared(points, dim, groups)
    else:
        raise ValueError(f"unknown silhouette: {silhouette!r}")
    rows = [(k, float(groups.sse[j].sum()), scores[j], _calinski(groups, j)) for j, k in enumerate(ks)]
    return df.sparkSession.createDataFrame(rows, METRICS)


def cluster_inertia(df: DataFrame, k: int, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """Sum of squared distances of every row to the mean of its cluster."""
    return _one_labelling(df, k, features, cluster, None).select("k", "distortion")


def calinski_harabasz(df: DataFrame, k: int, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """Spread between clusters over spread within them, each per degree of freedom."""
    return _one_labelling(df, k, features, cluster, None).select("k", "calinski")


def silhouette(df: DataFrame, k: int, method: str = "exact", features: str = "features",
               cluster: str = "cluster", error: float = ERROR) -> DataFrame:
    """Mean over all rows of (b - a) / max(a, b); a row alone in its cluster counts as 0.

    ``sampled`` estimates the Euclidean measure from a sample of each cluster (Altieri et al., "Scalable distributed
    approximation of internal measures for clustering evaluation", SDM 2021): rows are drawn in proportion to their share in
    the distances, at least, so that with probability 1 - DOUBT each row's distance to each cluster is within ``error`` of its value, and
    the silhouette within 4 ``error`` / (1 - ``error``). Clusters not larger than their sample are exact. The sample grows
    with 1 / ``error`` squared and the logarithm of the rows, the work with the rows.
    """
    return _one_labelling(df, k, features, cluster, method, error).select("k", "silhouette")


def _one_labelling(df, k, features, cluster, method, error=None) -> DataFrame:
    labelled = df.select(features, F.array(F.col(cluster).cast("int")).alias("labels"))
    return labelling_metrics(labelled, [k], features, "labels", method, error or ERROR)


def _label_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return list_matrix(batch.column("labels"))


def _groups(points: DataFrame, dim: int, ks: list[int]) -> Groups:
    first = np.cumsum([0] + ks)
    sums = sum_by_slot(points.mapInArrow(_sums(ks, dim), SLOT_SCHEMA), sum(ks), dim,
                       points.rdd.getNumPartitions())
    n, mean = np.zeros(first[-1]), np.zeros((first[-1], dim))
    for slot, count, _, total in sums:
        n[slot], mean[slot] = count, total / count
    # Distances to the finished means, not a difference of two large sums.
    sse = np.zeros(first[-1])
    spread = points.mapInArrow(_spread(mean, ks, dim), "slot int, cost double").groupBy("slot").agg(
        F.sum("cost").alias("cost"))
    for row in spread.collect():
        sse[row["slot"]] = row["cost"]
    cut = [slice(first[j], first[j + 1]) for j in range(len(ks))]
    return Groups([n[c] for c in cut], [mean[c] for c in cut], [sse[c] for c in cut])


def _sums(ks: list[int], dim: int):
    first, slots = np.cumsum([0] + ks[:-1]), sum(ks)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(slots), np.zeros((slots, dim))
        for batch in batches:
            for part, x in dense_slices(batch, dim):
                member = _members(_label_matrix(part) + first, slots)
                n += member.sum(0)
                total += member.T @ x
        used = np.flatnonzero(n)
        if len(used):
            yield slot_batch(used, n[used], np.zeros(len(used)), total[used])
    return sums


def _members(at: np.ndarray, slots: int) -> np.ndarray:
    member = np.zeros((len(at), slots))
    np.put_along_axis(member, at, 1.0, axis=1)
    return member


def _spread(mean: np.ndarray, ks: list[int], dim: int):
    first = np.cumsum([0] + ks[:-1])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = np.zeros(len(mean))
        for batch in batches:
            for part, x in dense_slices(batch, dim):
                at = _label_matrix(part) + first
                for j in range(len(ks)):
                    off = x - mean[at[:, j]]
                    cost += np.bincount(at[:, j], (off * off).sum(1), len(mean))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(mean), dtype=np.int32)), pa.array(cost)], names=["slot", "cost"])
    return spread


def _calinski(groups: Groups, j: int) -> float | None:
    n, mean, within = groups.n[j], groups.mean[j], groups.sse[j].sum()
    rows, k = n.sum(), int((n > 0).sum())
    if k < 2 or rows <= k:
        return None
    off = mean - (n @ mean) / rows
    between = float(n @ (off * off).sum(1))
    # All rows on their cluster means: the ratio is taken as 1.
    return 1.0 if within == 0 else float(between * (rows - k) / (within * (k - 1)))


def _scores(sums: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Silhouette of each row from its summed distances to every cluster."""
    rows = np.arange(len(sums))
    size = n[own]
    a = sums[rows, own] / np.maximum(size - 1, 1)
    others = np.where(n > 0, sums / np.maximum(n, 1), np.inf)
    others[rows, own] = np.inf
    b = others.min(1)
    largest = np.maximum(a, b)
    fine = (size > 1) & np.isfinite(b) & (largest > 0)
    return np.divide(b - a, largest, out=np.zeros(len(sums)), where=fine)


def _silhouette_squared(points: DataFrame, dim: int, groups: Groups) -> list[float]:
    """Squared distances to a whole cluster follow from its mean and spread: one pass, no pairs."""
    rows = int(groups.n[0].sum())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(groups.n))
        for batch in batches:
            for part, x in dense_slices(batch, dim):
                labels = _label_matrix(part)
                for j, (n, mean, sse) in enumerate(zip(*groups)):
                    sums = squared_distances(x, mean) * n + sse
                    total[j] += _scores(sums, labels[:, j], n).sum()
        yield _score_batch(total)

    return _mean_scores(points.mapInArrow(score, SCORE_SCHEMA), rows, len(groups.n))


def _tiles(rows: int, dim: int, cores: int) -> int:
    """Every row travels once per tile, so there are as few as memory allows, but enough for four pairs of tiles per core."""
    enough = math.ceil(math.sqrt(8 * cores))
    return max(1, -(-rows // max(TILE_ROWS, TILE_BYTES // (8 * dim))), min(-(-rows // TILE_ROWS), enough))


def _silhouette_exact(points: DataFrame, dim: int, ks: list[int], groups: Groups) -> list[float]:
    """Every block of rows against every other, once; no pair ever becomes a row.

    Rows are dealt evenly into blocks, so each task meets two blocks of bounded size and hands on
    one array of summed distances per row: all labellings share each distance.
    """
    rows = int(groups.n[0].sum())
    tiles = _tiles(rows, dim, points.sparkSession.sparkContext.defaultParallelism)
    first, slots = np.cumsum([0] + ks[:-1]), sum(ks)
    # Written once, so that a row keeps its number.
    numbered = write_shared(points.withColumn("row", F.monotonically_increasing_id()), "silhouette_rows")
    numbered = numbered.withColumn(
        "tile", F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int"))
    left = numbered.withColumn("other", F.explode(F.sequence("tile", F.lit(tiles - 1))))
    right = numbered.withColumnRenamed("tile", "other").withColumn(
        "tile", F.explode(F.sequence(F.lit(0), "other")))

    def block(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        here, there = np.zeros((a.num_rows, slots)), np.zeros((b.num_rows, slots))
        i = 0
        for part, x in _slices(a, dim):
            j, own = 0, _members(_label_matrix(part) + first, slots)
            for other, y in _slices(b, dim, max(1, PAIR_BYTES // (8 * len(x)))):
                distance = np.sqrt(squared_distances(x, y))
                # A row's distance to itself is nought, which the expanded form may miss.
                distance[np.equal.outer(part.column("row").to_numpy(), other.column("row").to_numpy())] = 0.0
                here[i:i + len(x)] += distance @ _members(_label_matrix(other) + first, slots)
                there[j:j + len(y)] += distance.T @ own
                j += len(y)
            i += len(x)
        found = _block_sums(a, here)
        # A block met with itself has both directions in one.
        return found if key[0].as_py() == key[1].as_py() else pa.concat_tables([found, _block_sums(b, there)])

    partial = (left.groupBy("tile", "other").cogroup(right.groupBy("tile", "other"))
               .applyInArrow(block, "row bigint, labels array<int>, sums array<double>"))
    summed = partial.groupBy("row").agg(
        F.first("labels").alias("labels"),
        Summarizer.sum(array_to_vector(F.col("sums"))).alias("sums"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ks))
        for batch in batches:
            labels = _label_matrix(batch)
            sums = list_matrix(batch.column("sums"))
            for j, k in enumerate(ks):
                total[j] += _scores(sums[:, first[j]:first[j] + k], labels[:, j], groups.n[j]).sum()
        yield _score_batch(total)

    rows_with_sums = summed.select("labels", F.unwrap_udt("sums")["values"].alias("sums"))
    return _mean_scores(rows_with_sums.mapInArrow(score, SCORE_SCHEMA), rows, len(ks))


def _silhouette_sampled(points: DataFrame, dim: int, ks: list[int], groups: Groups, error: float, seed: int = 42) -> list[float]:
    """Four passes: first rows of each cluster, their distances to it, the sample those call for, and the scores.

    All labellings draw by the same number of a row, so their samples overlap and share the distances.
    """
    rows, sizes = int(groups.n[0].sum()), np.concatenate(groups.n)
    first = np.cumsum([0] + ks[:-1])
    wanted = math.ceil(math.log(4 * rows * max(ks) / DOUBT) / (2 * error * error))
    # Written once, so that a row keeps its number: copies of a row are drawn one by one.
    numbered = write_shared(points.withColumn("row", F.monotonically_increasing_id()), "silhouette_rows")
    few = np.minimum(1.0, 2 * math.log(2 * max(ks) / DOUBT) / np.maximum(sizes, 1))
    pilots = _drawn_rows(numbered, dim, len(ks), lambda x, labels: few[labels + first], seed)
    shares = np.zeros((len(pilots.x), len(ks)))
    if len(pilots.x):
        for row in numbered.mapInArrow(_pilot_sums(pilots, dim, len(ks)), "pilot int, labelling int, total double").groupBy(
                "pilot", "labelling").agg(F.sum("total").alias("total")).collect():
            shares[row["pilot"], row["labelling"]] = row["total"]

    def chance(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """At least in proportion to what a row adds to the distances of the pilots of its cluster, and to one over its size."""
        away = np.sqrt(squared_distances(x, pilots.x)) if len(pilots.x) else np.zeros((len(x), 0))
        found = np.empty(labels.shape)
        for j in range(labels.shape[1]):
            share = np.divide(away, shares[:, j], out=np.zeros_like(away), where=shares[:, j] > 0)
            share[labels[:, j][:, None] != pilots.labels[:, j]] = 0.0
            n = sizes[labels[:, j] + first[j]]
            most = np.maximum(1 / n, share.max(1, initial=0.0))
            found[:, j] = np.where(n <= wanted, 1.0, np.minimum(1.0, 2 * wanted * most))
        return found

    sample = _drawn_rows(numbered, dim, len(ks), chance, seed + 1)
    inside = sample.draw[:, None] < sample.chance
    weight = np.zeros((len(sample.x), sum(ks)))
    for j in range(len(ks)):
        own = np.flatnonzero(inside[:, j])
        weight[own, sample.labels[own, j] + first[j]] = 1 / sample.chance[own, j]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ks))
        for batch in batches:
            for part, x in _few_rows(batch, dim, min(len(sample.x), _SAMPLE_ROWS)):
                labels, sums = _label_matrix(part), np.zeros((len(x), sum(ks)))
                for at in range(0, len(sample.x), _SAMPLE_ROWS):
                    some = slice(at, at + _SAMPLE_ROWS)
                    away = np.sqrt(squared_distances(x, sample.x[some]))
                    # A row's distance to itself is nought, which the expanded form may miss.
                    away[np.equal.outer(part.column("row").to_numpy(), sample.row[some])] = 0.0
                    sums += away @ weight[some]
                for j, k in enumerate(ks):
                    total[j] += _scores(sums[:, first[j]:first[j] + k], labels[:, j], groups.n[j]).sum()
        yield _score_batch(total)

    return _mean_scores(numbered.mapInArrow(score, SCORE_SCHEMA), rows, len(ks))


_SAMPLE_ROWS = 1024


class Drawn(NamedTuple):
    x: np.ndarray
    labels: np.ndarray
    row: np.ndarray
    draw: np.ndarray
    chance: np.ndarray


def _drawn_rows(numbered: DataFrame, dim: int, labellings: int, chance, seed: int) -> Drawn:
    """The rows whose number in (0, 1) is below their chance in some labelling; how many is set by the chances, not the rows."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _few_rows(batch, dim, _SAMPLE_ROWS):
                number = (part.column("draw").to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) * 2.0 ** -53
                labels = _label_matrix(part)
                likely = chance(x, labels)
                own = np.flatnonzero((number[:, None] < likely).any(1))
                if len(own):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row").take(own), pa.array(number[own]), list_array(labels[own].astype(np.int32)),
                         list_array(likely[own]), list_array(x[own])], names=["row", "number", "labels", "chance", "vector"])

    numbered = numbered.withColumn("draw", F.xxhash64("row", F.lit(seed)))
    drawn = write_shared(numbered.mapInArrow(draw, "row bigint, number double, labels array<int>, chance array<double>, vector array<double>"),
                         "silhouette_sample")
    if drawn.count() * dim * 8 > SAMPLE_BYTES:
        raise ValueError("the sample of the silhouette is too large: allow a larger error")
    table = drawn.orderBy("row").toArrow()
    if not table.num_rows:
        return Drawn(np.zeros((0, dim)), np.zeros((0, labellings), int), np.zeros(0, int), np.zeros(0), np.zeros((0, labellings)))
    return Drawn(list_matrix(table.column("vector")), list_matrix(table.column("labels")), table.column("row").to_numpy(),
                 table.column("number").to_numpy(), list_matrix(table.column("chance")))


def _pilot_sums(pilots: Drawn, dim: int, labellings: int):
    """Distances of each pilot to all rows of its cluster."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pilots.x), labellings))
        for batch in batches:
            for part, x in _few_rows(batch, dim, len(pilots.x)):
                away, labels = np.sqrt(squared_distances(x, pilots.x)), _label_matrix(part)
                for j in range(labellings):
                    total[:, j] += np.where(labels[:, j][:, None] == pilots.labels[:, j], away, 0.0).sum(0)
        pilot, labelling = np.divmod(np.arange(total.size), labellings)
        yield pa.RecordBatch.from_arrays([pa.array(pilot, pa.int32()), pa.array(labelling, pa.int32()), pa.array(total.reshape(-1))],
                                         names=["pilot", "labelling", "total"])
    return sums


def _few_rows(batch: pa.RecordBatch, dim: int, others: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """``dense_slices`` whose distances to ``others`` rows fit ``PAIR_BYTES``."""
    step = max(1, PAIR_BYTES // (8 * max(others, 1)))
    for start in range(0, batch.num_rows, step):
        yield from dense_slices(batch.slice(start, step), dim)


def _block_sums(block: pa.Table, sums: np.ndarray) -> pa.Table:
    return pa.table({"row": block.column("row"), "labels": block.column("labels"), "sums": list_array(sums)})


def _slices(table: pa.Table, dim: int, most: int = TILE_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in table.to_batches(max_chunksize=most):
        yield from dense_slices(batch, dim)


SCORE_SCHEMA = "labelling int, total double"


def _score_batch(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["labelling", "total"])


def _mean_scores(partial: DataFrame, rows: int, labellings: int) -> list[float]:
    found = partial.groupBy("labelling").agg(F.sum("total").alias("total")).collect()
    total = {r["labelling"]: r["total"] for r in found}
    return [total[j] / rows for j in range(labellings)]
