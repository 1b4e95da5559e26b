"""KMeans: single fits, and the sweep over numbers of clusters and restarts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfold.functions.vectors import (
    TASK_BYTES, dense_slices, list_array, list_matrix, pack, squared_distances, vector_columns, vector_size)

SEED, RESTARTS, MAX_ITER, TOLERANCE = 42, 10, 300, 1e-4

# Rounds that draw candidates for the starts; attempts at clustering these, and their rounds of Lloyd.
ROUNDS, TRIES, POLISH = 4, 3, 10
# Tasks whose draws come to the driver.
MERGERS = 32

# Centres of all fits that run side by side; each task holds them and their sums once.
STATE_BYTES = 64 << 20
# Vectors are kept for the passes in blocks of about so many bytes.
BLOCK_BYTES = 4 << 20


class Fit(NamedTuple):
    k: int
    centers: np.ndarray
    cost: float


def kmeans(df: DataFrame, k: int, features: str = "features", seed: int = SEED,
           max_iter: int = MAX_ITER) -> KMeansModel:
    """One Spark ML fit."""
    if not isinstance(df.schema[features].dataType, VectorUDT):
        df = df.withColumn(features, array_to_vector(F.col(features)))
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=features,
                  predictionCol="cluster").fit(df)


def kmeans_best(df: DataFrame, k: int, features: str = "features", restarts: int = RESTARTS,
                seed: int = SEED, max_iter: int = MAX_ITER) -> Fit:
    """The restart with the lowest inertia."""
    return fit_all(df, [k], features, restarts, seed, max_iter)[0]


def fit_all(df: DataFrame, ks: Sequence[int], features: str = "features", restarts: int = RESTARTS,
            seed: int = SEED, max_iter: int = MAX_ITER, tol: float = TOLERANCE) -> list[Fit]:
    """The best of ``restarts`` fits for every k, all of them sharing each pass over the vectors.

    Fitting one by one would read the vectors (number of k) x restarts x iterations times; side by
    side they are read once per iteration. The driver only sees centres and sums: a size set by
    k, restarts and dimensions, never by rows. Pass a written table, as every pass reads it.
    """
    dim = vector_size(df, features)
    # The same for sparse and dense vectors.
    values = F.col(features)
    if isinstance(df.schema[features].dataType, VectorUDT):
        values = vector_to_array(values)
    points = as_blocks(pack(df.select(*vector_columns(df, features), F.xxhash64(values, F.lit(seed)).alias("draw")), dim))
    try:
        per_restart = sum(ks) * dim * 8
        together = max(1, min(restarts, STATE_BYTES // per_restart))
        best: dict[int, Fit] = {}
        for first in range(0, restarts, together):
            lanes = range(first, min(first + together, restarts))
            for fit in _fit_lanes(points, dim, list(ks), lanes, seed, max_iter, tol):
                if fit.k not in best or fit.cost < best[fit.k].cost:
                    best[fit.k] = fit
        return [best[k] for k in ks]
    finally:
        points.unpersist()


def as_blocks(points: DataFrame) -> RDD:
    """The rows as Arrow batches in bytes, kept for many passes.

    A pass over them is a job without a plan of its own, and no value is converted on its way to Python: with hundreds of
    passes over a table of narrow rows, both cost more than the distances.
    """
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, BLOCK_BYTES * batch.num_rows // max(batch.nbytes, 1))
            for start in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_arrays([pa.array([_to_bytes(batch.slice(start, step))], pa.binary())], names=["block"])

    return points.mapInArrow(block, "block binary").rdd.map(lambda row: bytes(row["block"])).persist(StorageLevel.MEMORY_AND_DISK)


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _from_bytes(blocks: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    for block in blocks:
        yield from pa.ipc.open_stream(block)


def _pass(points: RDD, step) -> RDD:
    """What ``step`` makes of the batches of each task, in bytes again."""
    return points.mapPartitions(lambda blocks: map(_to_bytes, step(_from_bytes(blocks))))


def _collect(found: RDD) -> pa.Table | None:
    batches = list(_from_bytes(found.collect()))
    return pa.Table.from_batches(batches) if batches else None


def _fit_lanes(points: RDD | DataFrame, dim: int, ks: list[int], lanes: range, seed: int,
               max_iter: int, tol: float) -> Iterator[Fit]:
    if isinstance(points, DataFrame):
        points = as_blocks(points)
    tasks = points.getNumPartitions()
    running = _starts(points, tasks, dim, ks, lanes, seed)
    limit = None
    for _ in range(max_iter):
        sums = _lloyd_pass(points, tasks, dim, [c for _, c in running])
        if limit is None:
            n, norms, total = sums[-1]
            limit = tol * max(norms / n - (total / n) @ (total / n), 0.0) / dim
        left, slot = [], 0
        for k, centers in running:
            moved, cost = centers.copy(), 0.0
            for c in range(k):
                n, part, total = sums.get(slot + c, (0, 0.0, None))
                if n:
                    moved[c] = total / n
                    cost += part
            slot += k
            if ((moved - centers) ** 2).sum() <= limit:
                yield Fit(k, moved, cost)
            else:
                left.append((k, moved, cost))
        if not left:
            return
        running = [(k, c) for k, c, _ in left]
    yield from (Fit(*fit) for fit in left)


def _starts(points: RDD, tasks: int, dim: int, ks: list[int], lanes: range, seed: int) -> list[tuple[int, np.ndarray]]:
    """``(k, centres)`` to start from, for every k and lane, after ROUNDS + 1 passes over the vectors.

    Bahmani et al., "Scalable k-means++", VLDB 2012: each round draws as many candidates as the largest k at once, in
    proportion to the squared distance to those drawn before. One more pass counts the rows nearest to each candidate, and
    the candidates with these weights are clustered on the driver; there are max(k) x ROUNDS of them per lane.
    """
    candidates = [np.empty((0, dim)) for _ in lanes]
    for step in range(ROUNDS):
        drawn = _smallest(_pass(points, _draw(candidates, dim, [(seed, lane, step) for lane in lanes], max(ks))), tasks, max(ks))
        candidates = [np.concatenate([own, drawn[i]]) if i in drawn else own for i, own in enumerate(candidates)]
    weights = [np.zeros(len(c)) for c in candidates]
    counts = _pass(points, _weigh(candidates, dim)).mapPartitions(_counts).reduceByKey(add, min(tasks, MERGERS))
    for (lane, candidate), n in counts.collect():
        weights[lane][candidate] = n
    return [(k, _recluster(candidates[i], weights[i], k, np.random.default_rng([seed, lane, k])))
            for k in ks for i, lane in enumerate(lanes)]


def _counts(blocks: Iterator[bytes]) -> Iterator[tuple[tuple[int, int], int]]:
    for batch in _from_bytes(blocks):
        lane, candidate, n = (batch.column(c).to_pylist() for c in ("lane", "candidate", "n"))
        yield from zip(zip(lane, candidate), n)


def _smallest(drawn: RDD, tasks: int, want: int) -> dict[int, np.ndarray]:
    """Per lane the ``want`` vectors with the least keys, of as many from each task."""
    if tasks > MERGERS:
        # Dealt out and cut down once more, so that the driver hears from a bounded number of tasks.
        drawn = _pass(drawn.repartition(MERGERS), _keep_smallest(want))
    table = _collect(drawn)
    if table is None:
        return {}
    lane, key = table.column("lane").to_numpy(), table.column("key").to_numpy()
    vectors = list_matrix(table.column("vector"))
    order = np.lexsort((key, lane))
    return {int(i): vectors[order[lane[order] == i][:want]] for i in np.unique(lane)}


def _keep_smallest(want: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[float, np.ndarray]]] = {}
        for batch in batches:
            lanes, keys = batch.column("lane").to_pylist(), batch.column("key").to_pylist()
            for lane, key, vector in zip(lanes, keys, list_matrix(batch.column("vector"))):
                best = held.setdefault(lane, [])
                if len(best) < want or key < best[-1][0]:
                    best.append((key, vector))
                    best.sort(key=lambda b: b[0])
                    del best[want:]
        yield from _drawn_batch([(lane, key, v) for lane, best in held.items() for key, v in best])
    return keep


def _drawn_batch(found: list[tuple[int, float, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found]),
             list_array(np.stack([f[2] for f in found]))], names=["lane", "key", "vector"])


def _recluster(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres of weighted candidates: k-means++ and a few rounds of Lloyd, the best of TRIES."""
    best, least = None, np.inf
    for _ in range(TRIES):
        at = [rng.choice(len(candidates), p=weights / weights.sum())]
        away = squared_distances(candidates, candidates[at])[:, 0]
        while len(at) < k:
            share = weights * away
            # With fewer different rows than centres some are repeated.
            at.append(rng.choice(len(candidates), p=share / share.sum()) if share.sum() > 0 else at[0])
            away = np.minimum(away, squared_distances(candidates, candidates[at[-1:]])[:, 0])
        centers = candidates[at]
        for _ in range(POLISH):
            label = squared_distances(candidates, centers).argmin(1)
            member = np.zeros((len(candidates), k))
            member[np.arange(len(candidates)), label] = weights
            n = member.sum(0)
            centers = np.where(n[:, None] > 0, (member.T @ candidates) / np.maximum(n, 1)[:, None], centers)
        cost = float(weights @ squared_distances(candidates, centers).min(1))
        if cost < least:
            best, least = centers, cost
    return best


def _uniform(draw: np.ndarray, stream: tuple[int, int, int]) -> np.ndarray:
    """A number in (0, 1) per row and stream; it depends on the row only, so a rerun task draws the same."""
    salt = np.random.SeedSequence(stream).generate_state(1, np.uint64)[0]
    x = draw.view(np.uint64) ^ salt
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53


def _nearest_of_lanes(x: np.ndarray, candidates: list[np.ndarray]) -> Iterator[np.ndarray | None]:
    """Squared distances of the rows to the candidates of each lane; None for a lane without any."""
    ends = np.cumsum([len(c) for c in candidates])
    away = squared_distances(x, np.concatenate(candidates)) if ends[-1] else None
    for c, end in zip(candidates, ends):
        yield away[:, end - len(c):end] if len(c) else None


def _draw(candidates: list[np.ndarray], dim: int, streams: list[tuple[int, int, int]], want: int):
    """A draw from weights w takes the rows with the least -ln(u)/w, u uniform: no total is needed beforehand."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [np.empty(0) for _ in candidates]
        vectors = [np.empty((0, dim)) for _ in candidates]
        for batch in batches:
            for part, x in dense_slices(batch, dim):
                rows = part.column("draw").to_numpy()
                for lane, away in enumerate(_nearest_of_lanes(x, candidates)):
                    key = -np.log(_uniform(rows, streams[lane]))
                    if away is not None:
                        # A row that is a candidate already is not drawn again.
                        w = away.min(1)
                        key = np.divide(key, w, out=np.full(len(x), np.inf), where=w > 0)
                    found = np.argsort(key, kind="stable")[:want]
                    found = found[np.isfinite(key[found])]
                    merged = np.concatenate([keys[lane], key[found]])
                    least = np.argsort(merged, kind="stable")[:want]
                    vectors[lane] = np.concatenate([vectors[lane], x[found]])[least]
                    keys[lane] = merged[least]
        yield from _drawn_batch([(lane, float(key), v) for lane in range(len(candidates)) for key, v in zip(keys[lane], vectors[lane])])
    return draw


def _weigh(candidates: list[np.ndarray], dim: int):
    """How many rows are nearest to each candidate."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(c), np.int64) for c in candidates]
        for batch in batches:
            for _, x in dense_slices(batch, dim):
                for lane, away in enumerate(_nearest_of_lanes(x, candidates)):
                    counts[lane] += np.bincount(away.argmin(1), minlength=len(counts[lane]))
        lane = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        at, n = np.concatenate([np.arange(len(c)) for c in counts]), np.concatenate(counts)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(lane[used], pa.int32()), pa.array(at[used], pa.int32()), pa.array(n[used], pa.int64())],
                                         names=["lane", "candidate", "n"])
    return weigh


def _lloyd_pass(points: RDD, tasks: int, dim: int, runs: list[np.ndarray]) -> dict:
    """Per centre (numbered through all runs): rows assigned, their inertia and their sum.

    Entry -1 is the whole table: rows, sum of squared lengths, sum. Small sums come to the driver from each task, larger ones
    are dealt out by slot and added up first.
    """
    slots = sum(len(c) for c in runs) + 1
    found = _pass(points, _assign_and_sum(runs, dim))
    size = slots * dim * 8 * tasks
    if size > TASK_BYTES:
        share = min(-(-size // TASK_BYTES), slots, points.context.defaultParallelism)
        found = found.mapPartitions(_dealt(share)).partitionBy(share, int).values().mapPartitions(
            lambda blocks: map(_to_bytes, _add_up(_from_bytes(blocks))))
    return {slot: (n, cost, total) for batch in _add_up(_from_bytes(found.collect())) for slot, n, cost, total in _slots(batch)}


def _dealt(share: int):
    """The slots of each batch by their remainder."""
    def deal(blocks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
        for batch in _from_bytes(blocks):
            to = batch.column("slot").to_numpy() % share
            for i in np.unique(to):
                yield int(i), _to_bytes(batch.take(pa.array(np.flatnonzero(to == i))))
    return deal


def _slots(batch: pa.RecordBatch) -> Iterator[tuple[int, int, float, np.ndarray]]:
    return zip(*(batch.column(c).to_pylist() for c in ("slot", "n", "cost")), list_matrix(batch.column("total")))


SLOT_SCHEMA = "slot int, n bigint, cost double, total array<double>"


def sum_by_slot(partial: DataFrame, slots: int, dim: int, tasks: int) -> list[tuple[int, int, float, np.ndarray]]:
    """Add up what ``tasks`` tasks found per slot; slots are dealt out, and each is summed as it streams in."""
    if tasks > 1:
        share = -(-slots * dim * 8 * tasks // TASK_BYTES)
        cores = partial.sparkSession.sparkContext.defaultParallelism
        partial = partial.repartition(min(share, slots, cores), "slot").mapInArrow(_add_up, SLOT_SCHEMA)
    summed = partial.toArrow()
    return list(zip(summed.column("slot").to_pylist(), summed.column("n").to_pylist(),
                    summed.column("cost").to_pylist(), list_matrix(summed.column("total"))))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for slot, n, cost, total in _slots(batch):
            known = sums.setdefault(slot, [0, 0.0, 0.0])
            known[0] += n
            known[1] += cost
            known[2] = known[2] + total
    if sums:
        n, cost, total = zip(*sums.values())
        yield slot_batch(np.array(list(sums)), np.array(n), np.array(cost), np.stack(total))


def slot_batch(slots: np.ndarray, n: np.ndarray, cost: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(slots.astype(np.int32)), pa.array(n.astype(np.int64)),
         pa.array(cost.astype(float)), list_array(total)], names=["slot", "n", "cost", "total"])


def _nearest(x: np.ndarray, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each run and the squared distance to it, both runs x rows.

    Distances lie in a row per centre, and those of a run are met one after the other for all points at once: a search of its own
    for each point and run takes longer than the distances do.
    """
    centers = np.concatenate(runs)
    d = (-2.0 * centers) @ x.T
    d += (centers * centers).sum(1)[:, None]
    label, least = np.zeros((len(runs), len(x)), np.int64), np.empty((len(runs), len(x)))
    start = 0
    for j, own in enumerate(runs):
        best, at = d[start], label[j]
        for c in range(1, len(own)):
            other = d[start + c]
            # Of equal distances the first stays.
            np.copyto(at, c, where=other < best)
            np.minimum(best, other, out=best)
        least[j] = best
        start += len(own)
    least += (x * x).sum(1)
    return label, np.maximum(least, 0.0, out=least)


def _assign_and_sum(runs: list[np.ndarray], dim: int):
    sizes = [len(c) for c in runs]
    first = np.cumsum([0] + sizes[:-1])
    slots = sum(sizes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, total = np.zeros(slots + 1), np.zeros(slots + 1), np.zeros((slots + 1, dim))
        for batch in batches:
            for _, x in dense_slices(batch, dim):
                label, least = _nearest(x, runs)
                at = label + first[:, None]
                member = np.zeros((slots, len(x)))
                member[at, np.arange(len(x))] = 1.0
                n[:slots] += np.bincount(at.ravel(), minlength=slots)
                cost[:slots] += np.bincount(at.ravel(), least.ravel(), slots)
                total[:slots] += member @ x
                n[slots] += len(x)
                cost[slots] += (x * x).sum()
                total[slots] += x.sum(0)
        used = np.flatnonzero(n)
        if len(used):
            names = np.where(used == slots, -1, used)
            yield slot_batch(names, n[used], cost[used], total[used])
    return assign


def assign_all(df: DataFrame, runs: Sequence[np.ndarray], features: str = "features",
               labels: str = "labels") -> DataFrame:
    """Add ``labels array<int>``: the nearest centre in each run. Narrow, and free of shuffles."""
    runs, dim = list(runs), runs[0].shape[1]

    # Only the vectors go to Python; the other columns wait in the JVM.
    @F.arrow_udf("array<int>")
    def label(idx: pa.Array, val: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([idx, val], names=["v_idx", "v_val"])
        found = [np.ascontiguousarray(_nearest(x, runs)[0].T) for _, x in dense_slices(batch, dim)]
        return list_array(np.concatenate(found or [np.empty((0, len(runs)))]).astype(np.int32))

    idx, val = vector_columns(df, features)
    return df.withColumn(labels, label(idx, val))


def assign(df: DataFrame, centers: np.ndarray, features: str = "features",
           cluster: str = "cluster") -> DataFrame:
    """Add ``cluster``: the nearest centre."""
    labelled = assign_all(df, [np.asarray(centers)], features, "_labels")
    return labelled.withColumn(cluster, F.col("_labels")[0]).drop("_labels")
