"""Ranked lexical search, exact: documents as sparse vectors in ball trees, searched best first for the largest inner products.

Ram and Gray, "Maximum inner-product search using cone trees", KDD 2012, for the bound by centre and radius. Here the terms fall
into groups, and each node has a radius for each group: q.c + sum over groups of |q_g| r_g is at least the inner product of q
with every document below the node. Bounds are floating point, rounded up; scores are integers and exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusfold.llm.common import text_slices
from corpusfold.session import spread, write_shared

# A term is a stretch of ASCII letters and digits and of anything beyond ASCII; only A-Z are lowered.
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEPT else 32 for c in range(256))

# Fixed values of the score.
WEIGHT, IMPACT, TF, NORM, MEAN, LENGTH = 1000, 1_000_000_000, 1000, 20, 100, 50
TOP = 50
# Items searched together, and the terms that they may have together (one item may have more); a vocabulary of several such slices
# is counted in one pass over the texts.
SLICE_ITEMS, SLICE_TERMS, VOCABULARY = 256, 16_384, 200_000
# Documents of a tree and of a leaf, groups of terms, and bytes of text worked on at once.
TREE_DOCS, LEAF_DOCS, GROUPS, SLICE_BYTES = 2048, 32, 64, 4 << 20
# Relative slack of bounds: sums of at most 2 x SLICE_TERMS products of numbers that are not negative err by less than 1e-11.
SLACK = 1e-9
# Tasks whose best documents are merged at once.
MERGED = 64

INDEX = "doc_id bigint, n_terms bigint, terms array<int>, counts array<bigint>"
FOUND = "task int, item int, doc_id bigint, score bigint"
_LAST = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, terms``: the different terms of each item, in order of appearance. A row of ``items`` is an item."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column(1), SLICE_BYTES):
                found = [list(dict.fromkeys(terms_of(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(found, pa.list_(pa.binary()))],
                                                 names=["item_id", "terms"])

    return items.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(split, "item_id bigint, terms array<binary>")


class Item(NamedTuple):
    item_id: int | None
    terms: list[bytes]


def vocabularies(items: DataFrame) -> Iterator[list[list[Item]]]:
    """The items of ``item_terms`` in slices, and the slices in lots whose terms are counted together.

    The driver holds one lot: a partition of the items at a time comes to it.
    """
    lot, part, seen, own = [], [], set(), set()
    for row in items.toLocalIterator():
        terms = [bytes(t) for t in row["terms"]]
        if not terms:
            continue
        if part and (len(part) == SLICE_ITEMS or len(own.union(terms)) > SLICE_TERMS):
            lot.append(part)
            part, own = [], set()
            if len(seen) > VOCABULARY:
                yield lot
                lot, seen = [], set()
        part.append(Item(row["item_id"], terms))
        own.update(terms)
        seen.update(terms)
    if part:
        yield lot + [part]


def index_documents(docs: DataFrame, vocabulary: Sequence[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_terms, terms, counts`` of every document that has a term: how often it has those of the vocabulary, by number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            for at, texts in text_slices(batch.column(1), SLICE_BYTES):
                ids, sizes, terms, counts = batch.column(0).slice(at, len(texts)).to_pylist(), [], [], []
                kept = []
                for i, text in zip(ids, texts):
                    words = terms_of(text)
                    if words:
                        held = sorted(Counter(k for k in map(number.get, words) if k is not None).items())
                        kept.append(i)
                        sizes.append(len(words))
                        terms.append([k for k, _ in held])
                        counts.append([n for _, n in held])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                     pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n_terms", "terms", "counts"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(count, INDEX)


class Collection(NamedTuple):
    docs: int
    terms: int
    holders: dict[int, int]
    """Documents that hold a term, by its number."""

    def weight(self, term: int) -> int:
        return math.floor(WEIGHT * math.log((2 * self.docs + 2) / (2 * self.holders.get(term, 0) + 1)))


def collection(index: DataFrame) -> Collection:
    """Statistics of all documents of a written index; what comes to the driver is bounded by the vocabulary."""
    total = index.agg(F.count("*"), F.sum("n_terms")).first()
    holders = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    return Collection(total[0], total[1] or 0, {r["term"]: r["count"] for r in holders})


class Vectors(NamedTuple):
    """Rows of a sparse matrix: ``starts`` has one entry more than there are rows."""
    starts: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray

    def take(self, rows: np.ndarray) -> "Vectors":
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        where = np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return Vectors(np.concatenate([[0], ends]), self.terms[where], self.impacts[where])

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


class Tree:
    """A ball tree: ``centres`` (a column per node) and ``radii`` (a row per node), leaves with their documents."""

    def __init__(self, vectors: Vectors, scale: np.ndarray, group: np.ndarray):
        self.width, self.groups, self.scale, self.group = len(scale), int(group.max()) + 1, scale, group
        self.vectors, centres, radii = vectors, [], []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        self.leaves: dict[int, Vectors] = {}
        waiting = [(np.arange(len(vectors.starts) - 1), None)]
        while waiting:
            rows, parent = waiting.pop()
            own, node = vectors.take(rows), len(centres)
            values, row = own.impacts * scale[own.terms], own.row_numbers()
            centre = np.bincount(own.terms, values, self.width) / len(rows)
            centres.append(centre)
            radii.append(self._radii(own, values, row, centre))
            self.children.append(None)
            self.rows.append(rows)
            if parent is not None:
                left = self.children[parent]
                self.children[parent] = (node, -1) if left is None else (left[0], node)
            if len(rows) <= LEAF_DOCS:
                self.leaves[node] = own
                continue
            near, far = self._split(own, values, row, centre)
            waiting += [(rows[near], node), (rows[far], node)]
        self.centres, self.radii = np.array(centres).T.copy(), np.array(radii)

    def _radii(self, own: Vectors, values: np.ndarray, row: np.ndarray, centre: np.ndarray) -> np.ndarray:
        n, cell = len(own.starts) - 1, row * self.groups + self.group[own.terms]
        size = np.bincount(cell, values * values, n * self.groups).reshape(n, -1)
        inner = np.bincount(cell, values * centre[own.terms], n * self.groups).reshape(n, -1)
        of_centre = np.bincount(self.group, centre * centre, self.groups)
        # The difference may cancel, so the slack is relative to what was subtracted.
        squared = size - 2 * inner + of_centre + SLACK * (size + of_centre)
        return np.sqrt(np.maximum(squared, 0).max(axis=0)) * (1 + SLACK)

    def _split(self, own: Vectors, values: np.ndarray, row: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Halves: nearer to the document farthest from the centre, and nearer to the one farthest from that."""
        n = len(own.starts) - 1
        size = np.bincount(row, values * values, n)

        def away(point: np.ndarray) -> np.ndarray:
            return size - 2 * np.bincount(row, values * point[own.terms], n)

        def document(i: int) -> np.ndarray:
            point = np.zeros(self.width)
            point[own.terms[own.starts[i]:own.starts[i + 1]]] = values[own.starts[i]:own.starts[i + 1]]
            return point

        first = int(away(centre).argmax())
        one = document(first)
        from_one = away(one) + size[first]
        second = int(from_one.argmax())
        order = np.argsort(from_one - (away(document(second)) + size[second]), kind="stable")
        return np.sort(order[:n // 2]), np.sort(order[n // 2:])

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, ids: np.ndarray,
               best: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores and ids, descending) after the documents of this tree; ``dense`` has the weight of every term."""
        query = weights / self.scale[terms]
        norms = np.sqrt(np.bincount(self.group[terms], query * query, self.groups))
        bounds = ((query @ self.centres[terms] + self.radii @ norms) * (1 + SLACK)).tolist()
        scores, found = best
        least = int(scores[-1]) if len(scores) == top else 1
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            # A document below scores at most the bound; one that scores as much as the last may have a smaller id.
            if -bound < least:
                break
            children = self.children[node]
            if children is not None:
                for child in children:
                    heapq.heappush(heap, (max(bound, -bounds[child]), child))
                continue
            leaf = self.leaves[node]
            sums = np.add.reduceat(dense[leaf.terms] * leaf.impacts, leaf.starts[:-1])
            good = sums >= least
            if good.any():
                scores, found = np.concatenate([scores, sums[good]]), np.concatenate([found, ids[self.rows[node][good]]])
                order = np.lexsort((found, -scores))[:top]
                scores, found = scores[order], found[order]
                least = int(scores[-1]) if len(scores) == top else 1
        return scores, found


def search_slice(index: DataFrame, stats: Collection, items: Sequence[Item], number: dict[bytes, int], top: int) -> DataFrame:
    """``task, item, doc_id, score``: each task's best documents for every item, by its place in ``items``."""
    # Terms by the first item that has them, so that terms of one subject or language are neighbours and share a group.
    own = list(dict.fromkeys(number[t] for item in items for t in item.terms))
    local = {term: i for i, term in enumerate(own)}
    weights = np.array([stats.weight(term) for term in own], np.int64)
    queries = [np.array([local[number[t]] for t in item.terms]) for item in items]
    width, docs, total = len(own), stats.docs, stats.terms

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(max(own) + 1, -1)
        place[own] = np.arange(width)
        # An inner product may be shared out between both sides in any way; equal shares keep balls small.
        scale = np.sqrt(np.maximum(weights, 1))
        group = np.arange(width) * min(GROUPS, width) // width
        dense = np.zeros((len(queries), width), np.int32)
        for q, terms in enumerate(queries):
            dense[q, terms] = weights[terms]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]

        def grow(held: list[tuple]) -> None:
            sizes = np.array([len(t) for _, _, t, _ in held])
            ids = np.array([_LAST if i is None else i for i, _, _, _ in held], np.int64)
            # The length enters in whole numbers of any size.
            norm = np.repeat(np.array([MEAN - LENGTH + LENGTH * n * docs // total for _, n, _, _ in held], np.int64), sizes)
            tf = np.concatenate([c for _, _, _, c in held])
            vectors = Vectors(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([t for _, _, t, _ in held]),
                              IMPACT * tf // (TF * tf + NORM * norm))
            tree = Tree(vectors, scale, group)
            for q, terms in enumerate(queries):
                best[q] = tree.search(terms, weights[terms], dense[q], ids, best[q], top)

        held: list[tuple] = []
        for batch in batches:
            starts = batch.column(2).offsets.to_numpy().astype(np.int64)
            terms = place_of(place, batch.column(2).values.to_numpy())
            counts = batch.column(3).values.to_numpy()
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, (i, n) in enumerate(zip(ids, sizes)):
                t, c = terms[starts[k]:starts[k + 1]], counts[starts[k]:starts[k + 1]]
                mine = t >= 0
                if mine.any():
                    held.append((i, n, t[mine], c[mine]))
                    if len(held) == TREE_DOCS:
                        grow(held)
                        held = []
        if held:
            grow(held)
        task = TaskContext.get().partitionId()
        for q, (scores, found) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), task), pa.int32()), pa.array(np.full(len(scores), q), pa.int32()),
                     pa.array(found, pa.int64(), mask=found == _LAST), pa.array(scores, pa.int64())],
                    names=["task", "item", "doc_id", "score"])

    return spread(index).mapInArrow(search, FOUND)


def place_of(place: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Numbers within the slice; -1 for terms of other slices."""
    return np.where(terms < len(place), place[np.minimum(terms, len(place) - 1)], -1)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0, of equal scores the least ids.

    A row is a document, or an item, of its own: repeated rows appear each time (and share an ``item_id``). Null ids stay null
    and come last among equals; null texts have no terms. Empty tables give an empty result.

    The documents are read once for every VOCABULARY terms of the items; their counts are written, and searched by slices of items.
    """
    spark, found = docs.sparkSession, []
    asked = write_shared(item_terms(items, item_col, item_text), "items")
    for lot in vocabularies(asked):
        vocabulary = list(dict.fromkeys(chain.from_iterable(item.terms for part in lot for item in part)))
        number = {t: i for i, t in enumerate(vocabulary)}
        index = write_shared(index_documents(docs, vocabulary, id_col, text_col), "term_counts")
        stats = collection(index)
        if not stats.terms:
            break
        for part in lot:
            names = spark.createDataFrame([(i, item.item_id) for i, item in enumerate(part)], "item int, item_id bigint")
            ranked = best_of(best_of(search_slice(index, stats, part, number, top).withColumn(
                "lot", F.expr(f"task DIV {MERGED}")), ["item", "lot"], top), ["item"], top)
            found.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def best_of(found: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
