"""Sequences of a fixed length from documents, balanced by the Karmarkar-Karp differencing method.

Karmarkar and Karp, "The differencing method of set partitioning", UCB/CSD 82/113 (1982).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusfold.llm.tokens import encoder
from corpusfold.session import write_shared

CAPACITY = 4096
# A block of pieces is packed by one task at a time: about so many sequences.
BLOCK_WINDOWS = 96

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids``: documents as ids with ``end_id`` after each, cut at ``capacity``.

    ``ids`` are little-endian unsigned 32-bit integers. Null texts are empty: their only id is the end.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        step, size = 4 * capacity, 0
        columns: tuple[list, ...] = ([], [], [], [], [])

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.binary()])],
                names=["doc_id", "start", "length", "doc_tokens", "ids"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, data in zip(ids, encode.stream(batch.column(1))):
                data += end
                for at in range(0, len(data), step):
                    piece = data[at:at + step]
                    for c, v in zip(columns, (doc, at // 4, len(piece) // 4, len(data) // 4, piece)):
                        c.append(v)
                    size += len(piece)
                if size > 8_000_000:
                    yield flush()
                    columns, size = ([], [], [], [], []), 0
        if columns[0]:
            yield flush()

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(cut, PIECES)


def karmarkar_karp(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item: ``windows`` groups of nearly equal sums.

    Every item starts as a partial partition of its own. The two with the largest imbalance are merged,
    the fullest window of one with the emptiest of the other, until one partition is left.
    """
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, np.int64)
    left, right = np.full(2 * n, -1, np.int64), np.full(2 * n, -1, np.int64)
    made = n
    # Sums in descending order, and the node that holds the items of each window; windows at nought are left out.
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        shared = max(0, len(a) + len(b) - windows)
        if shared:
            # The last windows of a meet the last of b in the opposite order.
            fresh = np.arange(made, made + shared)
            made += shared
            if made > len(left):
                left = np.concatenate([left, np.full(len(left), -1, np.int64)])
                right = np.concatenate([right, np.full(len(right), -1, np.int64)])
            left[fresh], right[fresh] = a_nodes[len(a) - shared:], b_nodes[len(b) - shared:][::-1]
            sums = np.concatenate([a[:len(a) - shared], b[:len(b) - shared],
                                   a[len(a) - shared:] + b[len(b) - shared:][::-1]])
            nodes = np.concatenate([a_nodes[:len(a) - shared], b_nodes[:len(b) - shared], fresh])
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([a_nodes, b_nodes])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        least = int(sums[-1]) if len(sums) == windows else 0
        sums = sums - least if least else sums  # only differences matter
        heapq.heappush(heap, (-int(sums[0]), turn, sums, nodes))
        turn += 1
    out = np.zeros(n, np.int64)
    for window, node in enumerate(heap[0][3]):
        stack = [int(node)]
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = window
            else:
                stack += [int(left[x]), int(right[x])]
    return out


def fill_windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each item, none over ``capacity``: more windows whenever one would be."""
    full = sizes >= capacity
    out = np.empty(len(sizes), np.int64)
    out[full] = np.arange(full.sum())
    rest = sizes[~full]
    if len(rest):
        windows = max(1, -(-int(rest.sum()) // capacity))
        while True:
            found = karmarkar_karp(rest, windows)
            over = int(np.bincount(found, rest).max()) - capacity
            if over <= 0:
                break
            windows += max(1, windows * over // (4 * capacity))
        out[~full] = full.sum() + found
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``pieces`` (``doc_id, start, length`` and any more) with ``sequence_id`` and ``offset``.

    Pieces are dealt by a hash of what they are and of their row into blocks of about ``block_windows`` sequences, so that
    pieces without an id, or copies of one, are spread like all others; each block is packed by differencing. Padding is what near-equal windows leave, well under one window in a hundred for blocks of
    the usual size. Columns of those two names are replaced. An empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    stored = write_shared(pieces, "pieces")
    total = stored.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(total / (capacity * block_windows)))

    def pack(block: pa.Table) -> pa.Table:
        keys = block.select(["length", "doc_id", "start"]).to_pandas()
        order = keys.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").index
        sizes = keys["length"].to_numpy()[order]
        windows = fill_windows(sizes, capacity)
        by_window = np.argsort(windows, kind="stable")
        sums = np.cumsum(sizes[by_window]) - sizes[by_window]
        firsts = np.r_[True, np.diff(windows[by_window]) > 0]
        offset = sums - np.maximum.accumulate(np.where(firsts, sums, 0))
        rows = block.drop(["_block"]).take(pa.array(np.asarray(order)[by_window]))
        ids = (int(block["_block"][0].as_py()) << 32) + windows[by_window]
        return rows.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    schema = T.StructType([*stored.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    row = F.xxhash64("doc_id", "start", F.monotonically_increasing_id())
    return (stored.withColumn("_block", F.pmod(row, F.lit(blocks)))
            .groupBy("_block").applyInArrow(pack, schema))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids``: the ids of each sequence, padded; a power of two stays as it is."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
    held = (F.octet_length("ids") / 4).cast("bigint")
    pad = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), (F.lit(capacity) - held).cast("int")))
    return joined.withColumn("ids", F.when(held.bitwiseAND(held - 1) == 0, F.col("ids")).otherwise(F.concat("ids", pad)))
