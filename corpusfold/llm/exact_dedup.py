"""Exact duplicates found with a two-pass Bloom filter: only possibly repeated rows are shuffled."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.session import working_root, write_shared

# One bitmap of Spark's bitmap functions; a bucket of the filter.
BUCKET_BITS = 32768
CELLS_PER_ROW = 16
PROBES = 3
# 4 KB each, so that at most 64 MB are broadcast at a time.
SLICE_BUCKETS = 16384
# Neighbouring buckets whose bits travel as one row, at most; a filter has about 32 such segments or more.
SEGMENT_BUCKETS = 1024
# Rows whose cells a task holds before it hands on their bits: about 100 MB.
CHUNK_ROWS = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _places(mark: Column, buckets: int) -> tuple[Column, list[Column]]:
    """Bucket and cells of a 64-bit hash: other bits of the hash for each."""
    bucket = F.pmod(F.xxhash64(mark), F.lit(buckets))
    return bucket, [F.shiftrightunsigned(mark, 15 * i).bitwiseAND(F.lit(BUCKET_BITS - 1)) for i in range(PROBES)]


def _pack(cells: np.ndarray, first: int, segment: int) -> bytes:
    """A sparse bitmap: how many cells each bucket of the segment has, then two bytes a cell, ascending."""
    held = np.bincount((cells // BUCKET_BITS - first).astype(np.int64), minlength=segment)
    return held.astype("<u4").tobytes() + (cells % BUCKET_BITS).astype("<u2").tobytes()


def _unpack(data: bytes, segment: int) -> np.ndarray:
    """Cells of a sparse bitmap, counted from the start of the segment."""
    held = np.frombuffer(data, "<u4", segment)
    return np.repeat(np.arange(segment) * BUCKET_BITS, held) + np.frombuffer(data, "<u2", offset=4 * segment)


def partial_bits(marks: DataFrame, buckets: int, segment: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``segment, seen, twice``: sparse bitmaps of the cells that one, and that several, rows of a chunk fall on.

    A chunk is up to ``chunk_rows`` rows of a partition of ``marks`` (column ``mark``). A row that occurs often sets its
    bits once per chunk.
    """
    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells = np.concatenate(parts, axis=1)
        # A row whose probes meet counts once on that cell.
        own = np.ones(cells.shape, bool)
        for i in range(1, PROBES):
            own[i] = (cells[i] != cells[:i]).all(axis=0)
        cells, rows = np.unique(cells[own], return_counts=True)
        segments = cells // (segment * BUCKET_BITS)
        for at in np.unique(segments):
            of = slice(*np.searchsorted(segments, [at, at + 1]))
            seen, twice = (_pack(c, int(at) * segment, segment) for c in (cells[of], cells[of][rows[of] > 1]))
            yield pa.RecordBatch.from_pydict({"segment": pa.array([at], pa.int64()), "seen": pa.array([seen], pa.binary()),
                                              "twice": pa.array([twice], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                bucket, *cells = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                parts.append(np.stack(cells) + bucket * BUCKET_BITS)
                held += batch.num_rows
            if held >= chunk_rows:
                yield from flush(parts)
                parts, held = [], 0
        if held:
            yield from flush(parts)

    bucket, cells = _places(F.col("mark"), buckets)
    placed = marks.select(bucket.alias("bucket"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    return placed.mapInArrow(run, "segment bigint, seen binary, twice binary")


def repeated_cells(marks: DataFrame, buckets: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """First pass: ``bucket, bits``, a bit for each cell that two or more rows fall on.

    ``marks`` has the hash of each row as ``mark``. Only bitmaps are shuffled, a row per chunk and segment of the filter
    with two bytes a cell, and united in one byte per cell of a segment: 32 MB.
    """
    segment = min(SEGMENT_BUCKETS, -(-buckets // 32))

    def unite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros(segment * BUCKET_BITS, np.uint8)
        for part in parts:
            first = part["segment"][0].as_py() * segment
            for seen, twice in zip(part["seen"], part["twice"]):
                at = _unpack(seen.as_py(), segment)
                rows[at] = np.minimum(rows[at] + 1, 2)
                rows[_unpack(twice.as_py(), segment)] = 2
        bits = np.packbits((rows == 2).reshape(segment, BUCKET_BITS), axis=1, bitorder="little")
        found = np.flatnonzero(bits.any(axis=1))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(found + first, pa.int64()),
                                          "bits": pa.array([bits[i].tobytes() for i in found], pa.binary())})

    return (partial_bits(marks, buckets, segment, chunk_rows).groupBy("segment")
            .applyInArrow(unite, "bucket bigint, bits binary"))


def _is_set(bits: Column, cell: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(cell, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return F.getbit(byte, F.pmod(cell, F.lit(8)).cast("int")) == 1


def possibly_repeated(marked: DataFrame, cells_per_row: int = CELLS_PER_ROW,
                      slice_buckets: int = SLICE_BUCKETS) -> DataFrame:
    """``marked``, a written table with the hash of each row as ``mark``, and ``maybe``: false for rows that are certainly alone.

    The filter grows with the rows, and is broadcast a slice of ``slice_buckets`` at a time. Rows are written by slice
    first where there are several, so that each slice reads its own rows only; no row is shuffled.
    """
    buckets = max(1, -(-marked.count() * cells_per_row // BUCKET_BITS))
    bits = write_shared(repeated_cells(marked.select("mark"), buckets), "bloom")
    bucket, cells = _places(F.col("mark"), buckets)
    placed = marked.withColumn("_bucket", bucket)
    slices = -(-buckets // slice_buckets)
    if slices > 1:
        path = f"{working_root(marked.sparkSession)}/corpusfold/{uuid.uuid4().hex}/slices"
        sliced = placed.withColumn("_slice", F.floor(F.col("_bucket") / slice_buckets).cast("int"))
        sliced.write.partitionBy("_slice").parquet(path)
        placed = marked.sparkSession.read.schema(sliced.schema).parquet(path)
    every = F.lit(True)
    for cell in cells:
        every = every & _is_set(F.col("bits"), cell)
    tested = []
    for i in range(slices):
        rows, part = placed, bits.withColumnRenamed("bucket", "_bucket")
        if slices > 1:
            rows = rows.filter(F.col("_slice") == i)
            part = part.filter(F.col("_bucket").between(i * slice_buckets, (i + 1) * slice_buckets - 1))
        rows = rows.join(F.broadcast(part), "_bucket", "left")
        tested.append(write_shared(rows.select(*marked.columns, F.coalesce(every, F.lit(False)).alias("maybe")), "tested"))
    return reduce(DataFrame.unionByName, tested)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     cells_per_row: int = CELLS_PER_ROW, slice_buckets: int = SLICE_BUCKETS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Texts are equal when they are after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest id stays (a null id is the smallest); of repeated rows with that id, one stays.
    ``group_size`` counts rows. An empty table gives no rows, and further columns are ignored.

    Pass one marks the cells of a Bloom filter that more than one row falls on; bitmaps are all that it shuffles.
    Pass two keeps apart the rows all of whose cells are marked: repeated ones, and about one in 200 of the others. Only
    those, without their texts, are shuffled and grouped by SHA-256. All others are certainly alone.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm"))
    # Small rows: the two passes and the result read this table, not the texts again.
    marked = write_shared(rows.select(
        "doc_id", F.xxhash64("norm").alias("mark"), F.sha2("norm", 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row")), "marks")
    tested = possibly_repeated(marked, cells_per_row, slice_buckets)
    alone = tested.filter("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    maybe = tested.filter("maybe").select("doc_id", "row", "text_sha256")
    # A row per text after partial sums, written: in the join back a text with most rows is no part of an aggregation, and
    # can be split, or its few texts broadcast.
    groups = write_shared(maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("best"),
                                                           F.count("*").alias("group_size")), "groups")
    again = maybe.join(groups, "text_sha256").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
    return alone.unionByName(again)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops; ids must be unique here."""
    dropped = exact_duplicates(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias(id_col))
    return docs.join(dropped, id_col, "left_anti")
