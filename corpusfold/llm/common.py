"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusfold.session import is_small, working_root, write_shared

LEAST = -(1 << 63)


class Scratch:
    """Working tables in one folder of the shared storage, removed together once no result reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{working_root(spark)}/corpusfold/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """As ``write_shared``."""
        path = f"{self.root}/{uuid.uuid4().hex}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_ids(rows: DataFrame, ids: DataFrame, id_col: str, how: str, *by: str, write=write_shared) -> DataFrame:
    """``rows`` joined (``how``: left_semi, left_anti, inner) with a written table of whole numbers, and no column of it.

    The ids become maps of a bit for each of 32768 neighbours, broadcast while they are small: for numbered rows that is a
    bit a row, and ``rows`` is not shuffled. Ids that lie too far apart, or are too many, are joined as they are. In an
    inner join an id has a row for each value of ``by`` that it occurs with, and as many times its row is returned.
    """
    number = F.col(id_col)
    maps = write(ids.groupBy(*by, F.bitmap_bucket_number(number).alias("_map")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits")), "maps")
    if not is_small(maps):
        return rows.join(ids.select(id_col, *by).distinct(), id_col, how).select(*rows.columns)
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (place % 8).cast("int")) == 1
    return rows.join(F.broadcast(maps), (F.bitmap_bucket_number(number) == F.col("_map")) & held, how).select(*rows.columns)


def longs(values: Sequence[int]) -> Column:
    """A constant array of longs, built by the SQL parser in one call."""
    if not values:
        return F.expr("CAST(array() AS array<bigint>)")
    return F.expr("array(" + ", ".join("CAST('%d' AS bigint)" % v for v in values) + ")")


def range_of(splitters: Sequence[int], key: Column, ties: Sequence[int] | None = None,
             tie: Column | None = None) -> Column:
    """How many of the ascending splitters are at most ``key``, by binary search inside the JVM.

    With ``ties``, splitters and keys are pairs compared in order. The splitters are a constant
    in the plan, so callers bound their number.
    """
    firsts = longs(splitters)
    seconds = longs(ties) if ties is not None else None

    def reached(at: Column) -> Column:
        first = F.get(firsts, at)
        if seconds is None:
            return first <= key
        return (first < key) | ((first == key) & (F.get(seconds, at) <= tie))

    step, steps = 1, []
    while step <= len(splitters):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    # Past the end get() is null, and the position stays.
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0),
                       lambda at, s: F.when(reached(at + s - 1), at + s).otherwise(at))


def text_slices(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of neighbouring texts of at most ``max_bytes`` together (or one longer text), each with its first row.

    Texts come as UTF-8, whole; null is empty.
    """
    data = pc.fill_null(texts.cast(pa.binary()), b"")
    ends = np.cumsum(pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(data):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max_bytes, "right")))
        yield at, data.slice(at, stop - at).to_pylist()
        at = stop


def broadcast_if_light(df: DataFrame, max_bytes: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only when the rows of ``df``, a written table, were added up and are at most ``max_bytes``."""
    size = F.lit(0)
    for field in df.schema:
        width = F.octet_length(field.name) if isinstance(field.dataType, T.StringType) else F.lit(16)
        size = size + F.coalesce(width, F.lit(0)) + 8
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes else df
