"""Shared working tables and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def working_root(spark: SparkSession) -> str:
    """Folder shared by all executors: ``spark.checkpoint.dir``, else one under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    root = spark.conf.get("spark.sql.warehouse.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return root.rstrip("/") + "/_working"


# The folders of the steps that are under way, the innermost last.
_STEPS: ContextVar[tuple[str, ...]] = ContextVar("steps", default=())


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``write_shared`` writes inside the block go with its end, but for those it is told to keep.

    Whatever is read after the block has to be written, and kept, inside it.
    """
    root = f"{working_root(spark)}/corpusfold/{uuid.uuid4().hex}"
    token = _STEPS.set((*_STEPS.get(), root))
    try:
        yield
    finally:
        _STEPS.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


# Without it the shuffles of a query that has ended stay on the disks until the driver's garbage collection finds them.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What the queries that are run inside the block have shuffled goes as soon as each of them ends."""
    before = spark.conf.get(_REMOVE_SHUFFLES, "false")
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVE_SHUFFLES, before)


def write_shared(df: DataFrame, name: str, keep: bool = False, codec: str = "zstd") -> DataFrame:
    """Cut lineage: write ``df`` once to shared storage and return the table read back.

    A written table outlives lost executors and, unlike a checkpoint, is still column pruned; what was shuffled for it goes. Inside
    ``working_tables`` it lasts as long as that block, with ``keep`` as long as the block around it.
    """
    spark = df.sparkSession
    steps = _STEPS.get()[:-1] if keep else _STEPS.get()
    root = steps[-1] if steps else f"{working_root(spark)}/corpusfold"
    path = f"{root}/{uuid.uuid4().hex}/{name}"
    with shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only when the rows of ``df`` were counted and their bytes added up; else leave the join to Spark.

    For tables that are cheap to count: ``df`` is worked out once more for the join.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def is_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> bool:
    """Whether ``df`` has no more rows and bytes than these."""
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(_row_bytes(df))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def _row_bytes(df: DataFrame) -> Column:
    total = F.lit(0)
    for field in df.schema:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            size = F.octet_length(field.name)
        elif kind == "array":
            # Strings inside arrays by their spelling as JSON.
            flat = field.dataType.elementType.typeName() in ("string", "struct", "array", "binary")
            size = F.octet_length(F.to_json(field.name)) if flat else 8 * F.size(field.name)
        else:
            size = F.lit(8)
        total = total + 8 + F.coalesce(size, F.lit(0))
    return total


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a scan has fewer splits than the cluster has cores.

    A small parquet file is one split; large inputs come through untouched. Select the
    needed columns first, and pass a scan: counting the splits of a shuffle would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
