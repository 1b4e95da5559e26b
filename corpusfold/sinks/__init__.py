"""Where results are written: sorted documents, manifests, the list of finished folders."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.session import broadcast_if_small, shuffles_removed, write_shared
from corpusfold.sinks.organized import IS_MOVE, PLAN_COLUMNS, RUN_FILE, OrganizedSink, remove_marker
from corpusfold.sources import storage
from corpusfold.sources.tree import MARKER, TreeSource


def write_organized(documents: DataFrame, structure: DataFrame, target: str, mode: str = "append") -> None:
    """Documents (``path`` and whatever else) as parquet, one directory per folder name.

    The rows are dealt over all tasks by path first, so a folder that holds most documents is
    written by many tasks; use ``mode="error"`` for a target that must be new.
    """
    (documents.join(structure.select("path", "folder"), "path")
     .write.partitionBy("folder").mode(mode).parquet(target))


def write_run(plan: DataFrame, target: str, documents: DataFrame | None = None, manifest: str | None = None,
              organized: str | None = None, marker: str | None = MARKER, run_id: str | None = None) -> str | None:
    """The moves of a plan with everything that belongs to them, or nothing at all; returns the id of the run.

    ``documents`` (``path`` and whatever else; with ``part``, in several rows each) that move are written below ``target``, a
    directory per folder, each with a ``marker`` file that keeps later scans out. The moves go to ``manifest`` and the folder names to ``organized``. Either all
    of it is there when this returns, or, when a task or the commit failed, none. None when nothing moves.
    """
    spark = plan.sparkSession
    moves = plan.filter("status = 'move'")
    if moves.isEmpty():
        return None
    run_id = run_id or uuid.uuid4().hex
    rows = moves.select("folder", "path", "source", "destination")
    if documents is not None:
        kept = [c for c in documents.columns if c not in (*PLAN_COLUMNS, IS_MOVE, "path")]
        columns = [*PLAN_COLUMNS, "path", *kept]
        if "part" in kept:
            # The first part of a document is its move; known before the texts are met.
            firsts = documents.groupBy("path").agg(F.min("part").alias("_first"))
            rows = write_shared(rows.join(firsts, "path"), "moves")
            columns.append((F.col("part") == F.col("_first")).alias(IS_MOVE))
        # Where the moves are few the texts stay where they are.
        rows = documents.select("path", *kept).join(broadcast_if_small(rows), "path").select(*columns)
    else:
        rows = rows.drop("path")
    spark.dataSource.register(OrganizedSink)
    writer = rows.sortWithinPartitions("folder").write.format("organized").mode("append").option("runId", run_id)
    for name, value in (("marker", marker), ("manifest", manifest), ("organized", organized)):
        if value:
            writer = writer.option(name, value)
    with shuffles_removed(spark):
        writer.save(target)
    return run_id


def remove_runs(spark: SparkSession, target: str, run_ids: Sequence[str], marker: str = MARKER) -> int:
    """Take out the documents that runs of ``write_run`` put below ``target``, and the markers they made; how many files went.

    The files are found and removed on the workers, in one pass for all runs; a folder that is empty then goes as well.
    """
    spark.dataSource.register(TreeSource)
    wanted = frozenset(run_ids)
    listed = write_shared(spark.read.format("doctree").option("skipNoise", "false").load(target).filter("depth <= 1")
                          .filter(F.col("unit").startswith("folder=")).select("path", "name", "depth", "is_dir"), "sink_listing")
    files = listed.filter("NOT is_dir AND depth = 1").select("path", F.regexp_extract("name", RUN_FILE, 1).alias("run_id"))
    files = files.join(F.broadcast(spark.createDataFrame([(r,) for r in wanted], "run_id string")), "run_id")

    def remove(rows) -> None:
        for row in rows:
            storage.delete(row["path"])

    def unmark(rows) -> None:
        for row in rows:
            remove_marker(storage.join(row["path"], marker), wanted)

    count = files.count()
    files.select("path").foreachPartition(remove)
    listed.filter("is_dir AND depth = 0").select("path").foreachPartition(unmark)
    return count


def write_manifest(plan: DataFrame, path: str, run_id: str | None = None) -> str | None:
    """Append the moves of a plan as JSON lines and return their run id; None when nothing moves."""
    moves = plan.filter("status = 'move'")
    if moves.isEmpty():
        return None
    run_id = run_id or uuid.uuid4().hex
    (moves.select(F.lit(run_id).alias("run_id"), "source", "destination",
                  F.current_timestamp().alias("moved_at"))
     .write.mode("append").json(path))
    return run_id


def append_organized(folders: DataFrame, table: str) -> None:
    """Add folder names (``mark_organized``) to the table that later runs skip."""
    folders.select("folder").write.mode("append").parquet(table)
