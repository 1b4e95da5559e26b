"""Carrying out a layout on the document catalogue, and taking it back."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.operators.layout import apply_plan, mark_organized, organize_plan, undo_moves
from corpusfold.session import write_shared
from corpusfold.sinks import append_organized, remove_runs, write_manifest, write_run
from corpusfold.sources.corpus import read_manifest
from corpusfold.sources.tree import MARKER


class Organized(NamedTuple):
    plan: DataFrame
    catalog: DataFrame
    run_id: str | None


def organize(structure: DataFrame, catalog: DataFrame, source_dir: str, target_dir: str | None = None,
             manifest: str | None = None, organized: str | None = None,
             documents: DataFrame | None = None, marker: str | None = MARKER) -> Organized:
    """Plan the layout, record its moves and folders, and give the catalogue after it.

    ``catalog`` has a row per document with its ``location``. ``manifest`` and ``organized`` are the
    paths of the tables to add to. With ``documents`` (``path`` and whatever else) those that move are
    also written, a directory per folder, below ``target_dir`` or else ``source_dir``, each with a ``marker`` that makes later
    scans leave it alone; documents, markers, manifest and folder names appear together or not at all. For a dry run look at
    ``organize_plan`` alone.
    """
    listing = catalog.select(catalog["location"].alias("path"))
    plan = write_shared(organize_plan(structure, listing, source_dir, target_dir), "plan")
    if documents is not None:
        run_id = write_run(plan, target_dir or source_dir, documents, manifest, organized, marker)
    else:
        run_id = write_manifest(plan, manifest) if manifest else None
        if organized:
            append_organized(mark_organized(structure), organized)
    return Organized(plan, apply_plan(catalog, plan), run_id)


def undo(spark: SparkSession, manifest: str, catalog: DataFrame, run_id: str | None = None,
         array: bool = False, target: str | None = None, marker: str = MARKER) -> Organized:
    """Reverse the moves of a manifest, the last run first, or of one of its runs.

    The plan has a row per move and run; the catalogue keeps its rows. Documents are followed back through all runs at once
    (``undo_moves``). With ``target`` the documents that the runs had written there go too, of runs taken back without conflicts.
    """
    moves = read_manifest(spark, manifest, array)
    if run_id is not None:
        moves = moves.filter(moves["run_id"] == run_id)
    undone = undo_moves(moves, catalog.select(F.col("location").alias("path")))
    plan = write_shared(undone.plan, "undo_plan")
    moved = undone.places.select(F.col("path").alias("location"), F.col("place").alias("_new"))
    back = (catalog.join(moved, "location", "left").withColumn("location", F.coalesce("_new", "location"))
            .drop("_new").select(*catalog.columns))
    back = write_shared(back, "catalog")
    if target is not None:
        # One row per run.
        gone = (plan.filter("run_id IS NOT NULL").groupBy("run_id").agg(F.bool_or(F.col("status") == "conflict").alias("stays"))
                .filter("NOT stays").collect())
        remove_runs(spark, target, [row["run_id"] for row in gone], marker)
    return Organized(plan.drop("run_id"), back, run_id)
