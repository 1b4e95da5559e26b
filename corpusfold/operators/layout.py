"""Where documents should go, what stands in the way, and how to go back."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfold.session import broadcast_if_small, write_shared


def merge_folders(assignments: DataFrame, names: DataFrame) -> DataFrame:
    """``folder_order, folder, path``: clusters of one name share a folder.

    One row per document: a folder may hold most of the corpus, so its paths are never put in one
    row. Folders are numbered by their first path. ``names`` has a row per cluster. Nothing runs before the result is
    asked for: first paths are taken per cluster, and a table of that size meets the documents in one join.
    """
    firsts = assignments.groupBy("cluster").agg(F.min("path").alias("first_path"))
    named = names.select("cluster", "folder").join(firsts, "cluster")
    # Paths are unique, so no two folders have the same first one.
    named = named.withColumn("first_path", F.min("first_path").over(Window.partitionBy("folder")))
    order = named.select("cluster", "folder", F.dense_rank().over(Window.orderBy("first_path")).alias("folder_order"))
    return assignments.join(order, "cluster").select("folder_order", "folder", "path")


def structure_summary(structure: DataFrame) -> DataFrame:
    """Per folder: how many documents, and the first and last of them."""
    return structure.groupBy("folder").agg(
        F.count("*").alias("documents"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def destination_path(source_dir: str, target_dir: str | None, folder: Column, path: Column) -> Column:
    return F.concat_ws("/", F.lit((target_dir or source_dir).rstrip("/")), folder, path)


def organize_plan(structure: DataFrame, listing: DataFrame, source_dir: str,
                  target_dir: str | None = None) -> DataFrame:
    """``folder, path, source, destination, status`` for every document; nothing is changed.

    ``listing`` holds every full path that exists now. ``missing``: the source is gone.
    ``exists``: the destination is taken. ``self``: a folder would move into itself. Else ``move``.
    """
    source = F.concat_ws("/", F.lit(source_dir.rstrip("/")), "path")
    plan = structure.select("folder", "path", source.alias("source"),
                            destination_path(source_dir, target_dir, F.col("folder"), F.col("path")).alias("destination"))
    plan = _with_presence(plan, listing, "source", "destination")
    into_itself = F.startswith("destination", F.concat("source", F.lit("/")))
    status = (F.when(~F.col("source_present"), "missing").when(F.col("destination_present"), "exists")
              .when(into_itself, "self").otherwise("move"))
    return plan.select("folder", "path", "source", "destination", status.alias("status"))


def undo_plan(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """``source, destination, status`` for every destination: ``missing``, ``conflict`` or ``restore``.

    Of several moves to one destination the last counts, or the least source where no time is known.
    """
    latest = F.max_by("source", F.struct("moved_at", "source")) if "moved_at" in manifest.columns else F.min("source")
    moves = manifest.groupBy("destination").agg(latest.alias("source"))
    plan = _with_presence(moves, listing, "source", "destination")
    status = (F.when(~F.col("destination_present"), "missing")
              .when(F.col("source_present"), "conflict").otherwise("restore"))
    return plan.withColumn("status", status).select("source", "destination", "status")


class Undone(NamedTuple):
    plan: DataFrame
    """``run_id, source, destination, status`` per move and run, as ``undo_plan`` has them when its turn comes"""
    places: DataFrame
    """``path, place``: where what is at ``path`` now ends up, for all that moves"""


def undo_moves(manifest: DataFrame, listing: DataFrame) -> Undone:
    """Take back all runs of a manifest, the last one first, without going through them one by one.

    Each move points to the one that is undone next at the place it goes back to; documents follow these pointers, which are
    doubled round by round, so n runs take about log2(n) joins. A move back into a place that is taken is a conflict and
    leaves its document where it is. To find these, the places are looked at over the steps of all documents; as a conflict
    changes what follows, those of the first run that has some are settled and the rest is followed anew: one more time per
    run with conflicts. Per path there are at most as many rows as runs.
    """
    moves = manifest if "run_id" in manifest.columns else manifest.withColumn("run_id", F.lit(None).cast("string"))
    timed = "moved_at" in moves.columns
    at = F.max("moved_at") if timed else F.lit(0)
    latest = F.max_by("source", F.struct("moved_at", "source")) if timed else F.min("source")
    # One row per run.
    runs = moves.groupBy(F.col("run_id").alias("_run")).agg(at.alias("at")).select(
        "_run", F.row_number().over(Window.orderBy(F.desc("at"), "_run")).alias("step"))
    events = (moves.groupBy("run_id", "destination").agg(latest.alias("source"))
              .join(broadcast_if_small(runs), F.col("run_id").eqNullSafe(F.col("_run")))
              .select(F.monotonically_increasing_id().alias("id"), "run_id", "step", "source", "destination"))
    events = write_shared(events, "undo_events")
    here = listing.select("path").distinct()
    blocked = events.filter("false").select("id")
    rounds = max((events.agg(F.max("step")).first()[0] or 0) - 1, 0).bit_length()
    while True:
        starts, jump, reached = _follow(events.join(blocked, "id", "left_anti"), here, rounds)
        taken = write_shared(_taken(events.join(reached, "id"), here), "undo_taken")
        step = taken.agg(F.min("step")).first()[0]
        if step is None:
            break
        blocked = write_shared(blocked.unionByName(taken.filter(F.col("step") == step).select("id")), "undo_blocked")
    status = (F.when(F.col("conflict"), "conflict").when(F.col("done"), "restore").otherwise("missing"))
    plan = (events.join(reached.withColumn("done", F.lit(True)), "id", "left")
            .join(blocked.withColumn("conflict", F.lit(True)), "id", "left")
            .select("run_id", "source", "destination", status.alias("status")))
    places = (starts.join(jump, "id").select("path", F.col("to").alias("id"))
              .join(events.select("id", F.col("source").alias("place")), "id").select("path", "place"))
    return Undone(plan, places)


def _follow(events: DataFrame, here: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``path, id``: the first move that takes a place's document back; ``id, to``: the last one after each; ``id``: all that do."""
    none = F.lit(None).cast("bigint")
    visits = (events.select(F.col("destination").alias("path"), "step", F.col("id").alias("target"), none.alias("id"), F.lit(False).alias("start"))
              .unionByName(events.select(F.col("source").alias("path"), "step", none.alias("target"), "id", F.lit(False).alias("start")))
              .unionByName(here.select("path", F.lit(0).alias("step"), none.alias("target"), none.alias("id"), F.lit(True).alias("start"))))
    later = Window.partitionBy("path").orderBy("step").rangeBetween(1, Window.unboundedFollowing)
    linked = write_shared(visits.withColumn("next", F.first("target", ignorenulls=True).over(later)).filter("target IS NULL")
                          .filter("id IS NOT NULL OR next IS NOT NULL"), "undo_links")
    starts = linked.filter("start").select("path", F.col("next").alias("id"))
    jump = linked.filter("id IS NOT NULL").select("id", F.coalesce("next", "id").alias("to"))
    reached = starts.select("id").distinct()
    for _ in range(rounds):
        reached = write_shared(reached.union(reached.join(jump, "id").select("to")).distinct(), "undo_reached")
        jump = write_shared(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to")
                            .select("id", F.col("_to").alias("to")), "undo_jumps")
    return starts, jump, reached


def _taken(undone: DataFrame, here: DataFrame) -> DataFrame:
    """``id, step`` of the moves whose source holds another document when they are to be taken back."""
    none = F.lit(None).cast("bigint")
    seen = (undone.select(F.col("source").alias("path"), "step", "id", F.lit(True).alias("comes"))
            .unionByName(undone.select(F.col("destination").alias("path"), "step", none.alias("id"), F.lit(False).alias("comes")))
            .unionByName(here.select("path", F.lit(0).alias("step"), none.alias("id"), F.lit(True).alias("comes"))))
    before = Window.partitionBy("path").orderBy("step").rangeBetween(Window.unboundedPreceding, -1)
    return (seen.withColumn("held", F.last("comes", ignorenulls=True).over(before))
            .filter("id IS NOT NULL AND held").select("id", "step"))


def _with_presence(plan: DataFrame, listing: DataFrame, *columns: str) -> DataFrame:
    """Add ``<column>_present``. Full paths are unique in a listing, so neither side has hot keys."""
    for column in columns:
        here = listing.select(F.col("path").alias(column), F.lit(True).alias(f"{column}_present"))
        plan = plan.join(here, column, "left").withColumn(
            f"{column}_present", F.coalesce(f"{column}_present", F.lit(False)))
    return plan


def apply_plan(catalog: DataFrame, plan: DataFrame) -> DataFrame:
    """The catalogue (a row per document, with ``location``) after the moves of a plan."""
    return _relocate(catalog, plan.filter("status = 'move'"), "source", "destination")


def apply_undo(catalog: DataFrame, plan: DataFrame) -> DataFrame:
    """The catalogue after the restores of an undo plan."""
    return _relocate(catalog, plan.filter("status = 'restore'"), "destination", "source")


def _relocate(catalog: DataFrame, moves: DataFrame, old: str, new: str) -> DataFrame:
    moved = moves.select(F.col(old).alias("location"), F.col(new).alias("_new"))
    return (catalog.join(moved, "location", "left")
            .withColumn("location", F.coalesce("_new", "location")).drop("_new").select(*catalog.columns))


def mark_organized(structure: DataFrame) -> DataFrame:
    """``folder`` of every output folder, whether or not anything moved into it."""
    return structure.select("folder").distinct()
