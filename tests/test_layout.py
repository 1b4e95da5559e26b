from corpusfold.operators import layout
import random
from datetime import datetime

import pytest

from corpusfold.plans.organize import organize, undo
from corpusfold.sinks import write_manifest, write_organized
from corpusfold.sources.corpus import read_manifest


def structure(spark, *rows):
    return spark.createDataFrame(rows, "folder string, path string")


def listing(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def statuses(plan):
    return {r.path: r.status for r in plan.collect()}


def test_clusters_of_one_name_share_a_folder(spark):
    placed = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2), ("d", 0)], "path string, cluster int")
    names = spark.createDataFrame([(0, "Same"), (1, "Other"), (2, "Same")], "cluster int, folder string")
    rows = layout.merge_folders(placed, names).collect()
    assert sorted(map(tuple, rows)) == [(1, "Other", "a"), (2, "Same", "b"), (2, "Same", "c"), (2, "Same", "d")]
    summary = {r.folder: (r.documents, r.first_path, r.last_path)
               for r in layout.structure_summary(layout.merge_folders(placed, names)).collect()}
    assert summary == {"Other": (1, "a", "a"), "Same": (3, "b", "d")}


def test_plan_in_place_and_to_a_target(spark):
    plan = structure(spark, ("Cluster_one", "a.txt"), ("Cluster_one", "b.txt"))
    here = listing(spark, "/src/a.txt", "/src/b.txt")
    rows = {r.path: (r.source, r.destination, r.status) for r in layout.organize_plan(plan, here, "/src/").collect()}
    assert rows["a.txt"] == ("/src/a.txt", "/src/Cluster_one/a.txt", "move") and rows["b.txt"][2] == "move"
    away = layout.organize_plan(plan, here, "/src", "/out").collect()
    assert {r.destination for r in away} == {"/out/Cluster_one/a.txt", "/out/Cluster_one/b.txt"}


def test_missing_and_existing_are_left_alone(spark, tmp_path):
    plan = structure(spark, ("C", "gone.txt"), ("C", "taken.txt"), ("C", "C"))
    here = listing(spark, "/s/taken.txt", "/s/C/taken.txt", "/s/C", "/s/C/gone.txt")
    got = layout.organize_plan(plan, here, "/s")
    assert statuses(got) == {"gone.txt": "missing", "taken.txt": "exists", "C": "self"}
    assert write_manifest(got, str(tmp_path / "m")) is None and not (tmp_path / "m").exists()


def test_organise_then_undo_restores(spark, tmp_path):
    catalog = spark.createDataFrame([(1, "/s/a"), (2, "/s/b"), (3, "/s/c")], "id int, location string")
    plan = structure(spark, ("F", "a"), ("F", "b"))
    manifest, folders = str(tmp_path / "manifest"), str(tmp_path / "folders")
    done = organize(plan, catalog, "/s", "/t", manifest, folders)
    assert {r.id: r.location for r in done.catalog.collect()} == {1: "/t/F/a", 2: "/t/F/b", 3: "/s/c"}
    assert [r.folder for r in spark.read.parquet(folders).collect()] == ["F"]
    again = organize(structure(spark, ("G", "c")), done.catalog, "/s", "/t", manifest)
    assert again.run_id != done.run_id and read_manifest(spark, manifest).count() == 3
    back = undo(spark, manifest, again.catalog, done.run_id)
    assert {r.id: r.location for r in back.catalog.collect()} == {1: "/s/a", 2: "/s/b", 3: "/t/G/c"}
    all_back = undo(spark, manifest, back.catalog)
    assert {r.id: r.location for r in all_back.catalog.collect()} == {1: "/s/a", 2: "/s/b", 3: "/s/c"}
    assert sorted(r.status for r in all_back.plan.collect()) == ["missing", "missing", "restore"]


def test_repeated_runs_are_taken_back_in_reverse(spark, tmp_path):
    start = catalog = spark.createDataFrame([(1, "/s/a"), (2, "/s/b")], "id int, location string")
    manifest = str(tmp_path / "manifest")
    for _ in range(2):
        done = organize(structure(spark, ("F", "a")), catalog, "/s", "/t", manifest)
        catalog = undo(spark, manifest, done.catalog).catalog
        assert sorted(catalog.collect()) == sorted(start.collect())
    first = organize(structure(spark, ("F", "a")), catalog, "/s", "/t", manifest)
    then = organize(structure(spark, ("G", "F/a")), first.catalog, "/t", "/u", manifest)
    assert {r.location for r in then.catalog.collect()} == {"/u/G/F/a", "/s/b"}
    assert sorted(undo(spark, manifest, then.catalog).catalog.collect()) == sorted(start.collect())


def test_undo_statuses_and_array_manifests(spark, tmp_path):
    path = tmp_path / "old.json"
    path.write_text('[\n  {"source": "/s/a", "destination": "/t/a"},\n  {"source": "/s/b", "destination": "/t/b"},'
                    '\n  {"source": "/s/c", "destination": "/t/c"}\n]')
    moves = read_manifest(spark, str(path), array=True)
    plan = layout.undo_plan(moves, listing(spark, "/t/a", "/t/b", "/s/b"))
    assert {r.source: r.status for r in plan.collect()} == {"/s/a": "restore", "/s/b": "conflict", "/s/c": "missing"}


def test_documents_are_written_by_folder(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "path string, content string")
    write_organized(docs, structure(spark, ("F", "a"), ("G", "b"), ("F", "c")), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("folder=*")) == ["folder=F", "folder=G"]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.folder, r.path) for r in got.collect()) == [("F", "a"), ("F", "c"), ("G", "b")]


def plainly(runs, here):
    """Runs (of destination: source) taken back one after the other, the last one first."""
    here, plan = dict(here), []
    for name, moves in reversed(runs):
        taken = set(here.values())
        status = {d: "missing" if d not in taken else "conflict" if s in taken else "restore" for d, s in moves.items()}
        plan += [(name, moves[d], d, status[d]) for d in moves]
        here = {i: moves[p] if status.get(p) == "restore" else p for i, p in here.items()}
    return here, sorted(plan)


@pytest.mark.parametrize("seed", range(3))
def test_undo_of_many_runs_agrees_with_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    paths = [f"p{i}" for i in range(25)]
    runs = [(f"run{t:02d}", {d: s for d, s in zip(rng.sample(paths, 12), rng.sample(paths, 12)) if d != s}) for t in range(11)]
    here = dict(enumerate(rng.sample(paths, 14)))
    rows = [(name, s, d, datetime(2024, 1, 1 + t)) for t, (name, moves) in enumerate(runs) for d, s in moves.items()]
    undone = layout.undo_moves(spark.createDataFrame(rows, "run_id string, source string, destination string, moved_at timestamp"),
                               spark.createDataFrame([(p,) for p in here.values()], "path string"))
    after, plan = plainly(runs, here)
    assert sorted(map(tuple, undone.plan.collect())) == plan and {r[3] for r in plan} == {"missing", "conflict", "restore"}
    places = dict(map(tuple, undone.places.collect()))
    assert {i: places.get(p, p) for i, p in here.items()} == after


def test_fifty_runs_take_few_jobs(spark):
    rows = [(f"run{t:02d}", f"/{t}/{d}", f"/{t + 1}/{d}", datetime(2024, 1, 1, t // 60, t % 60)) for t in range(50) for d in range(4)]
    moves = spark.createDataFrame(rows, "run_id string, source string, destination string, moved_at timestamp")
    here = spark.createDataFrame([(f"/50/{d}",) for d in range(4)], "path string")
    spark.sparkContext.setJobGroup("undo", "undo")
    try:
        undone = layout.undo_moves(moves, here)
        assert sorted(map(tuple, undone.places.collect())) == [(f"/50/{d}", f"/0/{d}") for d in range(4)]
        assert undone.plan.groupBy("status").count().collect() == [("restore", 200)]
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("undo")) < 120
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
