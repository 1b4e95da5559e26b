import os
import re

import pytest
from pyspark.sql import functions as F

from corpusfold.operators.filters import partition_value
from corpusfold.plans.organize import organize, undo
from corpusfold.sinks import remove_runs, write_run
from corpusfold.sinks.organized import folder_directory
from corpusfold.sources.corpus import read_manifest
from corpusfold.sources.tree import MARKER, read_tree


def files(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def tree(spark, root, count=12):
    root.mkdir()
    for i in range(count):
        (root / f"d{i}.txt").write_text(f"text {i}")
    docs = spark.createDataFrame([(f"d{i}.txt", f"text {i}", i) for i in range(count)], "path string, content string, part int").repartition(3)
    structure = spark.createDataFrame([(f"Topic {i % 3}: a/b", f"d{i}.txt") for i in range(count)], "folder string, path string")
    catalog = read_tree(spark, str(root)).selectExpr("path AS location")
    return docs, structure, catalog


def units(spark, root):
    return sorted(r.unit for r in read_tree(spark, str(root)).collect())


def test_what_was_organised_is_marked_and_left_alone(spark, tmp_path):
    docs, structure, catalog = tree(spark, tmp_path / "in")
    before = units(spark, tmp_path / "in")
    done = organize(structure, catalog, str(tmp_path / "in"), manifest=str(tmp_path / "manifest"), organized=str(tmp_path / "names"),
                    documents=docs)
    folders = [p for p in (tmp_path / "in").iterdir() if p.is_dir()]
    assert sorted(p.name for p in folders) == [f"folder=Topic {i}%3A a%2Fb" for i in range(3)]
    assert all((p / MARKER).read_text() == done.run_id for p in folders)
    assert units(spark, tmp_path / "in") == before
    got = spark.read.option("pathGlobFilter", "*.parquet").option("basePath", str(tmp_path / "in")).parquet(*map(str, folders))
    assert sorted((r.folder, r.path, r.content, r.part) for r in got.collect()) == sorted(
        (f"Topic {i % 3}: a/b", f"d{i}.txt", f"text {i}", i) for i in range(12))
    moves = read_manifest(spark, str(tmp_path / "manifest")).collect()
    assert len(moves) == 12 and {m.run_id for m in moves} == {done.run_id} and all(m.moved_at for m in moves)
    assert sorted(r.folder for r in spark.read.parquet(str(tmp_path / "names")).collect()) == [f"Topic {i}: a/b" for i in range(3)]
    # A second run adds to the folders; each can be taken out alone.
    more = spark.createDataFrame([("new.txt", "n", 0)], docs.schema)
    again = organize(spark.createDataFrame([("Topic 0: a/b", "new.txt"), ("Own", "d1.txt")], "folder string, path string"),
                     spark.createDataFrame([(f"{tmp_path}/in/new.txt",)], "location string"), str(tmp_path / "in"), documents=more)
    assert remove_runs(spark, str(tmp_path / "in"), [done.run_id]) >= 3
    left = [f for f in files(tmp_path / "in") if "/" in f]
    assert len(left) == 1 and re.fullmatch(rf"folder=Topic 0%3A a%2Fb/part-\d+-{again.run_id}-1.parquet", left[0])
    assert remove_runs(spark, str(tmp_path / "in"), [again.run_id, "no such run"]) == 1
    assert files(tmp_path / "in") == before


def test_undo_takes_out_what_was_written(spark, tmp_path):
    docs, structure, catalog = tree(spark, tmp_path / "in")
    before = files(tmp_path / "in")
    manifest = str(tmp_path / "manifest")
    done = organize(structure, catalog, str(tmp_path / "in"), manifest=manifest, documents=docs)
    assert files(tmp_path / "in") != before
    back = undo(spark, manifest, done.catalog, target=str(tmp_path / "in"))
    assert files(tmp_path / "in") == before and not [p for p in (tmp_path / "in").iterdir() if p.is_dir()]
    assert sorted(back.catalog.collect()) == sorted(catalog.collect())
    # What could not go back keeps its copy.
    done = organize(structure, catalog, str(tmp_path / "in"), manifest=manifest, documents=docs)
    taken = done.catalog.union(catalog.limit(1))
    assert "conflict" in {r.status for r in undo(spark, manifest, taken, done.run_id, target=str(tmp_path / "in")).plan.collect()}
    assert files(tmp_path / "in") != before


def test_a_document_in_parts_moves_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / name).write_text("x")
    docs = spark.createDataFrame([("a", i, f"a{i}") for i in range(5)] + [("b", 0, "b0")], "path string, part int, content string").repartition(4)
    structure = spark.createDataFrame([("One", "a"), ("Two", "b")], "folder string, path string")
    root, manifest = str(tmp_path / "in"), str(tmp_path / "manifest")
    catalog = read_tree(spark, root).selectExpr("path AS location")
    organize(structure, catalog, root, manifest=manifest, documents=docs)
    assert sorted(r.destination for r in read_manifest(spark, manifest).collect()) == [f"{root}/One/a", f"{root}/Two/b"]
    written = spark.read.option("basePath", root).parquet(f"{root}/folder=*")
    assert sorted(r.content for r in written.collect()) == ["a0", "a1", "a2", "a3", "a4", "b0"]
    assert "is_move" not in written.columns


def plan(spark, count=40):
    return spark.range(count).selectExpr("concat('F', id % 4) AS folder", "concat('d', id) AS path", "concat('/s/d', id) AS source",
                                         "concat('/t/F', id % 4, '/d', id) AS destination", "'move' AS status")


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "out").mkdir()
    broken = F.when(F.col("id") == 37, F.raise_error(F.lit("no such text"))).otherwise(F.lit("x")).cast("string")
    docs = spark.range(40).select(F.concat(F.lit("d"), "id").alias("path"), broken.alias("content"))
    with pytest.raises(Exception, match="no such text"):
        write_run(plan(spark), str(tmp_path / "out"), docs, str(tmp_path / "out/manifest"), str(tmp_path / "out/names"))
    assert os.listdir(tmp_path / "out") == []


def test_a_failed_commit_is_taken_back(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "file").write_text("in the way")
    docs = spark.range(40).selectExpr("concat('d', id) AS path", "'x' AS content")
    with pytest.raises(Exception):
        write_run(plan(spark), str(tmp_path / "out"), docs, str(tmp_path / "file/manifest"), str(tmp_path / "out/names"))
    assert os.listdir(tmp_path / "out") == [] and (tmp_path / "file").read_text() == "in the way"


def test_moves_without_documents_and_nothing_to_move(spark, tmp_path):
    run = write_run(plan(spark), str(tmp_path / "out"), None, str(tmp_path / "manifest"))
    assert read_manifest(spark, str(tmp_path / "manifest")).count() == 40
    assert files(tmp_path / "out") == [f"folder=F{i}/{MARKER}" for i in range(4)] and run
    assert write_run(plan(spark).withColumn("status", F.lit("missing")), str(tmp_path / "none")) is None
    assert not (tmp_path / "none").exists()


def test_folder_names_are_those_of_partitioned_tables(spark):
    names = ["plain", "What: 50% {x}/y", "a=b[c]^d", "tab\there", "ü ñ", "q\"'#*?\\", "\x7f~|"]
    rows = spark.createDataFrame([(n,) for n in names], "folder string").select("folder", partition_value(F.col("folder")).alias("p")).collect()
    assert all(folder_directory(r.folder) == f"folder={r.p}" for r in rows)
