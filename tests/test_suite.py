import os
import subprocess
import sys
from functools import partial

import duckdb
import pytest

import __spark_entry__ as suite
from compare import TABLES, rows
from corpusfold.suite import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    con = duckdb.connect(config={"temp_directory": str(tmp_path_factory.mktemp("duck")), "max_temp_directory_size": "2GB"})
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_query_agrees_with_its_sql(spark, db, name):
    found, wanted = suite.queries()[name](spark, SMALL).toPandas(), db.execute(suite.oracle_sql()[name]).df()
    assert list(found.columns) == list(wanted.columns)
    assert rows(found) == rows(wanted)


def test_rescan_counts_documents_not_their_parts(spark, db, monkeypatch):
    """With folders in several parts each, as those of a larger table are."""
    monkeypatch.setattr(queries, "tree_documents", partial(queries.tree_documents, part_chars=3000))
    found = queries.rescan_organized(spark, SMALL).toPandas()
    assert rows(found) == rows(db.execute(suite.oracle_sql()["rescan_organized"]).df())


def test_units_are_put_together_without_a_list_of_their_parts(spark):
    end = ". "
    parts = [("a", i, 300, f"é{i}{end}") for i in range(300)] + [("gap", 0, 2, "x."), ("gap", 2, 2, "y. ")]
    parts += [("twice", 0, 2, "b. "), ("twice", 0, 2, "a. "), ("open", 0, 2, "no"), ("open", 1, 2, "end"), ("none", 0, 1, None), (None, 0, 1, "")]
    df = spark.createDataFrame(parts, "unit string, part int, parts int, content string").repartition(7)
    joined = queries._rejoined(df, "unit")
    assert "collect_list" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.columns == ["unit", "content", "numbered", "whole_sentences"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = {r.unit: tuple(r)[1:] for r in joined.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {"a": ("".join(f"é{i}{end}" for i in range(300)), True, True), "gap": ("x.y. ", False, False), "twice": ("a. b. ", False, True),
                     "open": ("noend", True, False), "none": ("", True, True), None: ("", True, True)}


def test_flagship_has_a_row_per_document(spark):
    found = suite.entry(spark)
    assert found.columns == ["folder_order", "folder", "path"]
    assert found.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_entry_imports_without_a_jvm_and_without_spark_s_jars(tmp_path):
    """In a fresh process, from another folder, with nothing that could start Java or be unpacked."""
    root = os.path.dirname(os.path.abspath(suite.__file__))
    code = ("import glob, subprocess, zipfile\n"
            "def refuse(*a, **b): raise AssertionError('read at import')\n"
            "glob.glob = zipfile.ZipFile.__init__ = subprocess.Popen.__init__ = refuse\n"
            "import __spark_entry__ as e\n"
            "assert len(e.oracle_sql()) >= 37 and set(e.oracle_sql()) <= set(e.queries())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": root})
