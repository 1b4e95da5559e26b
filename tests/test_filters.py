import fnmatch
import os

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusfold.functions.strings import capitalize, glob_to_regex, strip
from corpusfold.operators import filters
from pyspark.sql import functions as F


def paths(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "rel_path string")


def kept(df):
    return sorted(r.rel_path for r in df.collect())


def test_noise_at_every_level(spark):
    df = paths(spark, "a.pdf", ".hidden.txt", ".git/config", "x/__pycache__/junk.txt",
               "node_modules/junk.txt", "x/node_modules_2/ok.txt", "x/.y/z.txt")
    assert kept(filters.drop_noise(df)) == ["a.pdf", "x/node_modules_2/ok.txt"]
    assert len(kept(filters.drop_noise(df, skip_noise=False))) == 7


def test_exclude_works_on_names_of_all_levels(spark):
    df = paths(spark, "debug.log", "x/debug.log", "logs.log/a.txt", "a.txt", "DEBUG.LOG", "b.log\n")
    assert kept(filters.exclude_globs(df, ["*.log"])) == ["DEBUG.LOG", "a.txt", "b.log\n"]
    assert len(kept(filters.exclude_globs(df, []))) == 6


GLOBS = ["*", "?", "*.log", "a?c", "[abc]*", "[!abc]*", "[]]x", "[!]]x", "a[", "[a-c][0-9]", "x.[tT]xt",
         "a+b(c)", "[[]", "[^a]", r"a\b", "a$", "{a,b}", "*[!a-z]", "[a&&b]", "[~|]"]
NAMES = ["", "a", "abc", "axc", "b.log", "]x", "ax", "[", "a[", "c7", "x.txt", "x.Txt", "x.TXT", "a+b(c)",
         "^", "^a", r"a\b", "a$", "{a,b}", "é", "a\n", "\nlog", "&", "~", "|", "b.log\n", ".hidden"]


def test_globs_agree_with_the_shell_rules(spark):
    pairs = [(n, g, glob_to_regex(g)) for g in GLOBS for n in NAMES]
    df = spark.createDataFrame(pairs, "name string, glob string, regex string")
    for row in df.withColumn("hit", F.expr("name RLIKE regex")).collect():
        assert row.hit == fnmatch.fnmatchcase(row.name, row.glob), (row.glob, row.name)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab.TX/\n é", min_size=1, max_size=8).filter(lambda s: "/" not in s),
                min_size=1, max_size=20))
def test_extension_agrees_with_splitext(spark, names):
    df = filters.classify_ext(spark.createDataFrame([(n,) for n in names], "name string"))
    for row in df.collect():
        assert row.ext == os.path.splitext(row.name)[1].lower()


def test_kinds(spark):
    df = spark.createDataFrame([("a.PDF",), ("b.opus",), ("c.csv",), (".txt",), ("d",)], "name string")
    assert [r.kind for r in filters.classify_ext(df).orderBy("name").collect()] == [
        "other", "readable", "audio", "other", "other"]


def test_organized_folders_are_skipped_at_the_top_only(spark):
    df = filters.unit_key(paths(spark, "Cluster_old/a.txt", "b.txt", "x/Cluster_old/c.txt"))
    organized = spark.createDataFrame([("Cluster_old",)], "folder string")
    assert kept(filters.skip_organized(df, organized)) == ["b.txt", "x/Cluster_old/c.txt"]


def test_strip_and_capitalize(spark):
    df = spark.createDataFrame([(" \x1c a b\t\n",), ("éCOLE du_SUD",), ("",)], "t string")
    rows = df.select("t", strip(F.col("t")).alias("s"), capitalize(F.col("t")).alias("c")).collect()
    for row in rows:
        assert row.s == row.t.strip()
        assert row.c == row.t.capitalize() or row.t[:1].isspace()
