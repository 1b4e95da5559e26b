import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF, StopWordsRemover
from pyspark.sql import functions as F

from corpusfold.operators.embed import embed
from corpusfold.operators.keywords import default_stop_words
from corpusfold.operators.text import weighted_text
from corpusfold.plans.analyze import analyze, analyze_tree, segment_transcripts
from corpusfold.session import broadcast_if_small, working_root, write_shared
from corpusfold.streaming.prepare import prepare_stream

TOPICS = {"sun": "solar panel energy heat light power", "bread": "flour dough water yeast oven bake",
          "sea": "ship harbour sail wave anchor tide"}


def corpus(spark, each=8):
    rng = np.random.default_rng(0)
    rows = [(f"{topic}{i}.txt", " ".join(rng.choice(words.split(), 40))) for topic, words in TOPICS.items()
            for i in range(each)]
    return write_shared(spark.createDataFrame(rows, "path string, content string").repartition(4), "corpus")


def groups(structure):
    out = {}
    for r in structure.collect():
        out.setdefault(r.folder, set()).add(r.path)
    return out


def test_topics_are_found_and_named(spark):
    docs = corpus(spark)
    result = analyze(docs, max_clusters=5)
    found = groups(result.structure)
    assert result.k == 3 and len(found) == 3
    for folder, paths in found.items():
        topics = {p.rstrip("0123456789.txt") for p in paths}
        assert len(topics) == 1 and len(paths) == 8
        assert any(w in folder.lower() for w in TOPICS[topics.pop()].split())
    assert result.assignments.count() == 24 and result.keywords.filter("rank = 1").count() == 3
    again = analyze(docs.repartition(2), max_clusters=5)
    assert groups(again.structure) == found


def test_same_keyword_gives_one_folder(spark, tmp_path):
    for name in ("test1.pdf", "test2.pdf", "test3.pdf"):
        (tmp_path / name).write_bytes(b"")
    places = {"test1.pdf": (0, 0), "test2.pdf": (0, 1), "test3.pdf": (10, 10)}

    def encoder(texts):
        return [np.array(places[t[:9]], float) for t in texts]
    result = analyze_tree(spark, str(tmp_path), encoder=encoder, stop_words=["test1", "test2", "test3", "pdftest1",
                                                                             "pdftest2", "pdftest3"])
    assert result.k == 2 and groups(result.structure) == {"Pdf": {"test1.pdf", "test2.pdf", "test3.pdf"}}


def test_ready_vectors(spark):
    docs = corpus(spark)
    topic = F.regexp_extract("path", r"^[a-z]+", 0)
    table = docs.select("path", F.array(*[
        (topic == t).cast("double") + F.pmod(F.hash("path", F.lit(t)), F.lit(10)) / 100 for t in TOPICS]).alias("features"))
    assert {len(v) for v in groups(analyze(docs, encoder=table, max_clusters=4).structure).values()} == {8}
    lame = table.withColumn("features", F.when(F.col("path") == table.first().path, F.array(F.lit(1.0), F.lit(None), F.lit(0.0)))
                            .otherwise(F.col("features")))
    few = lame.filter(~F.col("path").isin([r.path for r in docs.orderBy("path").limit(3).collect()]))
    found = analyze(docs, encoder=few, max_clusters=4)
    assert found.structure.count() == found.structure.select("path").distinct().count() == 24
    assert found.assignments.filter(F.col("cluster") == found.k).count() in (3, 4)


def test_few_documents(spark):
    one = spark.createDataFrame([("a.txt", "only text")], "path string, content string")
    result = analyze(one)
    assert result.k == 1 and list(groups(result.structure).values()) == [{"a.txt"}]
    assert result.metrics.count() == 0
    empty = spark.createDataFrame([("a", None), ("b", ""), ("c", None)], "path string, content string")
    assert analyze(empty).assignments.count() == 3


def test_errors(spark):
    docs = corpus(spark, 2)
    with pytest.raises(ValueError):
        analyze(docs, max_clusters=2)
    with pytest.raises(ValueError):
        analyze(docs.filter("false"))
    with pytest.raises(RuntimeError):
        analyze(docs, encoder=lambda texts: 1 / 0)
    with pytest.raises(FileNotFoundError):
        analyze_tree(spark, "/nonexistent_directory")
    with pytest.raises(ValueError):
        analyze_tree(spark, "/nonexistent_directory", max_clusters=1)


def test_tfidf_against_plain_python(spark):
    docs = weighted_text(corpus(spark, 3))
    texts = {r.path: r.text for r in docs.collect()}
    bucket = HashingTF(numFeatures=64).indexOf
    counts = {p: Counter(bucket(w) for w in "".join(c if c.isalnum() else " " for c in t.lower()).split())
              for p, t in texts.items()}
    df = Counter(b for c in counts.values() for b in c)
    for r in embed(docs, num_features=64).vectors.collect():
        weights = np.zeros(64)
        for b, n in counts[r.path].items():
            weights[b] = n * math.log((len(texts) + 1) / (df[b] + 1))
        assert np.allclose(r.features.toArray(), weights / np.linalg.norm(weights))


def test_documents_in_parts_get_the_vector_of_the_whole(spark):
    docs = corpus(spark, 3)
    half = F.length("content") / 2
    cut = F.instr(F.expr("substring(content, CAST(length(content) / 2 AS INT))"), " ") + half.cast("int") - 1
    a = docs.select("path", F.lit(0).alias("part"), F.lit(2).alias("parts"), F.substring("content", F.lit(1), cut).alias("content"))
    b = docs.select("path", F.lit(1).alias("part"), F.lit(2).alias("parts"), F.substring("content", cut, F.length("content")).alias("content"))
    parts = write_shared(a.unionByName(b), "parts")
    whole = {r.path: r.features.toArray() for r in embed(weighted_text(docs)).vectors.collect()}
    split = {r.path: r.features.toArray() for r in embed(weighted_text(parts)).vectors.collect()}
    assert whole.keys() == split.keys() and all(np.allclose(whole[p], split[p]) for p in whole)
    assert {frozenset(g) for g in groups(analyze(parts, max_clusters=4).structure).values()} == {
        frozenset(g) for g in groups(analyze(docs, max_clusters=4).structure).values()}


def letters():
    """Shares of letters: the mean by length over parts is that of the whole."""
    return lambda texts: [[t.count(c) / max(len(t), 1) for c in "aeiou"] for t in texts]


def test_an_encoder_s_vectors_of_parts_are_pooled_by_length(spark):
    rows = [("a", 0, 3, "aaaa"), ("a", 1, 3, "eb"), ("a", 2, 3, ""), ("b", 0, 1, "uuo"), ("c", 0, 1, ""), ("d", 0, 2, "ai"), ("d", 1, 2, "xx")]
    found = {r.path: r.features for r in embed(spark.createDataFrame(
        rows, "path string, part int, parts int, text string"), letters()).vectors.collect()}
    assert found.keys() == set("abcd")
    # An empty part weighs as much as one character.
    for path, wanted in {"a": [4 / 7, 1 / 7, 0, 0, 0], "b": [0, 0, 0, 1 / 3, 2 / 3], "c": [0] * 5, "d": [.25, 0, .25, 0, 0]}.items():
        assert np.allclose(found[path], wanted)


def tree(root):
    rng = np.random.default_rng(1)
    ends = [". ", ".\n", "! ", "\n", " ", " ", " ", "?  ", ", ", "3.5 ", "... ", ".", "\n\n  ", " Mr. "]
    for topic, words in TOPICS.items():
        for unit in range(4):
            (root / f"{topic}{unit}").mkdir()
            for name in range(12):
                text = "".join(w.title() + e if n % 7 == 0 else w + e for n, (w, e) in enumerate(
                    zip(rng.choice(words.split(), 60), rng.choice(ends, 60))))
                (root / f"{topic}{unit}/{name:02d}.txt").write_text(text)
        (root / f"{topic}.txt").write_text(" ".join(rng.choice(words.split(), 900)) + ".\nThe end. ")


@pytest.mark.parametrize("encoder", ["tfidf", letters()])
def test_the_size_of_parts_and_pieces_changes_nothing(spark, tmp_path, encoder):
    tree(tmp_path)
    def found(**sizes):
        result = analyze_tree(spark, str(tmp_path), max_clusters=4, restarts=3, encoder=encoder, **sizes)
        names = dict(result.structure.join(result.assignments, "path").select("cluster", "folder").distinct().collect())
        words = {(names[r.cluster], r.rank, r.keyword, round(math.log(r.score), 8)) for r in result.keywords.collect()}
        return result.k, groups(result.structure), words

    assert found(part_chars=100, chunk_bytes=70) == found()


def test_segments_to_transcripts(spark):
    df = spark.createDataFrame([("a", i, 4000, f"w{i}") for i in range(4)], "path string, seq int, frames bigint, text string")
    assert segment_transcripts(df, 2000).first().transcript == "w0 w1 w2 w3"
    assert segment_transcripts(df, 4).first().transcript == "w0 w..."
    assert segment_transcripts(df, 2000, 8000).first().transcript == "w0 w1"


def test_stream_is_prepared_like_a_batch(spark, tmp_path):
    rows = [("a.txt", "alpha"), (".git/x", "no"), ("sub/b.MP3", None), ("c.log", "no")]
    df = spark.createDataFrame(rows, "rel_path string, content string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (prepare_stream(stream, exclude_patterns=["*.log"]).writeStream.format("memory").queryName("prepared")
             .option("checkpointLocation", str(tmp_path / "check")).start())
    query.processAllAvailable()
    query.stop()
    wanted = prepare_stream(df, exclude_patterns=["*.log"])
    assert sorted(spark.table("prepared").collect()) == sorted(wanted.collect())
    assert sorted(r.text for r in wanted.collect()) == ["a.txta.txt alpha", "b.MP3b.MP3"]


def test_working_root_and_size_checked_broadcast(spark):
    assert working_root(spark) == spark.conf.get("spark.checkpoint.dir")
    small, large = spark.range(5), spark.range(50)
    plan = spark.range(9).join(broadcast_if_small(small, 5), "id")._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan
    plan = spark.range(9).join(broadcast_if_small(large, 5), "id")._jdf.queryExecution().toString()
    assert "strategy=broadcast" not in plan


def test_stop_words_of_the_sql_are_those_of_spark(spark):
    assert StopWordsRemover.loadDefaultStopWords("english") == default_stop_words()
