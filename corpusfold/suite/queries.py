"""Queries: what each operator is given, taken from the test tables as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusfold.functions.strings import unix_newlines
from corpusfold.operators import audio, choose, cluster, embed, filters, keywords, layout, quality, text
from corpusfold.plans.analyze import analyze, tree_documents
from corpusfold.plans.organize import organize, undo
from corpusfold.session import broadcast_if_small, spread, working_root, working_tables, write_shared
from corpusfold.sinks import write_manifest, write_organized
from corpusfold.sources.content import decode_text, docx_text, row_slices
from corpusfold.sources import storage
from corpusfold.sources.corpus import read_corpus, read_manifest
from corpusfold.sources.tree import read_tree
from corpusfold.streaming.prepare import prepare_stream

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
KS = list(range(2, 11))
GLOBS = ["*.net", "[!m]*.example.com", "4?", "*#top"]
EXTENSIONS = [".pdf", ".TXT", ".docx", ".mp3", ".csv", "", ".tar.gz", ".Xml", ".", ".opus"]
MAX_FRAMES = 600
MAX_CHARS = 2000
SOURCE_DIR, TARGET_DIR = "/corpus", "/sorted"
# Far less than a unit has.
PART_CHARS = 3000
LETTERS = "aeiou"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_corpus(spark, f"{sf}/documents.parquet", schema=DOCUMENTS)


def _path(id_col: str = "doc_id") -> Column:
    return F.concat(F.col(id_col).cast("string"), F.lit(".txt"))


def corpus_scan(spark, sf):
    return _documents(spark, sf).select(_path().alias("path"), F.col("text").alias("content"))


def _urls(spark, sf):
    """Page addresses as paths; languages stand in for directories of noise."""
    path = F.regexp_replace("url", "^https?://", "")
    for found, name in (("/fr/", "/.git/"), ("/de/", "/node_modules/"), ("/es/", "/__pycache__/")):
        path = F.replace(path, F.lit(found), F.lit(name))
    return _table(spark, sf, "pages").select("page_id", path.alias("rel_path"))


def noise_filter(spark, sf):
    return filters.drop_noise(_urls(spark, sf))


def exclude_glob(spark, sf):
    return filters.exclude_globs(_urls(spark, sf), GLOBS)


def ext_class(spark, sf):
    choice = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    stem = F.concat(F.when(F.col("lang") == "es", ".").otherwise(""), F.col("doc_id").cast("string"))
    names = _documents(spark, sf).select("doc_id", F.concat(stem, choice).alias("name"))
    return filters.classify_ext(names)


def _files(spark, sf):
    """Documents as files: the source is the folder."""
    return _documents(spark, sf).select(
        F.col("source").alias("unit"), F.concat_ws("/", "source", _path()).alias("rel_path"),
        _path().alias("name"), F.col("text").alias("content"), "n_chars")


def unit_rollup(spark, sf):
    return text.rollup_units(_files(spark, sf).drop("n_chars"))


def weighted_text(spark, sf):
    content = F.when(F.col("lang") == "es", None).when(F.col("lang") == "de", "").otherwise(F.col("text"))
    docs = _documents(spark, sf).select(_path().alias("path"), content.alias("content"))
    return text.weighted_text(docs, 3).select("path", "text")


def skip_organized(spark, sf):
    units = _documents(spark, sf).select(_path().alias("unit"), "source")
    labelled = _table(spark, sf, "labels").select(_path().alias("folder"))
    return filters.skip_organized(units, labelled)


def organized_folders(spark, sf):
    placed = _documents(spark, sf).join(_table(spark, sf, "labels"), "doc_id")
    return layout.mark_organized(placed.select(
        F.concat_ws("_", "lang", F.col("quality").cast("string")).alias("folder"), _path().alias("path")))


def _tags(spark, sf):
    customer, nation = _table(spark, sf, "customer"), _table(spark, sf, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").cast("string").alias("path"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("title"),
        F.col("c_mktsegment").alias("artist"),
        F.when(F.col("c_nationkey") < 5, None).otherwise(F.col("n_name")).alias("album"),
        F.lit(None).cast("string").alias("genre"), F.lit("").alias("composer"))


def tags_text(spark, sf):
    return audio.audio_tags_text(_tags(spark, sf)).select("path", "tags_text")


def _segments(spark, sf):
    """Turns of a conversation as recognised segments; a turn's characters are its frames."""
    return _table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("seq"),
        F.length("text").cast("bigint").alias("frames"), "text")


def duration_cap(spark, sf):
    return audio.duration_cap(_segments(spark, sf), MAX_FRAMES).select("path", "seq", "frames_read")


def transcript(spark, sf):
    return audio.transcript(_segments(spark, sf), MAX_CHARS)


def audio_content(spark, sf):
    files = _table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("path"))
    tags = _tags(spark, sf).filter("artist <> 'BUILDING'")
    return audio.compose_audio_content(files, tags, transcript(spark, sf))


def _vectors(spark, sf):
    return _table(spark, sf, "embeddings").withColumnRenamed("embedding", "features")


def embedding_join(spark, sf):
    docs = _documents(spark, sf).select(F.col("doc_id").alias("path"))
    joined = embed.embedding_join(docs, _vectors(spark, sf).withColumnRenamed("vec_id", "path"))
    total = F.aggregate(F.col("features").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return joined.select("path", F.size("features").alias("dims"), F.round(total, 6).alias("total"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cluster_inertia(spark, sf):
    return _rounded(quality.cluster_inertia(_vectors(spark, sf), 10, cluster="label"))


def calinski_harabasz(spark, sf):
    return _rounded(quality.calinski_harabasz(_vectors(spark, sf), 10, cluster="label"))


def silhouette_exact(spark, sf):
    return _rounded(quality.silhouette(_vectors(spark, sf), 10, "exact", cluster="label"))


def silhouette_sampled(spark, sf):
    """With a small error, for which these clusters are their own samples, and whether a coarse estimate keeps its bound."""
    vectors, coarse = _vectors(spark, sf), 0.5
    fine = quality.silhouette(vectors, 10, "sampled", cluster="label", error=0.05)
    rough = quality.silhouette(vectors, 10, "sampled", cluster="label", error=coarse)
    bound = F.abs(F.col("silhouette") - F.col("rough")) <= 4 * coarse / (1 - coarse)
    return fine.join(rough.withColumnRenamed("silhouette", "rough"), "k").select(
        "k", F.round("silhouette", 6).alias("silhouette"), bound.alias("rough_within"))


def silhouette_squared(spark, sf):
    return _rounded(quality.silhouette(_vectors(spark, sf), 10, "squared", cluster="label"))


def kmeans_assign(spark, sf):
    vectors = _vectors(spark, sf)
    # One centre per label: ten rows.
    means = (vectors.groupBy("label").agg(Summarizer.mean(array_to_vector("features")).alias("mean"))
             .orderBy("label").collect())
    centers = np.stack([row["mean"].toArray() for row in means])
    return cluster.assign(vectors, centers).select("vec_id", "cluster")


def _sweep(spark, sf):
    labels = F.array(*[F.col("label") % k for k in KS])
    return quality.labelling_metrics(_vectors(spark, sf).select("features", labels.alias("labels")), KS,
                                     silhouette="squared")


def sweep_metrics(spark, sf):
    return _rounded(_sweep(spark, sf))


def select_k(spark, sf):
    return choose.select_k(_sweep(spark, sf), _vectors(spark, sf).count())


def _labelled_texts(spark, sf):
    return spread(_documents(spark, sf).select(F.col("lang").alias("cluster"), "text"))


def term_stats(spark, sf):
    grams = write_shared(keywords.gram_counts(_labelled_texts(spark, sf)), "grams")
    return keywords.term_stats(grams)


def _keyword_scores(spark, sf):
    stop_words = keywords.default_stop_words()
    grams, scores = keywords.score_words(_labelled_texts(spark, sf), 2, stop_words)
    return keywords.keyword_scores(grams, scores, stop_words, 2)


def keyword_scores(spark, sf):
    return _keyword_scores(spark, sf).select(
        "cluster", "keyword", "size", "tf", F.round(F.log("score"), 6).alias("log_score"))


def keyword_scores_three(spark, sf):
    """Phrases of three words, stop words inside them included."""
    stop_words = keywords.default_stop_words()
    grams, scores = keywords.score_words(_labelled_texts(spark, sf), 3, stop_words)
    return keywords.keyword_scores(grams, scores, stop_words, 3, shortest=3).select(
        "cluster", "keyword", "tf", F.round(F.log("score"), 6).alias("log_score"))


def keyword_topk(spark, sf):
    return keywords.keyword_topk(_keyword_scores(spark, sf), 25).select(
        "cluster", "rank", "keyword", F.round(F.log("score"), 6).alias("log_score"))


def keyword_distinct(spark, sf):
    return keywords.top_keywords(_keyword_scores(spark, sf), 5).select(
        "cluster", "rank", "keyword", F.round(F.log("score"), 6).alias("log_score"))


def folder_name(spark, sf):
    """Language keywords, and one cluster more that has no text."""
    best = keywords.keyword_topk(_keyword_scores(spark, sf), 2)
    clusters = _documents(spark, sf).select(F.col("lang").alias("cluster")).distinct()
    silent = clusters.agg(F.concat(F.max("cluster"), F.lit("-none")).alias("cluster"))
    return keywords.name_clusters(clusters.unionByName(silent), best)


def _placed(spark, sf):
    """Documents with a cluster each, and cluster names of which some are shared."""
    docs = _documents(spark, sf)
    placed = docs.select(_path().alias("path"), F.col("source").alias("cluster"))
    names = docs.select(F.col("source").alias("cluster"), F.concat(
        F.lit("Topic_"), F.regexp_extract("source", r"(\d)$", 1)).alias("folder")).distinct()
    return placed, names


def folder_merge(spark, sf):
    return layout.merge_folders(*_placed(spark, sf))


def structure_summary(spark, sf):
    return layout.structure_summary(folder_merge(spark, sf))


def _listing(spark, sf):
    """What exists: every document but the toxic ones; good ones are in place already."""
    docs = _documents(spark, sf).join(_table(spark, sf, "labels"), "doc_id", "left")
    folder = F.concat(F.lit("Topic_"), F.regexp_extract("source", r"(\d)$", 1))
    here = docs.filter(F.coalesce("toxic", F.lit(0)) == 0).select(F.concat_ws("/", F.lit(SOURCE_DIR), _path()).alias("path"))
    there = docs.filter("quality = 1").select(F.concat_ws("/", F.lit(TARGET_DIR), folder, _path()).alias("path"))
    return here.unionByName(there)


def organize_plan(spark, sf):
    return layout.organize_plan(folder_merge(spark, sf), _listing(spark, sf), SOURCE_DIR, TARGET_DIR)


def undo_plan(spark, sf):
    moves = organize_plan(spark, sf).select("source", "destination")
    return layout.undo_plan(moves, _listing(spark, sf))


def _catalog(spark, sf):
    return _documents(spark, sf).select("doc_id", F.concat_ws("/", F.lit(SOURCE_DIR), _path()).alias("location"))


def apply_plan(spark, sf):
    return layout.apply_plan(_catalog(spark, sf), organize_plan(spark, sf))


def undo_roundtrip(spark, sf):
    moved = apply_plan(spark, sf)
    plan = layout.undo_plan(organize_plan(spark, sf).filter("status = 'move'").select("source", "destination"),
                            moved.select(F.col("location").alias("path")))
    return layout.apply_undo(moved, plan)


def undo_repeated(spark, sf):
    """Organised, taken back, organised again and taken back: every document once, where it was."""
    path = f"{working_root(spark)}/corpusfold/{uuid.uuid4().hex}/manifest"
    catalog, structure = _catalog(spark, sf), folder_merge(spark, sf)
    for _ in range(2):
        done = organize(structure, catalog, SOURCE_DIR, TARGET_DIR, path)
        catalog = undo(spark, path, done.catalog).catalog
    return catalog.select("doc_id", "location")


def manifest(spark, sf):
    """Moves written to a manifest and read back."""
    path = f"{working_root(spark)}/corpusfold/{uuid.uuid4().hex}/manifest"
    write_manifest(organize_plan(spark, sf), path)
    return read_manifest(spark, path).select("source", "destination")


def write_folders(spark, sf):
    """Documents written one directory per folder and read back."""
    path = f"{working_root(spark)}/corpusfold/{uuid.uuid4().hex}/organized"
    docs = _documents(spark, sf).select(_path().alias("path"), "text")
    write_organized(docs, folder_merge(spark, sf), path)
    return spark.read.parquet(path).groupBy("folder").agg(
        F.count("*").alias("documents"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def decode_bytes(spark, sf):
    """Texts in four encodings, by language, decoded again; some lose a byte and with it their text."""
    value = F.col("text")
    latin = value.rlike(r"^[\x00-\xff]*$")
    wide = F.encode(value, "UTF-16")
    cut = F.substring(wide, F.lit(1), F.octet_length(wide) - 1)
    data = (F.when(F.col("lang") == "de", F.concat(F.unhex(F.lit("EFBBBF")), F.encode(value, "UTF-8")))
            .when((F.col("lang") == "es") & (F.col("doc_id") % 5 == 0) & (value != ""), cut)
            .when(F.col("lang") == "es", wide)
            .when((F.col("lang") == "fr") & latin, F.encode(F.when(latin, value), "ISO-8859-1"))
            .otherwise(F.encode(value, "UTF-8")))
    return _documents(spark, sf).select("doc_id", decode_text(data).alias("content"))


@F.arrow_udf(T.BinaryType())
def _as_docx(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def pack(value: str) -> bytes:
        runs = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in value.split("\n"))
        xml = ('<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
               f"<w:body>{runs}</w:body></w:document>")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("word/document.xml", xml)
        return out.getvalue()

    for texts in batches:
        for some in row_slices(texts):
            yield pa.array([pack(value) for value in some.to_pylist()], pa.binary())


def docx_lines(spark, sf):
    """Texts packed as .docx, a run per line, and read again; control characters become spaces."""
    docs = spread(_documents(spark, sf).select("doc_id", "text"))
    clean = F.regexp_replace(unix_newlines(F.col("text")), r"[\x00-\x09\x0b-\x1f]", " ")
    return docs.select("doc_id", docx_text(_as_docx(clean)).alias("content"))


def _written_tree(spark, sf) -> str:
    """Documents as a tree of files, a folder per source; its root."""
    root = f"{working_root(spark)}/corpusfold/{uuid.uuid4().hex}/tree"
    files = spread(_documents(spark, sf).select("source", _path().alias("name"), "text"))

    def write(rows):
        for row in rows:
            with storage.create(storage.join(root, row["source"], row["name"])) as f:
                f.write(row["text"].encode("utf-8"))

    files.foreachPartition(write)
    return root


def tree_scan(spark, sf):
    """Documents written as a tree of files, then scanned, read and rolled up."""
    return tree_documents(spark, _written_tree(spark, sf))


def tree_scan_parts(spark, sf):
    """The same in small pieces: files read a thousand bytes at a time, folders held a few thousand characters at a time."""
    return _rejoined(tree_documents(spark, _written_tree(spark, sf), chunk_bytes=1000, part_chars=PART_CHARS), "path")


def _rejoined(parts: DataFrame, key: str) -> DataFrame:
    """The text of each unit again, whether its parts are numbered without a gap, and whether all end with a sentence.

    Parts are sorted by Spark and added to the end of one text, so a unit is held once and not as a list, a text and a row.
    """
    cut = (F.col("part") + 1 == F.col("parts")) | F.col("content").rlike(r"(\n|[.!?][ \t\f\r])\z")
    return (parts.select(F.col(key).alias("key"), "part", "parts", "content", cut.alias("cut"))
            .repartition("key").sortWithinPartitions("key", "part", "content")
            .mapInArrow(_one_text, "key string, content string, numbered boolean, whole_sentences boolean").withColumnRenamed("key", key))


class _Unit:
    """The parts of a unit as they come, in order."""

    def __init__(self):
        self.text, self.rows, self.different, self.last, self.parts, self.cut = bytearray(), 0, 0, None, None, None

    def add(self, rows: pa.RecordBatch) -> None:
        texts, part, cut = rows.column("content").cast(pa.string()), rows.column("part").to_numpy(), rows.column("cut")
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset)
        if data is not None:
            self.text += memoryview(data)[ends[0]:ends[-1]]
        self.rows += len(part)
        self.different += int(part[0] != self.last) + int(np.count_nonzero(part[1:] != part[:-1]))
        self.last, self.parts = int(part[-1]), max(self.parts or 0, int(rows.column("parts").to_numpy().max()))
        if cut.null_count < len(cut):
            self.cut = (self.cut is not False) and pc.all(cut).as_py()

    def row(self, key: str | None) -> pa.RecordBatch:
        numbered = self.rows == self.parts == self.different and self.last + 1 == self.parts
        ends = pa.py_buffer(np.array([0, len(self.text)], np.int32))
        return pa.RecordBatch.from_pydict({
            "key": pa.array([key], pa.string()), "content": pa.StringArray.from_buffers(1, ends, pa.py_buffer(self.text)),
            "numbered": pa.array([numbered]), "whole_sentences": pa.array([self.cut], pa.bool_())})


def _one_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit, own = None, None
    for batch in batches:
        keys = batch.column("key").to_pylist()
        start = 0
        for stop in range(1, len(keys) + 1):
            if stop < len(keys) and keys[stop] == keys[start]:
                continue
            if unit is not None and keys[start] != own:
                done, unit = unit.row(own), None
                yield done
                del done
            if unit is None:
                unit, own = _Unit(), keys[start]
            unit.add(batch.slice(start, stop - start))
            start = stop
    if unit is not None:
        yield unit.row(own)


def _unit_parts(spark, sf) -> DataFrame:
    with working_tables(spark):
        return write_shared(text.rollup_units(_files(spark, sf), PART_CHARS), "unit_parts", keep=True)


def unit_rollup_parts(spark, sf):
    return _rejoined(_unit_parts(spark, sf), "unit")


def term_stats_parts(spark, sf):
    """Words counted part by part, with sentences numbered through each unit."""
    # The texts are not read again once they are counted.
    with working_tables(spark):
        parts = _unit_parts(spark, sf).select(F.col("unit").alias("cluster"), "part", F.col("content").alias("text"))
        numbered = parts.join(broadcast_if_small(keywords.sentence_offsets(parts, "cluster")), ["cluster", "part"])
        grams = write_shared(keywords.gram_counts(numbered), "grams", keep=True)
    return keywords.term_stats(grams)


def _letters(texts: list[str]) -> list[list[float]]:
    return [[t.count(c) / max(len(t), 1) for c in LETTERS] for t in texts]


def embed_encoder_parts(spark, sf):
    """A function as the encoder; units in several parts have one vector each."""
    parts = _unit_parts(spark, sf).select(F.col("unit").alias("path"), "part", "parts", F.col("content").alias("text"))
    vectors = embed.embed(parts, _letters).vectors
    return vectors.select("path", *[F.round(F.col("features")[i].cast("double"), 4).alias(f"share_{c}") for i, c in enumerate(LETTERS)])


def rescan_organized(spark, sf):
    """A tree organised into itself, then scanned by its markers alone; what was written, and the moves."""
    root = _written_tree(spark, sf)
    path = f"{working_root(spark)}/corpusfold/{uuid.uuid4().hex}/manifest"
    # What was organised lies in its folders by then: the working copy is not read again.
    with working_tables(spark):
        docs = tree_documents(spark, root)
        # A document in several parts is one document.
        first = docs.filter("part = 0")
        structure = first.select("path", F.concat(F.lit("Topic_"), F.regexp_extract("path", r"(\d)$", 1)).alias("folder"))
        catalog = first.select(F.concat_ws("/", F.lit(root), "path").alias("location"))
        organize(structure, catalog, root, manifest=path, documents=docs)
    scanned = read_tree(spark, root).groupBy("unit").agg(
        F.count("length").alias("files"), F.sum("length").alias("size"))
    written = (spark.read.option("basePath", root).parquet(f"{root}/folder=*").groupBy("folder")
               .agg(F.count_if(F.col("part") == 0).alias("files"), F.sum(F.length("content")).alias("size")))
    moved = read_manifest(spark, path).groupBy(F.split_part("destination", F.lit("/"), F.lit(-2)).alias("folder")).agg(
        F.count("*").alias("files"), F.lit(None).cast("bigint").alias("size"))
    return (scanned.select(F.lit("scanned").alias("kind"), F.col("unit").alias("name"), "files", "size")
            .unionByName(written.select(F.lit("written").alias("kind"), F.col("folder").alias("name"), "files", "size"))
            .unionByName(moved.select(F.lit("moved").alias("kind"), F.col("folder").alias("name"), "files", "size")))


def undo_chain(spark, sf):
    """Organised four times, each time from where the last left off, and taken back at once; some places are taken by then."""
    path = f"{working_root(spark)}/corpusfold/{uuid.uuid4().hex}/manifest"
    docs = _documents(spark, sf)
    catalog = docs.select("doc_id", F.concat_ws("/", F.lit("/run0"), _path()).alias("location"))
    folder = F.concat(F.lit("Topic_"), F.regexp_extract("source", r"(\d)$", 1))
    inside = _path()
    for run in range(4):
        structure = docs.select(folder.alias("folder"), inside.alias("path"))
        catalog = write_shared(organize(structure, catalog, f"/run{run}", f"/run{run + 1}", path).catalog, "catalog")
        inside = F.concat_ws("/", folder, inside)
    others = docs.filter("doc_id % 7 = 0").select(
        (-1 - F.col("doc_id")).alias("doc_id"), F.concat_ws("/", F.lit("/run0"), _path()).alias("location"))
    return undo(spark, path, catalog.unionByName(others)).catalog.select("doc_id", "location")


def tree_extractors(spark, sf):
    """A tree with files of a kind of its own, read by a function, and files in a declared encoding."""
    root = f"{working_root(spark)}/corpusfold/{uuid.uuid4().hex}/tree"
    files = spread(_documents(spark, sf).select("doc_id", "lang", "text"))

    def write(rows):
        for row in rows:
            ext, encoding = ("rev", "utf-8") if row["lang"] == "en" else ("txt", "cp1252")
            with storage.create(storage.join(root, f"{row['doc_id']}.{ext}")) as f:
                data = row["text"].encode(encoding, "replace")
                f.write(data[::-1] if ext == "rev" else data)

    files.foreachPartition(write)
    found = tree_documents(spark, root, extractors={".rev": lambda data: data[::-1].decode()}, encoding="cp1252")
    return found.select("path", F.sha2("content", 256).alias("content_sha256"))


def prepared_stream(spark, sf):
    """Documents as a stream of files, prepared as they arrive."""
    root = f"{working_root(spark)}/corpusfold/{uuid.uuid4().hex}"
    files = _files(spark, sf).select("rel_path", "content")
    files.write.parquet(f"{root}/in")
    stream = prepare_stream(spark.readStream.schema(files.schema).parquet(f"{root}/in"), 3, exclude_patterns=["*7.txt"])
    query = (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def candidate_range(spark, sf):
    """The numbers of clusters that are tried, from the number of rows."""
    counts = [_vectors(spark, sf).filter(F.col("label") < n).count() for n in (1, 5, 10)]
    rows = [(i, k) for i, n in enumerate([0, 1, 2, 3, 5, *counts]) for k in choose.candidate_ks(n, 10)]
    return spark.createDataFrame(rows, "case int, k int")


def analyze_documents_paths(spark, sf):
    """Every document has one place."""
    return analyze_documents(spark, sf).groupBy("path").agg(F.count("*").alias("places"))


def embed_tfidf(spark, sf):
    raw = F.unwrap_udt("features")
    cells = F.inline(F.arrays_zip(raw["indices"].alias("bucket"), raw["values"].alias("weight")))
    return _rounded(embed.embed(_named_texts(spark, sf)).vectors.select("path", cells))


def _named_texts(spark, sf):
    docs = _documents(spark, sf).select(_path().alias("path"), F.col("text").alias("content"))
    return text.weighted_text(docs).drop("content")


def kmeans_best(spark, sf):
    vectors = write_shared(spread(_vectors(spark, sf)), "vectors")
    fit = cluster.kmeans_best(vectors, 5)
    return cluster.assign(vectors, fit.centers).select("vec_id", "cluster")


def kmeans_checks(spark, sf):
    """What must hold of the best fit, whatever the centres: every row at its nearest, centres at the means, and its inertia."""
    vectors = write_shared(spread(_vectors(spark, sf)), "vectors")
    fit = cluster.kmeans_best(vectors, 5)
    placed = write_shared(cluster.assign(vectors, fit.centers), "placed")
    again = quality.cluster_inertia(placed, 5).first()["distortion"]
    single = cluster.fit_all(vectors, [5], restarts=1)[0].cost
    return placed.agg(F.count("*").alias("rows"), F.count_distinct("cluster").alias("clusters"),
                      (F.max("cluster") - F.min("cluster")).alias("span")).select(
        "rows", "clusters", "span", F.lit(abs(again - fit.cost) <= 1e-3 * fit.cost).alias("cost_is_inertia"),
        F.lit(fit.cost <= single).alias("best_of_restarts"))


def kmeans_fit(spark, sf):
    vectors = _vectors(spark, sf).select("vec_id", array_to_vector("features").alias("features"))
    return cluster.kmeans(vectors, 5).transform(vectors).select("vec_id", "cluster")


def kmeans_sweep(spark, sf):
    vectors = write_shared(spread(_vectors(spark, sf)), "vectors")
    return _rounded(choose.sweep_k(vectors).metrics)


def analyze_documents(spark, sf):
    docs = _documents(spark, sf).select(_path().alias("path"), F.col("text").alias("content"))
    return analyze(docs).structure


def analyze_vectors(spark, sf):
    """The analysis with ready vectors instead of word counts."""
    vectors = _vectors(spark, sf).select(_path("vec_id").alias("path"), "features")
    docs = _documents(spark, sf).select(_path().alias("path"), F.col("text").alias("content"))
    return analyze(docs, encoder=vectors).structure


def analyze_vectors_paths(spark, sf):
    """Every document has a place, with or without a vector."""
    return analyze_vectors(spark, sf).select("path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (
    corpus_scan, noise_filter, exclude_glob, ext_class, unit_rollup, weighted_text, skip_organized,
    organized_folders, tags_text, duration_cap, transcript, audio_content, embedding_join,
    cluster_inertia, calinski_harabasz, silhouette_exact, silhouette_sampled, silhouette_squared, kmeans_assign,
    sweep_metrics, select_k, term_stats, keyword_scores, keyword_scores_three, keyword_topk, keyword_distinct, folder_name,
    folder_merge, structure_summary, organize_plan, undo_plan, apply_plan, undo_roundtrip, undo_repeated, manifest,
    write_folders, decode_bytes, docx_lines, tree_scan, tree_scan_parts,
    unit_rollup_parts, term_stats_parts, embed_encoder_parts, rescan_organized, undo_chain, tree_extractors, prepared_stream,
    candidate_range, analyze_documents_paths, embed_tfidf, kmeans_best, kmeans_checks, kmeans_fit,
    kmeans_sweep, analyze_documents, analyze_vectors, analyze_vectors_paths)}
