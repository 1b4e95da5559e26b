"""One vector per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfold.session import spread, write_shared

NUM_FEATURES = 1024
# Anything but letters, marks and digits separates words.
_SEPARATOR = r"[^\p{L}\p{M}\p{N}]+"


class Embedding(NamedTuple):
    """``vectors``: one row per id with ``features``, a written table or a few narrow steps from one.
    ``apply`` gives a row of text its vector without a shuffle; it is None where that is impossible
    or dear, and then vectors are joined by id."""
    vectors: DataFrame
    apply: Callable[[DataFrame], DataFrame] | None


def embed(texts: DataFrame, encoder="tfidf", id_col: str = "path", text_col: str = "text",
          num_features: int = NUM_FEATURES) -> Embedding:
    """Turn every text into a vector.

    ``encoder`` is ``"tfidf"`` (hashed words, weighted, unit length), a DataFrame of ready vectors
    (``id_col, features``; texts without a usable one have no row here), or a function from a list of texts to a list of vectors, called on
    Arrow batches on the workers. A document in several parts has the mean of their vectors, weighted by length.
    """
    if isinstance(encoder, DataFrame):
        ids = texts.select(id_col).distinct() if "parts" in texts.columns else texts.select(id_col)
        return Embedding(write_shared(usable(embedding_join(ids, encoder, id_col)), "vectors"), None)
    if encoder == "tfidf":
        return _tfidf(texts, id_col, text_col, num_features)
    if callable(encoder):
        return _encoded(texts, encoder, id_col, text_col)
    raise ValueError(f"unknown encoder: {encoder!r}")


def embedding_join(documents: DataFrame, vectors: DataFrame, id_col: str = "path") -> DataFrame:
    """All documents with their ready vectors, null where there is none; ids are unique on the vector side."""
    return documents.join(vectors.select(id_col, "features"), id_col, "left")


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that have a vector, with no null in it."""
    whole = vectors.filter("features IS NOT NULL")
    if vectors.schema["features"].dataType.typeName() != "array":
        return whole
    return whole.filter(F.forall("features", lambda x: x.isNotNull()))


def _words(text_col: str) -> RegexTokenizer:
    return RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=_SEPARATOR)


def _tfidf(texts: DataFrame, id_col: str, text_col: str, num_features: int) -> Embedding:
    words, hashed = _words(text_col), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)
    normal = Normalizer(inputCol="_weighted", outputCol="features", p=2.0)

    def counts(df: DataFrame) -> DataFrame:
        present = df.withColumn(text_col, F.coalesce(text_col, F.lit("")))
        return hashed.transform(words.transform(present)).drop("_words")

    columns = [c for c in (id_col, "parts", text_col) if c in texts.columns]
    tf = counts(spread(texts.select(*columns))).drop(text_col)
    # The texts are read once; the word counts, a fraction of their size, are what is kept.
    tf = write_shared(_merge_parts(tf, id_col), "word_counts")
    idf = IDF(inputCol="_tf", outputCol="_weighted").fit(tf)

    def weighted(df: DataFrame) -> DataFrame:
        return normal.transform(idf.transform(df)).drop("_tf", "_weighted")

    def apply(df: DataFrame) -> DataFrame:
        return weighted(counts(df))

    return Embedding(weighted(tf), apply)


def _merge_parts(tf: DataFrame, id_col: str) -> DataFrame:
    """Add up the word counts of documents held in several parts; the others are not shuffled."""
    if "parts" not in tf.columns:
        return tf
    many = tf.filter("parts > 1").groupBy(id_col).agg(Summarizer.sum(F.col("_tf")).alias("_tf"))
    return tf.filter("parts = 1").select(id_col, "_tf").unionByName(many)


def _encoded(texts: DataFrame, encoder: Callable, id_col: str, text_col: str) -> Embedding:
    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(encoder(batch.tolist())))

    in_parts = "parts" in texts.columns
    rows = spread(texts.select(id_col, *(["parts"] if in_parts else []), text_col))
    vectors = rows.withColumn("features", vector(text_col))
    if not in_parts:
        # A model is dear to run: its vectors are written once and joined later.
        return Embedding(write_shared(vectors.select(id_col, "features"), "vectors"), None)
    weight = F.greatest(F.length(text_col), F.lit(1)).cast("double").alias("weight")
    return Embedding(write_shared(_pooled(write_shared(vectors.select(id_col, "parts", "features", weight), "part_vectors"),
                                          id_col), "vectors"), None)


def _pooled(vectors: DataFrame, id_col: str) -> DataFrame:
    """One vector per document: of several parts, the mean by their lengths. Sums merge, so no document is gathered."""
    mean = Summarizer.mean(array_to_vector("features"), F.col("weight"))
    many = vectors.filter("parts > 1").groupBy(id_col).agg(vector_to_array(mean, "float32").alias("features"))
    return vectors.filter("parts = 1").select(id_col, "features").unionByName(many)
