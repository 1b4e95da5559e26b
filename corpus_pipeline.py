"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.llm import lines, minhash, mixing, packing
from corpusfold.llm import toxicity as tox
from corpusfold.session import working_root, working_tables, write_shared

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar does not find toxic; it learns from the table of labels."""
    grammar = tox.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (tox.score_documents(docs, grammar, out="_toxicity").filter(F.col("_toxicity") < 0.5)
            .select(*docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a source repeats; no document goes.

    The site is the source, with the shares of ``lines.repeated_lines``. A class of near copies counts once: a line is not
    boilerplate because its document was copied, and the copies meet again in the next stage.
    """
    classes = write_shared(minhash.near_duplicates(docs).select("doc_id", "class_id").distinct(), "classes")
    counted = docs.select("doc_id", "source", lines.line_lengths(F.col("text")).alias("lines")).join(
        classes.filter("doc_id <> class_id").select("doc_id"), "doc_id", "left_anti")
    cleaned = lines.drop_repeated(docs, lines.repeated_lines(counted), classes)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, the one with the smallest id; rows may share an id or have none."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Rows may share an id or have none."""
    keyed = write_shared(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    return mixing.apply_mix(keyed, mixing.mix(keyed, id_col="_row"), id_col="_row").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in the sequences."""
    pieces = packing.document_pieces(docs, TOKENIZER)
    return packing.pack_pieces(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]

# Tokens, signatures and a learned grammar are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    root = f"{working_root(spark)}/corpusfold/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{root}/{name}"
        # The tables that a stage works on go with it.
        with working_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
