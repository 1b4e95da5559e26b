"""Corpora that are tables already, and the manifests of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("path", T.StringType(), False),
                          T.StructField("content", T.StringType(), True)])

MANIFEST = "run_id string, source string, destination string, moved_at timestamp"


def read_corpus(spark: SparkSession, path: str, format: str = "parquet",
                schema: T.StructType | str = DOCUMENTS, **options) -> DataFrame:
    """A corpus stored as parquet, JSON, CSV, ORC or text, with an explicit schema: nothing is inferred."""
    return spark.read.format(format).schema(schema).options(**options).load(path)


def read_manifest(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Moves of earlier runs: JSON lines as ``write_manifest`` leaves them, or one JSON array per file."""
    return spark.read.schema(MANIFEST).option("multiLine", array).json(path)
