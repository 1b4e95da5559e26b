"""Quality rules whose limits each language and source sets for itself, from mergeable quantile sketches.

A sketch counts values in cells that keep the eight leading bits of an integer (Tene's HdrHistogram layout): two sketches merge
by adding counts, reruns agree, and a quantile is at most 1/128 above the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import chain
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusfold.llm.common import broadcast_if_light, text_slices
from corpusfold.session import write_shared

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
BLANKS, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
SLICE_BYTES = 4 << 20

# Base rules: shorter texts, and texts of which a larger share (in hundredths) repeats, fail everywhere.
LEAST_WORDS, MOST_REPEATED = 50, 50
# Values are shares in millionths: what is divided by what, whether low values are outliers too, and the least spread. The
# spread of a group is the distance of its quartiles; where half the group is alike that says nothing, so it is at least this.
UNIT = 1_000_000
RULES = [("word_length", "word_chars", "n_words", True, 500_000),
         ("symbols", "n_symbols", "n_words", False, 20_000),
         ("dup_lines", "n_dup_lines", "n_lines", False, 150_000),
         ("repeats", "n_repeat_words", "n_words", False, 120_000)]
# A value is an outlier so many spreads outside the quartiles.
FENCE = 3
# Groups with fewer documents use the merged sketch of their language, and languages with fewer that of all documents.
LEAST_DOCS = 100
GROUP = ["lang", "source"]


def text_counts(texts: Sequence[bytes]) -> list[np.ndarray]:
    """The ``COUNTS`` of each text."""
    words = [t.split() for t in texts]  # the blanks of bytes.split are BLANKS
    n_words = np.fromiter(map(len, words), np.int64, len(texts))
    lines = [[line for line in t.split(b"\n") if line.strip()] for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, len(texts))
    different = np.fromiter((len(set(x)) for x in lines), np.int64, len(texts))
    symbols = np.fromiter((len(t) - len(t.translate(None, SYMBOLS)) for t in texts), np.int64, len(texts))
    # Code points: all bytes but those that carry one on.
    tails = bytes(range(0x80, 0xC0))
    chars = np.fromiter((len(t.translate(None, BLANKS + tails)) for t in texts), np.int64, len(texts))
    return [n_words, chars, symbols, n_lines, n_lines - different, _repeated_words(words, n_words)]


def _repeated_words(words: list[list[bytes]], counts: np.ndarray) -> np.ndarray:
    """Per text, how many words lie in a window of three that the text holds twice or more."""
    n = int(counts.sum())
    if n < 3:
        return np.zeros(len(counts), np.int64)
    coded = pa.array(chain.from_iterable(words), pa.large_binary(), size=n).dictionary_encode()
    code, different = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    text = np.repeat(np.arange(len(counts)), counts)
    # Numbers for pairs, then for triples; those of different texts differ. A slice keeps the products below 2^63.
    pair = pd.factorize((text[:-1] * different + code[:-1]) * different + code[1:])[0]
    whole = text[:-2] == text[2:]
    triple = pd.factorize((pair[:-1] * different + code[2:])[whole])[0]
    again = np.zeros(n, bool)
    again[np.flatnonzero(whole)[np.bincount(triple)[triple] > 1]] = True
    again[2:] |= again[:-2].copy() | again[1:-1].copy()
    again[1] |= again[0]
    return np.bincount(text[again], minlength=len(counts)).astype(np.int64)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the ``COUNTS`` of each whole text; columns of those names are replaced. A null text is empty."""
    docs = docs.drop(*COUNTS)
    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.LongType()) for c in COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column(text_col), SLICE_BYTES):
                rows = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(rows.columns + [pa.array(c) for c in text_counts(texts)], names=schema.names)

    return docs.mapInArrow(count, schema)


def base_failed() -> Column:
    return ((F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _value(part: str, whole: str) -> Column:
    return F.expr(f"(`{part}` * {UNIT}L) DIV greatest(`{whole}`, 1L)")


def _cell(value: Column) -> Column:
    """The largest integer with the same eight leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift) + 1, shift) - 1


def sketch(measured: DataFrame) -> DataFrame:
    """``lang, source, rule, cell, n``: how many documents that pass the base rules have a value in a cell."""
    cells = [F.struct(F.lit(name).alias("rule"), _cell(_value(part, whole)).alias("cell")) for name, part, whole, _, _ in RULES]
    return (measured.filter(~base_failed()).select(*GROUP, F.inline(F.array(*cells)))
            .groupBy(*GROUP, "rule", "cell").agg(F.count("*").alias("n")))


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of the groups that ``keys`` tell apart, from finer ones, or from those of several tables in one."""
    return sketches.groupBy(*keys, "rule", "cell").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: ``docs`` and for each rule ``<rule>_low, <rule>_high``, the values it allows."""
    cells = Window.partitionBy(*keys, "rule")
    below = F.sum("n").over(cells.orderBy("cell"))
    counted = sketches.withColumn("below", below).withColumn("total", F.sum("n").over(cells))
    quartiles = counted.groupBy(*keys, "rule").agg(
        F.max("total").alias("total"), F.min(F.when(4 * F.col("below") >= F.col("total"), F.col("cell"))).alias("q1"),
        F.min(F.when(4 * F.col("below") >= 3 * F.col("total"), F.col("cell"))).alias("q3"))
    limits = []
    for name, _, _, two_sided, least in RULES:
        reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        low = F.col("q1") - reach if two_sided else F.lit(0).cast("bigint")
        limits += [F.max(F.when(F.col("rule") == name, v)).alias(f"{name}_{end}")
                   for end, v in (("low", low), ("high", F.col("q3") + reach))]
    return quartiles.groupBy(*keys).agg(F.max("total").alias("docs"), *limits)


def limits(sketches: DataFrame) -> DataFrame:
    """``lang, source`` and the limits that hold there: their own, those of the language, or those of all documents."""
    names = [f"{rule[0]}_{end}" for rule in RULES for end in ("low", "high")]
    # One row.
    every = fences(merge(sketches, []), []).collect()
    everywhere = {c: F.lit(every[0][c] if every else None).cast("bigint") for c in names}
    of_lang = fences(merge(sketches, ["lang"]), ["lang"]).filter(F.col("docs") >= LEAST_DOCS).select(
        F.col("lang").alias("_lang"), *[F.col(c).alias(f"_{c}") for c in names])
    own = fences(sketches, GROUP)
    joined = own.join(of_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return joined.select(*GROUP, *[F.when(F.col("docs") >= LEAST_DOCS, F.col(c)).otherwise(
        F.coalesce(F.col(f"_{c}"), everywhere[c])).alias(c) for c in names])


def judge(measured: DataFrame, allowed: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``: within all limits of its language and source.

    ``allowed`` is a written table of ``limits``. Documents without a language or source are groups as well.
    """
    names = [c for c in measured.columns if c not in ("base_failed", "kept")]
    found = allowed.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                           *[F.col(c).alias(f"_{c}") for c in allowed.columns if c not in GROUP])
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    within = reduce(and_, [_value(part, whole).between(F.col(f"_{name}_low"), F.col(f"_{name}_high"))
                           for name, part, whole, _, _ in RULES])
    return (measured.join(broadcast_if_light(found), same, "left")
            .select(*names, base_failed().alias("base_failed"), (~base_failed() & F.coalesce(within, F.lit(False))).alias("kept")))


def apply_rules(docs: DataFrame) -> DataFrame:
    """``docs`` (``text, lang, source`` and whatever else) with ``COUNTS``, ``base_failed`` and ``kept``; one row for each, in no order.

    The texts are measured twice, once for the sketches, and are not shuffled while the limits are few enough to broadcast.
    Repeated rows count each time. Columns with those names are replaced; an empty table gives an empty result.
    """
    counted = write_shared(sketch(measure(docs.select(*GROUP, "text"))), "sketches")
    return judge(measure(docs), write_shared(limits(counted), "limits"))


def quality(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """As ``apply_rules`` without the texts, which are read once: ``id_col, lang, source``, counts and verdict."""
    narrow = docs.select(id_col, *GROUP, "text")
    measured = write_shared(measure(narrow).drop("text"), "measured")
    counted = write_shared(sketch(measured), "sketches")
    return judge(measured, write_shared(limits(counted), "limits"))
