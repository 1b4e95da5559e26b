"""Threshold-scaled sketches of word shingles, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfold.llm.common import range_of

WORDS = 5
# The fixed fraction of shingle hashes that a sketch retains: one in four.
SCALE = 4
_BITS = 48
ROWS_PER_BUCKET = 4096
MAX_BUCKETS = 8192


def sketch(text: Column, scale: int = SCALE, words: int = WORDS) -> Column:
    """Every different shingle hash below ``2**48 / scale``, ascending, as ``array<bigint>``.

    A shingle is a word with the ``words - 1`` words before it (fewer at the start of the text), in lower
    case, so a text has as many shingles as words. The fraction is the same for all texts, so sketches of sets of
    shingles ``merge`` into that of their union, and sketches of very unequal texts can be compared. A text
    with words none of whose hashes is below the threshold keeps its least hash; no words, no hashes.
    """
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    marks = F.transform(parts, lambda w: F.xxhash64(w))

    def hashes(held: Column) -> Column:
        return F.transform(held, lambda w, i: F.shiftrightunsigned(F.xxhash64(F.slice(
            held, F.greatest(i - (words - 2), F.lit(1)), F.least(i + 1, F.lit(words)))), 64 - _BITS))

    # Each step is given its input as a value, so nothing is computed twice.
    return _let(_let(marks, hashes), lambda all_: _retained(all_, scale))


def _retained(hashes: Column, scale: int) -> Column:
    """Of some hashes those below the threshold, or the least if there are none."""
    low = F.filter(hashes, lambda h: h < F.lit((1 << _BITS) // scale))
    least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(low)
    return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(least)


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def to_text(hashes: Column) -> Column:
    """A sketch as a string, twelve hexadecimal digits a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 12, "0"))), "")


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of all the shingles of two sketches of that scale: a least hash above the threshold goes if others are below."""
    return _let(F.array_union(a, b), lambda both: _retained(both, scale))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that is in the larger: 0 to 1; two empty ones are alike."""
    smaller = F.least(F.size(a), F.size(b))
    return (F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller)
            .when(F.size(a) == F.size(b), 1.0).otherwise(0.0).cast("double"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **derived: Column) -> DataFrame:
    """``doc_id, text, next_text`` in ascending order of ids; the first text follows the last.

    Each column ``derived`` from ``text`` comes with its value for the next text, as ``next_<name>``.

    Ids are dealt into ranges of about equal counts; each range gets the first row of the range after
    it as a guest, so that one shuffle of the texts and a window per range are enough. Null texts are
    empty; null ids come first; rows of one id are ordered by a hash of the text.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    count = rows.count()
    wanted = min(MAX_BUCKETS, max(1, count // ROWS_PER_BUCKET))
    cuts: list[int] = []
    if wanted > 1:
        cuts = sorted(set(rows.select(F.percentile_approx(
            key, [i / wanted for i in range(1, wanted)], 100_000)).first()[0]))
    bucket = range_of(cuts, key)
    # One row per bucket, MAX_BUCKETS at most.
    firsts = sorted((b, k) for b, k in rows.select(bucket.alias("b"), key.alias("k"))
                    .groupBy("b").agg(F.min("k")).collect())
    hosts = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    guests = rows.sparkSession.createDataFrame(hosts, "k bigint, host int")
    dealt = (rows.withColumn("k", key).withColumn("b", bucket).join(F.broadcast(guests), "k", "left")
             .select("doc_id", "k", "text", F.explode(F.when(F.col("host").isNull(), F.array(_seat(F.col("b"), False)))
                                                      .otherwise(F.array(_seat(F.col("b"), False), _seat(F.col("host"), True)))).alias("s"))
             .select("doc_id", "k", "text", "s.b", "s.guest"))
    order = Window.partitionBy("b").orderBy("guest", "k", F.xxhash64("text"))
    names = ["text", *derived]
    # Derived after the shuffle: only texts are moved.
    return (dealt.repartition("b").withColumns(derived)
            .withColumns({f"next_{c}": F.lead(c).over(order) for c in names}).filter("NOT guest")
            .select("doc_id", *names, *[f"next_{c}" for c in names]))


def _seat(bucket: Column, guest: bool) -> Column:
    return F.struct(bucket.cast("int").alias("b"), F.lit(guest).alias("guest"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      scale: int = SCALE) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last ``floor(n_chars / 4)`` code points replaced by the first as many (or
    all) of the next document. ``near_edited`` and ``near_next`` are the containments of the
    fingerprint with those of the edited text and of the next document. An empty text has an empty
    fingerprint; a single row is its own next; an empty table gives no rows.
    """
    n = F.char_length("text")
    edit = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - edit), F.substring(F.col("next_text"), F.lit(1), edit))
    rows = (with_next(docs, id_col, text_col, own=sketch(F.col("text"), scale))
            .select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "own", "next_own")
            .select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own",
                    sketch(F.col("edited"), scale).alias("other")))
    return rows.select("doc_id", "n_chars", "edited_sha256", to_text(F.col("own")).alias("fingerprint"),
                       to_text(F.col("other")).alias("edited_fingerprint"),
                       containment(F.col("own"), F.col("other")).alias("near_edited"),
                       containment(F.col("own"), F.col("next_own")).alias("near_next"))
