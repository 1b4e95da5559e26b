"""Lines that a site repeats over its pages, found by their share of the pages of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.llm.common import join_ids
from corpusfold.session import broadcast_if_small, write_shared

# A line on more than this share of a host's pages is boilerplate...
RATIO = 0.1
# ...if that is at least so many pages, or all pages of a host with two or more: a share of few pages says little.
MIN_PAGES = 5
# A source is far larger than a site, and texts share a line by chance the less the longer it is: RATIO holds for lines of
# one word and halves with each word more. Above LONG_WORDS words so many documents are enough, however large the source;
# such a line may be a passage and no notice, so one document keeps it unless its share is above RATIO.
LONG_WORDS, LONG_PAGES = 50, 2
BLANKS = " \t\r"
# Places of a map of hashes for each text in it.
PLACES = 16
# A word; scripts written without spaces have about two characters to a word.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[{_UNSPACED}]{{1,2}}|[^\s{_UNSPACED}]+"


def line_keys(text: Column) -> Column:
    """A key for each line, without the blanks around it; null for blank lines."""
    return F.transform(F.split(text, "\n"), lambda s: F.when(
        F.btrim(s, F.lit(BLANKS)) != "", F.xxhash64(F.btrim(s, F.lit(BLANKS)))))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, keys`` from ``host, text``: the lines on more than ``ratio`` of the host's pages.

    That has to be ``min_pages`` pages at least, or each of two or more. A page counts once however often it has a
    line; a page that occurs twice counts twice. A host has at most (mean lines of its pages) / ``ratio`` such lines.
    """
    totals = pages.groupBy(F.col("host").alias("_of")).agg(F.count("*").alias("total"))
    counts = (pages.select("host", F.explode(F.array_compact(F.array_distinct(line_keys(F.col("text"))))).alias("key"))
              .groupBy("host", "key").agg(F.count("*").alias("pages"))
              .filter(F.col("pages") >= min(2, min_pages)))
    # Totals are one small row per host; the other side has been counted down already.
    common = (counts.join(totals, F.col("host").eqNullSafe(F.col("_of")))
              .filter((F.col("pages") > F.col("total") * F.lit(ratio))
                      & ((F.col("pages") >= min_pages) | (F.col("pages") == F.col("total")))))
    return common.groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with the text rid of boilerplate, and ``n_lines, n_dropped``.

    Lines that are not blank count, each time they occur. A page that would keep none of them is left as it
    is: it is repeated as a whole, which is for other operators to judge. Pages without a host are one site.
    A null text stays null and has no lines; columns named like the two counts are replaced.

    Texts are read twice and not shuffled while the keys of all hosts are few enough to broadcast.
    """
    keyed = pages.withColumn("_host", host)
    found = boilerplate(keyed.select(F.col("_host").alias("host"), F.col(text_col).alias("text")), ratio, min_pages)
    found = write_shared(found.select(F.col("host").alias("_site"), F.col("keys").alias("_keys")), "boilerplate")
    found = broadcast_if_small(found, 10_000)
    joined = keyed.join(found, F.col("_host").eqNullSafe(F.col("_site")), "left")
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return _without_keys(joined, text_col).select(*names, "n_lines", "n_dropped")


def line_lengths(text: Column) -> Column:
    """The different lines that are not blank: ``key`` as in ``line_keys``, and ``words``, counted up to LONG_WORDS + 1."""
    def entry(line: Column) -> Column:
        words = F.least(F.regexp_count(line, F.lit(WORD)), F.lit(LONG_WORDS + 1))
        return F.when(line != "", F.struct(F.xxhash64(line).alias("key"), words.alias("words")))

    return F.array_compact(F.array_distinct(F.transform(F.split(text, "\n"), lambda s: entry(F.btrim(s, F.lit(BLANKS))))))


def repeated_lines(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``source, key, keeper`` from ``doc_id, source, lines`` (of ``line_lengths``): what repeats too often for its length.

    ``keeper`` is the least id of the documents that have the line, if one is to keep it.
    """
    totals = docs.groupBy(F.col("source").alias("_of")).agg(F.count("*").alias("total"))
    long_ = F.col("words") > LONG_WORDS
    counts = (docs.select("doc_id", "source", F.explode("lines").alias("line"))
              .select("doc_id", "source", "line.key", "line.words")
              .groupBy("source", "key", "words").agg(F.count("*").alias("held"), F.min("doc_id").alias("first"))
              .filter(F.col("held") >= F.when(long_, LONG_PAGES).otherwise(min_pages)))
    share = F.lit(ratio) * F.pow(F.lit(0.5), F.col("words") - 1)
    common = (F.col("held") > F.col("total") * F.lit(ratio)) & (F.col("held") >= min_pages)
    return (counts.join(totals, F.col("source").eqNullSafe(F.col("_of")))
            .filter(long_ | (F.col("held") > F.col("total") * share))
            .select("source", "key", F.when(long_ & ~common, F.col("first")).alias("keeper")))


def drop_repeated(docs: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs`` without the lines that ``found`` (of ``repeated_lines``) has for their source, and ``n_lines, n_dropped``.

    The keeper of a line keeps it, and so do the documents of its class (``doc_id, class_id``), which stay copies of it.
    As in ``drop_boilerplate`` a text that would keep no line is left as it is. A source may have any number of such
    lines: they are looked up by joins, and the lines that go are gathered per source and text, equal texts once. Only texts
    that lose lines are shuffled to meet them, and one in PLACES of the others.
    """
    found = write_shared(found.select(F.col("source").alias("_of"), "key", "keeper"), "repeated")
    keyed = docs.withColumn("_source", F.col("source")).withColumn("_digest", F.xxhash64("text"))
    hits = (keyed.select("doc_id", "_source", "_digest", F.explode(F.array_compact(F.array_distinct(line_keys(F.col("text"))))).alias("_key"))
            .join(broadcast_if_small(found), F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("key")))
            .select("doc_id", "_source", "_digest", "_key", "keeper"))
    hits = write_shared(hits, "hits")
    kept = (hits.filter("keeper IS NOT NULL").join(classes, "doc_id", "left")
            .filter(~F.col("class_id").eqNullSafe(F.col("keeper"))).select("_source", "_digest", "_key"))
    gone = (hits.filter("keeper IS NULL").select("_source", "_digest", "_key").unionByName(kept)
            .groupBy(F.col("_source").alias("_of"), F.col("_digest").alias("_text")).agg(F.collect_set("_key").alias("_keys")))
    gone = write_shared(gone, "gone")
    places = F.lit(PLACES * max(gone.count(), 1))
    marked = write_shared(gone.select(F.pmod("_text", places).alias("_place")), "places")
    keyed = keyed.withColumn("_place", F.pmod("_digest", places))
    lose, keep = (join_ids(keyed, marked, "_place", how) for how in ("left_semi", "left_anti"))
    joined = lose.join(gone, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_digest") == F.col("_text")), "left")
    joined = joined.unionByName(keep, allowMissingColumns=True)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return _without_keys(joined, "text").select(*names, "n_lines", "n_dropped")


def _without_keys(joined: DataFrame, text_col: str) -> DataFrame:
    """The texts without the lines in ``_keys``, and ``n_lines, n_dropped``."""
    lines = F.arrays_zip(F.split(text_col, "\n").alias("line"), line_keys(F.col(text_col)).alias("key"))
    kept = F.filter("_lines", lambda x: x["key"].isNull() | ~F.array_contains(F.col("_keys"), x["key"]))
    full = F.filter("_lines", lambda x: x["key"].isNotNull())
    left = F.size(F.filter("_kept", lambda x: x["key"].isNotNull()))
    return (joined.withColumn("_lines", lines)
            .withColumn("_kept", F.when(F.col("_keys").isNull(), F.col("_lines")).otherwise(kept))
            .withColumn("n_lines", F.when(F.col("_lines").isNull(), 0).otherwise(F.size(full)).cast("bigint"))
            .withColumn("_left", left)
            .withColumn("n_dropped", F.when((F.col("_left") > 0) & F.col("_keys").isNotNull(),
                                            F.col("n_lines") - F.col("_left")).otherwise(0).cast("bigint"))
            .withColumn(text_col, F.when(F.col("n_dropped") > 0, F.array_join(
                F.transform("_kept", lambda x: x["line"]), "\n")).otherwise(F.col(text_col))))


# Where one block of a page ends and the next begins, and what is not text at all.
_HIDDEN = r"(?s)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:p|div|li|ul|ol|br|h[1-6]|nav|article|header|footer|section|table|tr|td|th|title|head|body|html)\b[^>]*>|[\r\n]+"
_TAG = r"<[^>]+>"


def page_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def page_lines(html: Column) -> Column:
    """The visible text of a page, a block element a line."""
    blocks = F.regexp_replace(F.regexp_replace(html, _HIDDEN, ""), _BLOCK, "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(blocks, _TAG, ""), r"\n[\n \t]*", "\n"), F.lit("\n \t"))
