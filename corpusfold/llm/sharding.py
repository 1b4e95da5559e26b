"""Shards of nearly equal bytes by sampled splitters, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusfold.llm.common import LEAST, range_of
from corpusfold.session import write_shared

RANGES_PER_SHARD = 64
ROWS_PER_RANGE = 200_000
# Splitters are a constant of the plan, and the sample goes to the driver: both are bounded.
MAX_RANGES = 8192
DRAWS_PER_RANGE = 32
OVERFULL = 2.0
ROUNDS = 4

SCHEMA = ("doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int")


def _sample(keyed: DataFrame, step: float, seed: int) -> list[tuple[int, int]]:
    """Keys drawn with a chance in proportion to size, one per ``step`` bytes on average, in order.

    A hash of the key is the die, so that a task that runs again draws the same.
    """
    die = F.pmod(F.xxhash64("mark", "tie", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = keyed.select("mark", "tie", F.floor(F.col("size") / F.lit(step) + die).alias("draws")).filter("draws > 0")
    return sorted(pair for mark, tie, draws in drawn.collect() for pair in [(mark, tie)] * draws)


def _quantiles(sample: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    """Boundaries between ``parts`` ranges. A key stays whole unless it fills a range on its own."""
    at = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    marks = [mark for mark, _ in at]
    out = []
    for i, (mark, tie) in enumerate(at):
        out.append((mark, tie if i and marks[i - 1] == mark else LEAST))
    return sorted(set(out))


def shard_by_size(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                  seed: int = 17) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row; the law is ``bytes``.

    ``size`` is the bytes of the text in UTF-8 (none for null) plus 1. The key is a hash of the text,
    then the id, so equal texts lie side by side and share a shard, unless they fill more than a range
    (about 1/64 of a shard), when they are spread over as many ranges as they need. Ranges come from a
    size-weighted sample of at most ``32 * MAX_RANGES`` keys or so; ranges that turn out overfull are sampled
    again and divided. Exact counts per range then place every row: shards differ by a range at most.
    Repeated rows and null ids are placed like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = write_shared(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("mark"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST)).alias("tie")), "keys")
    rows, total = keyed.agg(F.count("*"), F.sum("size")).first()
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    ranges = min(MAX_RANGES, max(shards * RANGES_PER_SHARD, -(-rows // ROWS_PER_RANGE)))
    target = total / ranges
    splitters = _quantiles(_sample(keyed, target / DRAWS_PER_RANGE, seed), ranges)
    for again in range(ROUNDS + 1):
        firsts, seconds = [m for m, _ in splitters], [t for _, t in splitters]
        ranged = keyed.withColumn("range", range_of(firsts, F.col("mark"), seconds, F.col("tie")))
        # At most MAX_RANGES rows and those that dividing adds.
        counts = {r: (b, n) for r, b, n in ranged.groupBy("range").agg(F.sum("size"), F.count("*")).collect()}
        over = {r: b for r, (b, n) in counts.items() if n > 1 and b > OVERFULL * target}
        if not over or again == ROUNDS:
            break
        found = _sample(ranged.filter(F.col("range").isin(list(over))), target / DRAWS_PER_RANGE, seed + again + 1)
        edges = [(LEAST, LEAST), *splitters, None]
        more = set()
        for r, b in over.items():
            low, high = edges[r], edges[r + 1]
            inside = [x for x in found if x >= low and (high is None or x < high)]
            more.update(_quantiles(inside, -(-b // int(target))))
            more.update(x for x in inside[:: DRAWS_PER_RANGE][1:] if len({m for m, _ in inside}) == 1)
        if more <= set(splitters):
            break
        splitters = sorted(set(splitters) | more)
    bytes_before, rows_before, b, n = [], [], 0, 0
    for r in range(len(splitters) + 1):
        bytes_before.append(b)
        rows_before.append(n)
        b, n = b + counts.get(r, (0, 0))[0], n + counts.get(r, (0, 0))[1]
    bases = spark.createDataFrame(list(zip(range(len(bytes_before)), bytes_before, rows_before)),
                                  "range int, bytes_before bigint, rows_before bigint")
    within = Window.partitionBy("range").orderBy("mark", "tie")
    piece = Window.partitionBy("range", "mark")
    placed = (ranged
              .withColumn("row", F.row_number().over(within))
              .withColumn("before", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
              .withColumn("start", F.min("before").over(piece)).withColumn("held", F.sum("size").over(piece))
              .join(F.broadcast(bases), "range"))
    # A key lies where its middle does.
    shard = F.expr(f"int(({shards} * (2 * (bytes_before + start) + held)) div {2 * total})")
    placed = write_shared(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"),
                                        (F.col("rows_before") + F.col("row") - 1).alias("at")), "placed")
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))  # a row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
