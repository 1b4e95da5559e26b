"""Near duplicates by ProbMinHash signatures of weighted word shingles, banding and exact verification.

Ertl, "ProbMinHash - a class of locality-sensitive hash algorithms for the (probability) Jaccard
similarity", IEEE TKDE 34 (2022).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusfold.llm.common import Scratch, join_ids
from corpusfold.session import write_shared

# Writes a working table under a name and reads it back.
Write = Callable[[DataFrame, str], DataFrame]

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
# Pairs of a bucket that are not yet linked are verified if their signatures agree in so many registers:
# four standard deviations below the wanted similarity.
AGREE = int(REGISTERS * (SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5))
# Members of one bucket compared in one task; larger buckets are compared by blocks of them.
BLOCK = 1024
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, each computed once; emptied when it grows."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) > 400_000:
            self.clear()
        self[word] = value
        return value


_WORDS = _Words()


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes, ascending, and how often each occurs.

    Words are runs without white space, in lower case. A text of fewer words is one shingle; an empty one has none.
    """
    found = np.fromiter(map(_WORDS.__getitem__, text.lower().split()), np.uint64)
    if not len(found):
        return found, np.zeros(0, np.int64)
    n = max(1, len(found) - words + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(words, len(found))):
        total = _mix(total + found[i:i + n] + np.uint64(_GOLD * (i + 1) & (1 << 64) - 1))
    return np.unique(total, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Per set of (hash, weight), the element that arrives first at each register.

    The arrivals of an element are a Poisson process whose rate is its weight, and each goes to a random register;
    both follow from the element's hash alone. An element ends once its next arrival is later than
    all registers of its set: the early termination of the method. All sets go through together.
    """
    sizes = np.array([len(h) for h, _ in sets])
    out = np.zeros(len(sets) * registers, np.uint64)
    if not sizes.sum():
        return out.reshape(len(sets), registers)
    element = np.concatenate([h for h, _ in sets])
    rate = np.concatenate([w for _, w in sets]).astype(np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    first = np.full(len(sets) * registers, np.inf)
    time, turn = np.zeros(len(element)), 0
    while len(element):
        turn += 1
        die = _mix(element + np.uint64(_GOLD * turn & (1 << 64) - 1))
        time = time - np.log1p(-((die >> np.uint64(11)) * 2.0 ** -53)) / rate
        at = owner * registers + (_mix(die + np.uint64(1)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        out[at[won]] = element[won]
        latest = first.reshape(len(sets), registers).max(1)
        goes_on = time < latest[owner]
        element, rate, owner, time = element[goes_on], rate[goes_on], owner[goes_on], time[goes_on]
    return out.reshape(len(sets), registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact, in n log n: the sum over common elements of 1 / sum over all of max(x_j / x_i, y_j / y_i)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][ia].astype(np.float64), b[1][ib].astype(np.float64)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # Elements of b alone have ratio 0, those of a alone are above all others.
    y_below = np.cumsum(y) - y + (b[1].sum() - y.sum())
    x_above = np.cumsum(x[::-1])[::-1] + (a[1].sum() - x.sum())
    return float((1 / (x_above / x + y_below / y)).sum())


def _sketches(docs: DataFrame) -> DataFrame:
    """``id, digest, signature, keys`` from ``id, text``: a hash of the words, the signature, a key per band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for stop in _slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                start = stop
                texts = [t.as_py() or "" for t in part.column(1)]
                found = signatures([shingles(t) for t in texts])
                keys = np.zeros((len(texts), BANDS), np.uint64)
                for i in range(ROWS):
                    keys = _mix(keys + found[:, i::ROWS] + np.uint64(i + 1))
                keys = _mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_GOLD)).view(np.int64)
                digests = [xxhash.xxh3_128_digest(" ".join(t.lower().split()).encode("utf-8", "surrogatepass")) for t in texts]
                # 16 bits of an element tell registers apart well enough for the estimate.
                small = found.astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in small], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * BANDS + 1, BANDS), pa.int32()), pa.array(keys.ravel()))],
                    names=["id", "digest", "signature", "keys"])

    return docs.mapInArrow(run, "id bigint, digest binary, signature binary, keys array<bigint>")


def _slices(texts: pa.Array, size: int = 1_000_000) -> Iterator[int]:
    """Ends of runs of about ``size`` bytes of text."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(texts):
        before = lengths[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(lengths, before + size)))
        yield min(at, len(texts))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose texts are at least that similar; ``texts`` has those of candidates only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            kept = []
            ids = batch.column(0).to_pylist()
            for i, a in enumerate(ids):
                if a != last:  # rows of one a follow each other after the join
                    last, left = a, shingles(batch.column(2)[i].as_py() or "")
                kept.append(probability_jaccard(left, shingles(batch.column(3)[i].as_py() or "")) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, write: Write = write_shared) -> DataFrame:
    """``id, least``: the smallest id that each linked id is connected to.

    Each round every id takes the least label of its neighbours, and then the label of its label.
    Rounds are written to shared storage, and nothing but a count comes to the driver.
    """
    both = write(links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")),
                                                       F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"))
                        .select("e.*").distinct(), "edges")
    labels = write(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("least")), "labels")
    while True:
        heard = (both.join(labels.select(F.col("id").alias("other"), "least"), "other")
                 .groupBy("id").agg(F.min("least").alias("heard")))
        nearer = labels.join(heard, "id").select("id", F.col("least").alias("was"), F.least("least", "heard").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("least").alias("far"))
        labels_new = write(nearer.join(jump, "near", "left").select(
            "id", F.least("near", F.coalesce("far", "near")).alias("least"), "was"), "labels")
        labels = labels_new.select("id", "least")
        if not labels_new.filter("least <> was").limit(1).count():
            return labels


def _find(roots: dict[int, int], x: int) -> int:
    while (up := roots.setdefault(x, x)) != x:
        roots[x] = roots[up]
        x = roots[x]
    return x


def _links_left(members: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` between members of one bucket that have different labels.

    ``members``: ``key, id, label, signature, text, blocks``. Pairs whose signatures agree well are verified, those that
    agree best first, and a pair is left out once its two labels are linked. A bucket of more than ``BLOCK``
    members is dealt into blocks, and each pair of blocks is compared by a task.
    """
    def compare(group: pa.Table) -> pa.Table:
        ids, labels = group["id"].to_numpy(), group["label"].to_numpy()
        marks = np.frombuffer(b"".join(group["signature"].to_pylist()), "<u2").reshape(len(ids), REGISTERS)
        block, low, high = group["block"].to_numpy(), group["low"][0].as_py(), group["high"][0].as_py()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        found = [np.zeros((3, 0), np.int64)]
        for i in left:
            agree = (marks[right] == marks[i]).sum(1)
            near = (agree >= AGREE) & (labels[right] != labels[i]) & ((low < high) | (ids[right] > ids[i]))
            found.append(np.stack([-agree[near], np.full(near.sum(), i), right[near]]))
        pairs = np.concatenate(found, 1)
        pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
        texts, sets, roots = group["text"], {}, {}

        def of(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in sets:
                sets[i] = shingles(texts[i].as_py() or "")
            return sets[i]

        links: list[tuple[int, int]] = []
        for _, i, j in pairs.T.tolist():
            u, v = _find(roots, int(labels[i])), _find(roots, int(labels[j]))
            if u != v and probability_jaccard(of(i), of(j)) >= similarity:
                roots[u] = v
                links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    lower = F.transform(F.sequence(F.lit(0), F.col("block")), lambda x: F.struct(x.alias("low"), F.col("block").alias("high")))
    upper = F.transform(F.sequence(F.col("block"), (F.col("blocks") - 1).cast("int")),
                        lambda x: F.struct(F.col("block").alias("low"), x.alias("high")))
    return (members.withColumn("block", own).withColumn("task", F.explode(F.array_distinct(F.concat(lower, upper))))
            .select("key", "id", "label", "signature", "text", "block", "task.low", "task.high")
            .groupBy("key", "low", "high").applyInArrow(compare, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size, kept`` for every row.

    Texts are linked whose probability Jaccard similarity of five-word shingles, weighted by how often they occur, is
    at least ``similarity``; a class is all that is linked, named by its smallest id. Texts with the
    same words in the same order are one class without comparison. Candidates are the pairs that
    share a band of the signature (at the similarity itself 999 in 1000 do). A row is a document of its own, whether or not
    others have its id or it has none (null): of each class the row with the smallest id is kept, one row only. Null
    texts are empty; empty texts are one class. An empty table gives no rows.

    No bucket is expanded into all its pairs: first each member is compared with the least of its bucket, then,
    in buckets that are still not of one class, members of different classes whose signatures agree, until they are linked.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = scratch.write(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"),
                                     F.col(text_col).alias("text")), "rows", "zstd")
    return _placed(keyed, similarity, scratch).select("doc_id", "class_id", "class_size", "kept")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps: one of each class, with all their columns."""
    keyed = write_shared(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = _placed(keyed.select(F.col("_row").alias("row"), F.col(id_col).cast("bigint").alias("doc_id"),
                                 F.col(text_col).alias("text")), similarity, Scratch(docs.sparkSession))
    gone = write_shared(found.filter("NOT kept").select(F.col("row").alias("_row")), "gone")
    return join_ids(keyed, gone, "_row", "left_anti").select(*docs.columns)


def _placed(keyed: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """``row, doc_id, class_id, class_size, kept`` of a written table ``row, doc_id, text``; ``scratch`` is removed."""
    classes = near_classes(keyed.select(F.col("row").alias("id"), "text"), similarity, scratch.write)
    placed = write_shared(keyed.select("row", "doc_id").join(classes.select(F.col("id").alias("row"), "class"), "row"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    # Written, so that in the join a class with most rows is no part of an aggregation and can be split.
    sizes = write_shared(placed.groupBy("class").agg(F.count("*").alias("class_size"), first.alias("first")), "sizes")
    scratch.remove()
    return placed.join(sizes, "class").select("row", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size",
                                              (F.col("row") == F.col("first.row")).alias("kept"))


def near_classes(rows: DataFrame, similarity: float = SIMILARITY, write: Write = write_shared) -> DataFrame:
    """``id, class``: the class of each row, named by its least id. ``rows`` is a written table ``id, text`` with unique ids.

    Working tables, which the result reads, are written by ``write``.
    """
    sketched = write(_sketches(rows), "sketches")
    firsts = write(sketched.groupBy("digest").agg(F.min("id").alias("id")), "firsts")
    # One row per different text: of the copies, the one with the least id.
    different = write(sketched.join(firsts.select("digest", F.col("id").alias("first")), "digest")
                             .filter("id = first").select("id", "signature", "keys"), "different")
    banded = different.select(F.explode("keys").alias("key"), "id")
    # Totals of a key are written before they meet its rows again: a bucket with most rows can then be split.
    buckets = write(banded.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("held"))
                           .filter("held > 1"), "buckets")
    members = write(banded.join(buckets, "key"), "members")
    # The texts of all others are read and not shuffled.
    wanted = write(members.select("id").distinct(), "wanted")
    texts = write(join_ids(rows, wanted, "id", "left_semi", write=write), "texts")
    stars = write(members.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links = write(_verified(stars, texts, similarity), "links")
    labels = components(links, write)
    labelled = members.join(labels, "id", "left").withColumn("label", F.coalesce("least", "id")).drop("least")
    mixed = write(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                         .filter("lo <> hi").select("key"), "mixed")
    open_ = (labelled.join(mixed, "key").join(different.select("id", "signature"), "id").join(texts.select("id", "text"), "id")
             .withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")))
    more = write(_links_left(open_, similarity), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more), write)
    # Copies follow their first, firsts follow their class.
    first_class = firsts.join(labels, "id", "left").select("digest", F.coalesce("least", "id").alias("class"))
    return sketched.select("id", "digest").join(first_class, "digest").select("id", "class")
