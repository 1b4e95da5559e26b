"""Periodic runs of words: where a text goes round in circles, however long the round.

A run is a longest stretch in which words ``q`` apart are identical, with ``q`` its smallest period. Blocks of dyadic lengths are
matched with the words that follow them: the sum of squared differences at every distance comes from one convolution by a number
theoretic transform, in exact integers, and is zero where the block occurs again. Such distances are the seeds of runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.llm.common import text_slices

# A run has so many words, and so many rounds.
LEAST_WORDS, LEAST_ROUNDS = 24, 3
# The shortest blocks. A run of LEAST_WORDS holds an aligned block of BASE words and its next occurrence if its period is
# below 10, as does a run of LEAST_ROUNDS rounds if it is 8 or more; longer blocks serve periods from their length to twice that.
BASE = 8
# A prime under 2^32 with roots of unity for transforms of up to 2^30 points (fixed values).
PRIME, GENERATOR, POWER = 3 * 2**30 + 1, 5, 30
# Points transformed at once, and bytes of text worked on at once.
POINTS, SLICE_BYTES = 1 << 20, 4 << 20

RESULT = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_FAR = np.iinfo(np.int64).max


def _mod(values: np.ndarray) -> np.ndarray:
    # Division by a constant is vectorised, the remainder is not.
    return values - values // np.uint64(PRIME) * np.uint64(PRIME)


def _powers(order: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity."""
    root = pow(GENERATOR, (PRIME - 1) // order, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    found = np.ones(max(order // 2, 1), np.uint64)
    done = 1
    while done < order // 2:
        found[done:2 * done] = _mod(found[:done] * np.uint64(pow(root, done, PRIME)))
        done *= 2
    return found


def transform(rows: np.ndarray) -> np.ndarray:
    """The transform of each row (a power of two of values below PRIME), in bit-reversed order."""
    n, prime = rows.shape[1], np.uint64(PRIME)
    length = n
    while length > 1:
        half, parts = length // 2, rows.reshape(len(rows), -1, 2, length // 2)
        total, away = parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] + (prime - parts[:, :, 1])
        # Unsigned: what was below the prime wraps around and is the larger of the two.
        away = _mod(np.minimum(away, away - prime) * _powers(length, False))
        rows = np.stack([np.minimum(total, total - prime), away], axis=2).reshape(len(rows), n)
        length = half
    return rows


def inverse(rows: np.ndarray) -> np.ndarray:
    """The values of which ``transform`` gave the rows."""
    n, prime = rows.shape[1], np.uint64(PRIME)
    length = 2
    while length <= n:
        parts = rows.reshape(len(rows), -1, 2, length // 2)
        left, right = parts[:, :, 0], _mod(parts[:, :, 1] * _powers(length, True))
        total, away = left + right, left + (prime - right)
        rows = np.stack([np.minimum(total, total - prime), np.minimum(away, away - prime)], axis=2).reshape(len(rows), n)
        length *= 2
    return _mod(rows * np.uint64(pow(n, -1, PRIME)))


def block_matches(codes: np.ndarray, starts: np.ndarray, block: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """``(start, distance)`` of blocks that occur again, ``first`` to ``last`` words further on.

    The sum of squared differences of a block and a window is taken of codes folded to a range in which it stays below PRIME.
    The fold keeps equal words equal, so nothing is missed; what it adds is for the caller to compare word by word.
    """
    folded = codes % isqrt((PRIME - 1) // block)
    width = last - first + block
    points = 1 << (width - 1).bit_length()
    padded = np.concatenate([folded, np.zeros(last + block, np.int64)])
    squares = np.concatenate([[0], np.cumsum(padded * padded)])
    at, distance = [], []
    step = max(1, POINTS // points)
    for lot in range(0, len(starts), step):
        s = starts[lot:lot + step, None]
        blocks, windows = np.zeros((2, len(s), points), np.uint64)
        blocks[:, :block] = padded[s + np.arange(block - 1, -1, -1)]
        windows[:, :width] = padded[s + first + np.arange(width)]
        products = inverse(_mod(transform(blocks) * transform(windows)))[:, block - 1:width].astype(np.int64)
        there = s + first + np.arange(last - first + 1)
        differences = (squares[s + block] - squares[s]) + (squares[there + block] - squares[there]) - 2 * products
        row, d = np.nonzero(differences == 0)
        at.append(s[row, 0])
        distance.append(d + first)
    return (np.concatenate(at), np.concatenate(distance)) if at else (np.zeros(0, np.int64),) * 2


def _agree_right(codes: np.ndarray, at: int, distance: int) -> int:
    """The first place from ``at`` on whose word differs from the one ``distance`` further on."""
    step, end = 64, len(codes) - distance
    while at < end:
        stop = min(at + step, end)
        differ = codes[at:stop] != codes[at + distance:stop + distance]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = stop, step * 4
    return max(at, end)


def _agree_left(codes: np.ndarray, at: int, distance: int) -> int:
    """The least place from which on all words before ``at`` equal the ones ``distance`` further on."""
    step = 64
    while at > 0:
        stop = max(at - step, 0)
        differ = (codes[stop:at] != codes[stop + distance:at + distance])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - k
        at, step = stop, step * 4
    return 0


def find_runs(codes: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of all runs in a sequence of codes; ``text`` numbers the text of each word, ascending.

    Words of different texts must have different codes. Scales ascend, and the distances of a scale, so the smallest period of
    a stretch comes first; what has been found once is not looked at again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    following = np.full(n, _FAR)
    same = codes[order[1:]] == codes[order[:-1]]
    following[order[:-1][same]] = (order[1:] - order[:-1])[same]
    longest = int(np.bincount(text).max()) if n else 0
    # Up to where a run that covers a word reaches, of runs whose period is at most the length of a block.
    reach = np.zeros(n + 1, np.int64)
    runs: dict[tuple[int, int], int] = {}
    block = BASE
    while n and (LEAST_ROUNDS * block <= longest or block == BASE):
        first, last = (1 if block == BASE else block), 2 * block - 1
        starts = np.arange(0, n - block, block)
        # In a block that occurs again every word does; the others need no convolution.
        again = np.maximum.reduceat(following, starts) if len(starts) else following[:0]
        if len(starts):
            again[-1] = following[starts[-1]:starts[-1] + block].max()
        starts = starts[(again <= last) & (text[starts] == text[starts + block - 1])]
        # Inside a run, all occurrences are whole rounds away.
        starts = starts[reach[starts] < starts + last + block]
        at, distance = block_matches(codes, starts, block, first, last)
        open_ = reach[at] < at + distance + block
        at, distance = at[open_], distance[open_]
        later: list[tuple[int, int]] = []
        done, until = 0, 0
        for k in np.lexsort((at, distance)).tolist():
            s, d = int(at[k]), int(distance[k])
            if d != done:
                done, until = d, 0
            if s + d + block <= until or reach[s] >= s + d + block:
                continue
            right = _agree_right(codes, s, d)
            if right < s + block:
                continue
            start, until = _agree_left(codes, s, d), right + d
            if until - start < max(LEAST_WORDS, LEAST_ROUNDS * d) or (start, until) in runs:
                continue
            runs[start, until] = d
            if d <= block:
                reach[start:until] = np.maximum(reach[start:until], until)
            else:
                later.append((start, until))
        for start, until in later:
            reach[start:until] = np.maximum(reach[start:until], until)
        block *= 2
    return sorted((start, end, period) for (start, end), period in runs.items())


def runs_of_texts(texts: Sequence[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Per text: words, runs as ``(start, length, period)`` by start and period, and the text without repeated rounds."""
    words = [t.split() for t in texts]  # at space, tab, line ends, vertical tab and form feed
    counts = np.fromiter(map(len, words), np.int64, len(words))
    n = int(counts.sum())
    coded = pa.array(chain.from_iterable(words), pa.large_binary(), size=n).dictionary_encode()
    text = np.repeat(np.arange(len(words)), counts)
    codes = text * max(len(coded.dictionary), 1) + coded.indices.to_numpy().astype(np.int64)
    found: dict[int, list[tuple[int, int, int]]] = {}
    firsts = (np.cumsum(counts) - counts).tolist()
    for start, end, period in find_runs(codes, text):
        i = int(text[start])
        found.setdefault(i, []).append((start - firsts[i], end - start, period))
    for i, own in enumerate(words):
        runs = sorted(found.get(i, []), key=lambda r: (r[0], r[2]))
        if runs:
            edges = np.zeros(len(own) + 1, np.int64)
            for start, length, period in runs:
                edges[start + period] += 1
                edges[start + length] -= 1
            own = [own[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
        yield int(counts[i]), runs, b" ".join(own)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: one row per row of ``docs``, nothing is shuffled.

    ``runs`` are ``start, length, period`` in words, by start and then period. ``collapsed`` is the text, one blank between
    words, without the words that some run holds after its first round. A null text has no words and an empty result; null ids
    stay null; repeated rows are rows of their own; an empty table gives an empty result.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for at, texts in text_slices(batch.column(1), SLICE_BYTES):
                counts, runs, collapsed = zip(*runs_of_texts(texts))
                spans = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(spans, kinds),
                     pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(search, RESULT)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length over period; of equals the one that starts first, then the shortest period."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
