"""Periodic runs against a brute-force version, and the transform against plain convolution."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusfold.llm import periodic_runs as periodic
from corpusfold.llm.queries import _with_rounds, op13_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, runs int, collapsed string, n_words string"


def brute_force(words):
    found = set()
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q) and not any((s, e) == (i, j + q) for s, e, _ in found):
                found.add((i, j + q, q))
            i = j + 1
    runs = sorted((s, e - s, q) for s, e, q in found)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return runs, [w for k, w in enumerate(words) if k not in gone]


def sequences():
    rng, made = random.Random(2), []
    for size in (0, 1, 5, 23, 24, 25, 60, 100, 200, 333, 1000):
        for letters in (1, 2, 3, 50):
            made.append([rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[:letters]) for _ in range(size)])
    for period in (1, 2, 3, 7, 8, 9, 10, 15, 16, 17, 31, 32, 33, 64, 100, 129):
        for length in (max(24, 3 * period) - 1, max(24, 3 * period), 4 * period + 21):
            unit = [f"w{rng.randrange(1 + period // 2)}" for _ in range(period)]
            made.append([f"x{k}" for k in range(rng.randrange(40))] + (unit * (length // period + 1))[:length]
                        + [f"y{k}" for k in range(rng.randrange(40))])
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    made += [list(fib[-1]), list("aab" * 9 + "aab" * 9 + "b" + "aab" * 8), list("abab" * 6 + "ababa" * 8)]
    made.append((["p", "q"] * 14 + ["r"]) * 5)
    return made


def test_runs_agree_with_brute_force():
    texts = sequences()
    found = list(periodic.runs_of_texts([" ".join(t).encode() for t in texts]))
    assert sum(len(runs) for _, runs, _ in found) > 60
    for words, (n, runs, collapsed) in zip(texts, found):
        wanted, kept = brute_force(words)
        assert n == len(words) and runs == wanted and collapsed.decode() == " ".join(kept)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=12), st.integers(1, 30)), max_size=12))
def test_any_repetition_is_found(parts):
    words = [c for unit, times in parts for c in unit * times]
    (_, runs, collapsed), = periodic.runs_of_texts([" ".join(words).encode()])
    assert (runs, collapsed.decode().split()) == brute_force(words)


def test_transform_is_exact():
    rng = np.random.default_rng(3)
    for n in (1, 2, 8, 64):
        a, b = rng.integers(0, periodic.PRIME, (2, 3, n), dtype=np.uint64)
        assert (periodic.inverse(periodic.transform(a)) == a).all()
        product = periodic.inverse(periodic._mod(periodic.transform(a) * periodic.transform(b)))
        for x, y, z in zip(a.tolist(), b.tolist(), product.tolist()):
            assert z == [sum(x[i] * y[(k - i) % n] for i in range(n)) % periodic.PRIME for k in range(n)]


def test_block_matches_are_the_zero_mismatches(monkeypatch):
    monkeypatch.setattr(periodic, "POINTS", 64)
    codes = np.random.default_rng(4).integers(0, 2, 400)
    starts = np.arange(0, 380, 8)
    at, distance = periodic.block_matches(codes, starts, 8, 1, 15)
    wanted = {(s, d) for s in starts.tolist() for d in range(1, 16) if s + d + 8 <= 400 and (codes[s:s + 8] == codes[s + d:s + d + 8]).all()}
    assert {(s, d) for s, d in zip(at.tolist(), distance.tolist()) if s + d + 8 <= 400} == wanted


def test_every_row_has_a_result(spark, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE_BYTES", 3000)
    rows = [(1, None), (2, ""), (3, " \n\x0b "), (4, "a b " * 30), (4, "a b " * 30), (4, "other text"), (None, "z " * 24),
            (6, " ".join(f"w{i % 777}" for i in range(30000))), (7, "é\x85é 　 " * 40), (8, "x" * 200000)]
    found = periodic.periodic_runs(spark.createDataFrame([(i, t, 1, "c", "n") for i, t in rows], SCHEMA)).collect()
    wanted = []
    for i, t in rows:
        words = WORD.findall(t or "")
        if i == 6:
            runs, kept = [(0, 30000, 777)], words[:777]
        else:
            runs, kept = brute_force(words)
        wanted.append((i, len(words), runs, " ".join(kept)))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found] == wanted
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in op13_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc in docs:
        words, h = WORD.findall(doc.text or ""), zlib.crc32(str(doc.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, kept = brute_force(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        r = found[doc.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if not runs else 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in runs)) and r.collapsed_sha256 == sha(" ".join(kept))


def test_texts_without_words_do_not_go_round(spark):
    rows = [(i, None if i % 3 == 0 else " \n" * (i % 3 - 1)) for i in range(60)] + [(None, "a b c")]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(60))
    assert [tuple(r) for r in _with_rounds(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()] == rows
