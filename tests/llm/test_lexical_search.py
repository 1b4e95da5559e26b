"""Ranked search against a brute-force version; bounds of the trees against the scores below them."""

import math
import random
import re
from collections import Counter

import numpy as np

from corpusfold.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, item_id bigint, rank string, terms int, score int"
ITEMS = "item_id bigint, text string, doc_id string, rank int"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        found += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scored)[:top], 1)]
    return Counter(found)


def tables():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeéÑX9") for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    pick = lambda k: " ".join(rng.choice(words[:rng.choice((10, 300))]) + rng.choice(["", ".", "_", "\x1c"]) for _ in range(k))
    docs = [(i, pick(rng.randrange(1, 60))) for i in range(400)]
    docs += [(500 + i, docs[7][1]) for i in range(90)] + [(None, docs[7][1]), (3, docs[3][1]), (3, "other words " + docs[5][1]),
             (600, None), (601, ""), (602, "-_- \n"), (603, pick(20000)), (604, "q" * 100000), (None, pick(40))]
    items = [(i, pick(rng.randrange(1, 25))) for i in range(12)]
    items += [(1, docs[7][1]), (90, None), (91, ""), (92, "!?"), (None, docs[9][1]), (93, "nosuchterm"), (94, "Q" * 100000), (95, "a a A a")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1, "r", 2, 3) for i, t in docs], DOCS).repartition(5),
            spark.createDataFrame([(i, t, "d", 1) for i, t in items], ITEMS))


def found(df):
    return Counter(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


def test_ranks_agree_with_brute_force(spark, monkeypatch):
    docs, items = tables()
    assert found(search.rank(*frames(spark, docs, items))) == brute_force(docs, items, 50)
    # Many slices, trees and lots of tasks; ties at the end of the list.
    for name, value in {"SLICE_ITEMS": 3, "SLICE_TERMS": 40, "VOCABULARY": 100, "SLICE_BYTES": 2000, "MERGED": 2}.items():
        monkeypatch.setattr(search, name, value)
    assert found(search.rank(*frames(spark, docs, items), top=5)) == brute_force(docs, items, 5)


def test_empty_tables(spark):
    docs, items = tables()
    for d, i in (([], items), (docs, []), ([(1, None)], items), (docs, [(1, "")])):
        assert search.rank(*frames(spark, d, i)).count() == 0


def vectors(rng, docs, width):
    rows = [np.sort(rng.choice(width, rng.integers(1, 12), replace=False)) for _ in range(docs)]
    return search.Vectors(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows),
                          rng.integers(1, 10**6, sum(map(len, rows))))


def test_bounds_hold_and_prune(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(search, "LEAF_DOCS", 4)
    width, docs = 120, 300
    own = vectors(rng, docs, width)
    weights = rng.integers(0, 9000, width)
    tree = search.Tree(own, np.sqrt(np.maximum(weights, 1)), np.arange(width) * 16 // width)
    dense_docs = np.zeros((docs, width), np.int64)
    dense_docs[own.row_numbers(), own.terms] = own.impacts
    visited, scored = 0, search.np.add.reduceat
    for _ in range(40):
        terms_ = rng.choice(width, 9, replace=False)
        q = np.zeros(width, np.int64)
        q[terms_] = weights[terms_]
        exact = dense_docs @ q
        query = weights[terms_] / tree.scale[terms_]
        norms = np.sqrt(np.bincount(tree.group[terms_], query * query, tree.groups))
        bounds = (query @ tree.centres[terms_] + tree.radii @ norms) * (1 + search.SLACK)
        assert all(bounds[k] >= exact[rows].max() for k, rows in enumerate(tree.rows))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        scores, ids = tree.search(terms_, weights[terms_], q.astype(np.int32), np.arange(docs), none, 10)
        order = [i for i in np.lexsort((np.arange(docs), -exact))[:10] if exact[i] > 0]
        assert ids.tolist() == order and scores.tolist() == exact[order].tolist()
        visited += sum(bounds[k] >= scores[-1] for k in tree.leaves)
    assert visited < 0.8 * 40 * len(tree.leaves) and sorted(np.concatenate([tree.rows[k] for k in tree.leaves])) == list(range(docs))


def test_copies_are_pruned_at_once(monkeypatch):
    """A group of copies of any size is a ball without a radius: no leaf of it is read when it cannot rank."""
    width = 20
    terms_, impacts = np.tile(np.arange(10), 500), np.tile(np.full(10, 7), 500)
    tree = search.Tree(search.Vectors(np.arange(0, 5001, 10), terms_, impacts), np.ones(width), np.arange(width) // 4)
    assert tree.radii.max() <= 1e-3
    read = []
    monkeypatch.setattr(tree, "leaves", {k: read.append(k) or v for k, v in tree.leaves.items()})
    q = np.zeros(width, np.int32)
    q[3] = 5
    best = (np.full(50, 10**6), np.arange(50))
    assert tree.search(np.array([3]), np.array([5]), q, np.arange(500), best, 50)[0].min() == 10**6
