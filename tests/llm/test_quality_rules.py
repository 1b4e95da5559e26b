"""Quality rules against a brute-force version of counts, sketches and limits."""

import random
import re
from collections import Counter

import pytest

from corpusfold.llm import quality_rules as rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_words bigint, rule string, cell int, kept string, docs int"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            len(lines) - len(set(lines)), len(again))


def brute_force(docs):
    """``doc_id, counts, base_failed, kept`` of rows ``doc_id, text, lang, source``."""
    def values(c):
        return {name: c[rules.COUNTS.index(a)] * 10**6 // max(c[rules.COUNTS.index(b)], 1) for name, a, b, _, _ in rules.RULES}

    def cell(v):
        shift = max(v.bit_length() - 8, 0)
        return ((v >> shift) + 1 << shift) - 1

    found = [(i, counts(t), lang, source) for i, t, lang, source in docs]
    fails = [c[0] < 50 or 100 * c[5] > 50 * c[0] for _, c, _, _ in found]
    groups = {}
    for (_, c, lang, source), bad in zip(found, fails):
        if not bad:
            for key in ((lang, source), (lang,), ()):
                groups.setdefault(key, []).append({n: cell(v) for n, v in values(c).items()})

    def inside(c, lang, source):
        key = next(k for k in ((lang, source), (lang,), ()) if len(groups[k]) >= rules.LEAST_DOCS or not k)
        for name, _, _, two_sided, least in rules.RULES:
            ranked = sorted(g[name] for g in groups[key])
            q1, q3 = ranked[-(-len(ranked) // 4) - 1], ranked[-(-3 * len(ranked) // 4) - 1]
            reach = 3 * max(q3 - q1, least)
            if not (q1 - reach if two_sided else 0) <= values(c)[name] <= q3 + reach:
                return False
        return True

    return Counter((i, *c[:3], *c[4:], bad, not bad and inside(c, lang, source))
                   for (i, c, lang, source), bad in zip(found, fails))


@pytest.fixture(scope="module")
def docs():
    rng, made = random.Random(8), []
    for i in range(420):
        words = ["".join(rng.choice("abcdeéñ#") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
        text = "".join(rng.choice(words) + rng.choice(["  ", " ", "\n", "\t", "\x0b", " \x85 "]) for _ in range(rng.randrange(30, 300)))
        if i % 17 == 0:
            text = re.sub("a", "###", text)
        if i % 19 == 0:
            text = "the same line\n" * 9 + text
        lang, source = ("en", f"s{i % 2}") if i % 3 else (None if i % 2 else "de", f"s{i % 7}")
        made.append((i, text, lang, source))
    return made + [(900, None, "en", "s1"), (901, "", None, None), (902, " \n \x0c", "en", None), (903, "a b c " * 40, "en", "s1"),
                   (904, "x" * 300000, "en", "s0"), (905, "word#  " + "y z " * 20000, "de", "s1"), (None, made[1][1], "en", "s1"),
                   (1, made[1][1], "en", "s1"), (1, made[1][1], "en", "s1")]


def rows(spark, docs):
    return spark.createDataFrame([(i, t, lang, s, 7, "r", 1, "k", 2) for i, t, lang, s in docs], SCHEMA)


def verdicts(df):
    return Counter(tuple(r) for r in df.select("doc_id", *[c for c in rules.COUNTS if c != "n_lines"], "base_failed", "kept").collect())


def test_rules_agree_with_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(rules, "SLICE_BYTES", 5000)
    wanted = brute_force(docs)
    assert {v[-1] for v in wanted} == {True, False} and any(not v[-2] and not v[-1] for v in wanted)
    assert verdicts(rules.quality(rows(spark, docs))) == wanted
    whole = rules.apply_rules(rows(spark, docs).repartition(5))
    assert verdicts(whole) == wanted and {"text", "rule", "cell", "docs"} <= set(whole.columns)


def test_empty_and_failing_tables(spark):
    assert rules.quality(rows(spark, [])).count() == 0
    found = rules.quality(rows(spark, [(1, "short", "en", "s"), (2, None, None, None)])).collect()
    assert [(r.base_failed, r.kept) for r in found] == [(True, False)] * 2


def test_sketches_merge(spark, docs):
    measured = rules.measure(rows(spark, docs))
    whole, parts = rules.sketch(measured), None
    for lot in (measured.filter("doc_id % 3 = 0"), measured.filter("doc_id % 3 <> 0 OR doc_id IS NULL")):
        parts = rules.sketch(lot) if parts is None else parts.unionByName(rules.sketch(lot))
    assert Counter(map(tuple, rules.merge(parts, rules.GROUP).collect())) == Counter(map(tuple, whole.collect()))
