"""Toxic documents by a weighted grammar of clauses: insults and threats, at whom, negated or reported.

Small transducers are composed. A lexicon reads the letters of a word and puts out its weight and marks. Over the marks of
a text run two more, each composed of simple ones: left to right for targets, negations and reports in front of a
word, right to left for targets and reports behind it and for the kind of match. The weights come from labelled documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.session import write_shared

# Bound of the training sample: so many labelled rows, drawn by a hash of their ids.
TRAIN_ROWS = 200_000
# Bound of the model.
MAX_STEMS = 20_000
STEM_LENGTHS = range(4, 9)
LEAST_ROWS = 4
LEAST_WORDS = 3
LEAST_WEIGHT = math.log(8)
FOLDS = 5

# Seed words of the grammar; what is learned from labels outweighs them.
INSULTS = """idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb imbecile bastard
trottel arschloch versager abschaum estúpido imbécil basura imbécile crétin connard ordure""".split()
THREATS = "kill murder destroy hurt burn shoot stab töten umbringen matar golpear tuer frapper".split()
TARGETS = """you your he she they them him her these those people du dich dein ihr euch sie tú usted vosotros ellos
tu toi vous ton votre ils elles""".split()
NEGATIONS = "not never no n't isn't aren't don't nicht kein keine nie no nunca jamás ne pas jamais aucun".split()
REPORTS = """said says say wrote writes called calls claimed claims quoted reported sagte sagt schrieb dijo dice
escribió dit disait écrit""".split()

# How far, in words of one clause, a target or a negation reaches.
REACH = {"G": 4, "N": 3}
KINDS = ("plain", "targeted", "negated", "reported")
# What a match of each kind counts before anything is learned, and how firmly.
KIND_PRIOR = {"plain": 0.7, "targeted": 0.9, "negated": 0.2, "reported": 0.3}
PRIOR_STRENGTH = 4.0
PRIOR_BIAS = -2.0
SEED_WEIGHT = 3.0

ENDS = ".!?;:\n"
# What a word is, for learning and for matching: letters with their marks. The short forms do the same for ASCII, faster.
_WORD, _TOKEN = (regex.compile(form.replace("L", r"\p{L}[\p{L}\p{M}]*")) for form in ("L", rf"L(?:'L)?|[{ENDS}]"))
_WORD_ASCII, _TOKEN_ASCII = (re.compile(form.replace("L", "[a-z]+")) for form in ("L", rf"L(?:'L)?|[{ENDS}]"))

# Marks of a word: what it is, then what is near it. END stands between clauses.
MATCH, THREAT, TARGET, NEGATION, REPORT, AIMED, DENIED, TOLD, END = (1 << i for i in range(9))


def folded(text: str | None) -> str:
    """In lower case, letters and their marks as one character where there is one."""
    low = (text or "").lower()
    return low if low.isascii() else unicodedata.normalize("NFC", low).replace("’", "'")


def words_of(low: str) -> set[str]:
    return set((_WORD_ASCII if low.isascii() else _WORD).findall(low))


class Transducer:
    """A sequential transducer: from a state and a symbol to the next state and what is put out instead."""

    def __init__(self, step: Callable[[Hashable, int], tuple[Hashable, object]], start: Hashable = 0):
        self.step, self.start = step, start
        # States are few; their arcs are kept when first taken.
        self.arcs: dict[tuple[Hashable, int], tuple[Hashable, object]] = {}

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one puts out."""
        def step(states, symbol):
            first, between = self.step(states[0], symbol)
            second, out = other.step(states[1], between)
            return (first, second), out

        return Transducer(step, (self.start, other.start))

    def run(self, symbols: Iterable[int]) -> list:
        state, out = self.start, []
        for symbol in symbols:
            arc = self.arcs.get((state, symbol))
            if arc is None:
                arc = self.arcs[state, symbol] = self.step(state, symbol)
            state = arc[0]
            out.append(arc[1])
        return out


def near(mark: int, gives: int, reach: int | None, itself: bool) -> Transducer:
    """Adds ``gives`` to the words of a clause up to ``reach`` (None: any number) behind one with ``mark``, or on it."""
    def step(left, symbol):
        if symbol == END:
            return 0, END
        here = bool(symbol & mark)
        out = symbol | gives if left or (itself and here) else symbol
        return (reach or 1) if here else left if reach is None else max(0, left - 1), out

    return Transducer(step)


def judge(state, symbol: int) -> tuple[int, str | None]:
    """The kind of a match; none for other words and for threats at nobody."""
    if symbol == END or not symbol & MATCH or (symbol & THREAT and not symbol & AIMED):
        return state, None
    return state, "reported" if symbol & TOLD else "negated" if symbol & DENIED else "targeted" if symbol & AIMED else "plain"


class Lexicon:
    """Reads letters: the weight of a whole word, or else of its longest stem; 0: neither."""

    def __init__(self, stems: dict[str, float], words: dict[str, float]):
        self.arcs: list[dict[str, int]] = [{}]
        self.stem, self.whole = [0.0], [0.0]
        for entries, weights in ((stems, self.stem), (words, self.whole)):
            for entry, weight in entries.items():
                state = 0
                for letter in entry:
                    after = self.arcs[state].get(letter)
                    if after is None:
                        after = self.arcs[state][letter] = len(self.arcs)
                        self.arcs.append({})
                        self.stem.append(0.0)
                        self.whole.append(0.0)
                    state = after
                weights[state] = weight

    def read(self, word: str) -> float:
        state, best = 0, 0.0
        for letter in word:
            state = self.arcs[state].get(letter)
            if state is None:
                return best
            best = self.stem[state] or best
        return self.whole[state] or best


class Grammar:
    """The composed transducers with their weights; small, and sent to every task."""

    def __init__(self, stems: dict[str, float], words: dict[str, float], bias: float, kinds: dict[str, float]):
        self.lexicon, self.bias, self.kinds = Lexicon(stems, words), bias, kinds
        self.marks: dict[str, int] = {}
        for mark, group in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for word in group:
                self.marks[word] = self.marks.get(word, 0) | mark
        self.forward = near(TARGET, AIMED, REACH["G"], True).then(near(NEGATION, DENIED, REACH["N"], False)).then(
            near(REPORT, TOLD, None, True))
        self.backward = near(TARGET, AIMED, REACH["G"], True).then(near(REPORT, TOLD, None, True)).then(Transducer(judge))
        self.seen: dict[str, tuple[int, float]] = {}

    def entry(self, token: str) -> tuple[int, float]:
        """Marks and weight of a word, or the strongest of the parts around its apostrophe."""
        found = self.seen.get(token)
        if found is None:
            parts = {token, *token.split("'")} if "'" in token else (token,)
            weight, marks = max(map(self.lexicon.read, parts)), NEGATION if token.endswith("n't") else 0
            for part in parts:
                marks |= self.marks.get(part, 0)
            found = (marks | MATCH if weight else marks, weight)
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[token] = found
        return found

    def events(self, text: str | None) -> list[tuple[str, float]]:
        """The strongest match of each clause that has one."""
        low = folded(text)
        # Most texts have no word that could match: one look at each different word decides.
        if not any(self.entry(word)[1] for word in words_of(low)):
            return []
        tokens = (_TOKEN_ASCII if low.isascii() else _TOKEN).findall(low)
        entries = [(END, 0.0) if token in ENDS else self.entry(token) for token in tokens]
        marked = self.forward.run(marks for marks, _ in entries)
        kinds = self.backward.run(reversed(marked))[::-1]
        out, best = [], None
        for (marks, weight), kind in zip(entries, kinds):
            if kind and (best is None or self.kinds[kind] * weight > self.kinds[best[0]] * best[1]):
                best = (kind, weight)
            if marks == END and best:
                out.append(best)
                best = None
        return [*out, best] if best else out

    def features(self, text: str | None) -> list[float]:
        """The weight matched in each kind."""
        found = self.events(text)
        return [sum(weight for kind, weight in found if kind == k) for k in KINDS]

    def score(self, text: str | None) -> float:
        logit = self.bias + sum(self.kinds[kind] * weight for kind, weight in self.events(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 5, id_col: str = "doc_id",
          text_col: str = "text") -> Grammar:
    """The grammar's weights from labelled rows outside the held-out fold, ``train_rows`` of them at most or so.

    Words and stems weigh the log-odds of being in a toxic rather than a clean document, if that is beyond
    what chance explains among so many candidates. How much each kind of match counts is fitted to the labels
    by logistic regression. Without labels the seed words and kinds have their fixed weights.
    """
    marks = (labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_toxic")))
    known = marks.count()
    chance = min(1.0, train_rows / max(known, 1))
    marks = marks.filter(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) < int(chance * (1 << 30)))
    # About train_rows rows of twelve bytes: bounded by the parameter.
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(F.broadcast(marks), "_id").select("_text", "_toxic")

    @F.pandas_udf("array<string>")
    def words(texts):
        return texts.map(lambda t: sorted(words_of(folded(t))))

    toxic = F.sum("toxic").alias("a")
    counts = write_shared(
        rows.select(F.col("_toxic").cast("bigint").alias("toxic"), F.explode(F.array_append(words("_text"), "")).alias("word"))
        .groupBy("word").agg(toxic, (F.count("*") - F.sum("toxic")).alias("b")), "word-counts")
    n = counts.filter("word = ''").first()
    a_rows, b_rows = (n["a"], n["b"]) if n else (0, 0)
    counts = counts.filter("word <> ''")
    # Words seen often enough speak for themselves; stems are what several rarer words have in common.
    stems = F.transform(F.array(*map(F.lit, STEM_LENGTHS)), lambda k: F.when(
        F.char_length("word") >= k, F.concat(F.substring(F.col("word"), F.lit(1), k), F.lit("*"))))
    rare = counts.filter(F.col("a") < LEAST_ROWS).select(F.explode(F.array_compact(stems)).alias("stem"), "a", "b")
    common = rare.groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("words"))
    candidates = (common.filter(F.col("words") >= LEAST_WORDS).drop("words")
                  .unionByName(counts.withColumnRenamed("word", "stem")).filter(F.col("a") >= LEAST_ROWS))
    weight = F.log((F.col("a") + 0.5) / (a_rows + 1)) - F.log((F.col("b") + 0.5) / (b_rows + 1))
    share = a_rows / max(a_rows + b_rows, 1) or 0.5

    def term(count: str, chance_: float) -> Column:
        seen = F.col(count).cast("double")
        return F.when(seen > 0, seen * F.log(seen / ((F.col("a") + F.col("b")) * chance_))).otherwise(0.0)

    surprise = 2 * (term("a", share) + term("b", max(1 - share, 1e-9)))
    scored = write_shared(candidates.select("stem", "a", "b", weight.alias("weight"), surprise.alias("surprise")), "stems")
    limit = 2 * math.log(max(scored.count(), 2)) + 4
    chosen = (scored.filter((F.col("weight") >= LEAST_WEIGHT) & (F.col("surprise") >= limit))
              .orderBy(F.desc("surprise"), "stem").limit(MAX_STEMS).collect())
    by_word = {r["stem"]: r["weight"] for r in chosen if not r["stem"].endswith("*")}
    by_stem = {r["stem"][:-1]: r["weight"] for r in chosen if r["stem"].endswith("*")}
    seeds = INSULTS + THREATS
    found = {r["word"]: (r["a"], r["b"]) for r in counts.filter(F.col("word").isin(seeds)).collect()}
    for word in seeds:
        a, b = found.get(word, (0, 0))
        # Half a row of clean documents, and of toxic ones what gives the seed weight.
        more = 0.5 * math.exp(SEED_WEIGHT) * (a_rows + 1) / (b_rows + 1)
        by_word[word] = max(0.0, math.log((a + more) / (a_rows + 1)) - math.log((b + 0.5) / (b_rows + 1)))
    grammar = Grammar(by_stem, by_word, 0.0, dict(KIND_PRIOR))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = [[round(x, 1) for x in grammar.features(t.as_py())] for t in batch.column(0)]
            columns = [pa.array([r[i] for r in rows_], pa.float64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=[*KINDS, "toxic"])

    schema = ", ".join(f"{k} double" for k in KINDS) + ", toxic int"
    # A row per different combination: train_rows at most.
    seen = (rows.select("_text", F.col("_toxic").cast("int")).mapInArrow(features, schema)
            .groupBy(*KINDS, "toxic").agg(F.count("*").alias("n")).collect())
    grammar.bias, grammar.kinds = _fit(np.array([[*r] for r in seen], float).reshape(-1, len(KINDS) + 2))
    return grammar


def _fit(table: np.ndarray) -> tuple[float, dict[str, float]]:
    """Logistic regression of the label on the weights matched per kind, drawn to the kinds' prior values."""
    x, y, n = np.c_[np.ones(len(table)), table[:, :-2]], table[:, -2], table[:, -1]
    prior = np.array([PRIOR_BIAS, *(KIND_PRIOR[k] for k in KINDS)])
    pull = np.array([0.1] + [PRIOR_STRENGTH] * len(KINDS))
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (n * (p - y)) + pull * (beta - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
        beta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), {k: max(0.0, float(b)) for k, b in zip(KINDS, beta[1:])}


def score_documents(docs: DataFrame, grammar: Grammar, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1; a column of that name is replaced. Null texts score like empty ones."""
    @F.pandas_udf("double")
    def score(texts):
        return texts.map(grammar.score).astype("float64")

    return docs.withColumn(out, score(F.coalesce(F.col(text_col), F.lit(""))))


def classify(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; a null id is not held out."""
    scored = score_documents(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), grammar, "_text", "score")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
