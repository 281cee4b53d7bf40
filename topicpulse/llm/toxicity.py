"""Toxicity (operator 10).

A lexicon of abusive terms is held as a trie and intersected with Levenshtein
automata: a state of the product is a set of (trie node, errors), made when it
is first reached, so a word is checked by one table step per character and
misspelled terms are found with the exact ones.  A context window around each
match tells quotation or report from abuse.  Match weights by kind and context
give a few features; a logistic model turns them into a score.

The lexicon holds every word whose tie to the label is proven by its counts over
all labelled texts that are not held out (exact copies once).  The logistic
model is fitted on a bounded sample, at most ``ROWS_PER_CLASS`` rows of each
class by hash order, re-weighted to the true class shares, with features from
lexicons of the other fold (two folds by text hash), so a term that a fold has
by chance gets no undue weight.

Edge cases: a null or empty text has no matches and gets the score of its empty
feature row; without labelled rows of both classes every score is the share of
toxic rows (0 without any).  Where the input has a column ``score``, the
result's name gets underscores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicpulse.llm.common import free_name, materialize, worker_cache

ROWS_PER_CLASS = 8_000
#: Terms of one automaton; a larger lexicon is read by several, so that their
#: states stay small.
MAX_TERMS = 500
MIN_TERM_DOCS = 4
#: A term's weight: its log odds less so many standard errors; and the least weight.
ERRORS_OFF = 2.0
MIN_WEIGHT = 1.2
#: Words on each side that are looked at, and the words of a dense stretch.
CONTEXT = 6
STRETCH = 24
CACHE_ENTRIES = 150_000
#: (node, errors) pairs held in automaton states; beyond it the states start anew.
STATE_PAIRS = 400_000
#: Marks and words that announce a quotation or a report.
QUOTE_MARKS = "\"“”„«»‹›"
REPORT_WORDS = frozenset(
    "said says say quoted quote quoting wrote writes called calls term word slur reported "
    "sagte schrieb nannte zitat wort dit écrit mot cité dijo escribió llamó palabra".split())
EDGES = ".,;:!?()[]{}'`*#$%&|-_/\\<>~^+=" + QUOTE_MARKS
FEATURES = ("exact", "fuzzy", "exact_quoted", "fuzzy_quoted", "rate", "densest", "length",
            "any", "repeated")


def held_out(doc_id: Column) -> Column:
    """Whether the row's label is kept away from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def allowed_errors(n: int) -> int:
    """Edits forgiven in a term of n characters."""
    return 0 if n < 5 else 1 if n < 9 else 2


class FuzzyLexicon:
    """The terms within their allowed edit distance of a word, by a lazy product
    of the lexicon trie and the Levenshtein automaton."""

    def __init__(self, terms: dict[str, float]):
        self.weight = dict(terms)
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.slack = [0]            # greatest allowance among the terms below a node
        for term in sorted(terms):
            k, node = allowed_errors(len(term)), 0
            self.slack[0] = max(self.slack[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], k)
            self.term[node] = term
        self.alphabet = {c for below in self.children for c in below}
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.verdict: list[tuple[float, int] | None] = []
        self.pairs = 0
        self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Id of the state after skipping lexicon characters (missing in the word)."""
        waiting = list(nodes)
        while waiting:
            node = waiting.pop()
            e = nodes[node] + 1
            for child in self.children[node].values():
                if e <= self.slack[child] and nodes.get(child, 99) > e:
                    nodes[child] = e
                    waiting.append(child)
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.pairs += len(key)
            self.steps.append({})
            best = None
            for node, e in key:
                term = self.term[node]
                if term is not None and e <= allowed_errors(len(term)):
                    found = (self.weight[term] / (1 + e), -e)
                    best = max(best, found) if best else found
            self.verdict.append(best)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.states[state]:
            if e < self.slack[node]:
                after[node] = min(after.get(node, 99), e + 1)
            for label, child in self.children[node].items():
                cost = e if label == c else e + 1
                if cost <= self.slack[child] and cost < after.get(child, 99):
                    after[child] = cost
        return self._state(after) if after else -1

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, errors) of the best term within reach, or None."""
        if self.pairs > STATE_PAIRS:
            self.states, self.ids, self.steps, self.verdict, self.pairs = [], {}, [], [], 0
            self._state({0: 0})
        state, steps, alphabet = 0, self.steps, self.alphabet
        for c in word:
            if c not in alphabet:
                c = ""
            to = steps[state].get(c)
            if to is None:
                to = steps[state][c] = self._step(state, c)
            if to < 0:
                return None
            state = to
        best = self.verdict[state]
        return best and (best[0], -best[1])


def words_of(text: str | None) -> list[str]:
    """White-space words in lower case, marks included."""
    return (text or "").lower().split()


class Reader:
    """Turns texts into feature rows with one lexicon."""

    def __init__(self, terms: dict[str, float]):
        names = sorted(terms)
        self.lexicons = [FuzzyLexicon({t: terms[t] for t in names[i:i + MAX_TERMS]})
                         for i in range(0, len(names), MAX_TERMS)]
        self.known: dict[str, tuple[float, int] | None] = {}

    def match(self, word: str) -> tuple[float, int] | None:
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        bare = word.strip(EDGES)
        places = [m for m in (x.match(bare) for x in self.lexicons) if m]
        found = self.known[word] = max(places, key=lambda m: (m[0], -m[1]), default=None)
        return found

    def features(self, text: str | None) -> list[float]:
        words = words_of(text)
        known, match = self.known, self.match
        hits = []
        for i, w in enumerate(words):
            found = known[w] if w in known else match(w)
            if found:
                hits.append((i, *found))
        sums = [0.0, 0.0, 0.0, 0.0]
        for i, weight, errors in hits:
            sums[2 * self.quoted(words, i) + (errors > 0)] += weight
        densest, start, total = 0.0, 0, 0.0
        for i, weight, _ in hits:
            total += weight
            while hits[start][0] <= i - STRETCH:
                total -= hits[start][1]
                start += 1
            densest = max(densest, total)
        n = len(words)
        plain = sums[0] + sums[1]
        return [*map(math.log1p, sums), 100 * plain / (n + 20), math.log1p(densest),
                math.log1p(n), float(plain > 0), float(len(hits) > 2)]

    @staticmethod
    def quoted(words: list[str], i: int) -> bool:
        """Whether a quotation mark opens on one side and closes on the other, or a
        reporting word stands near."""
        left, right = words[max(0, i - CONTEXT):i], words[i + 1:i + 1 + CONTEXT]
        if any(w.strip(EDGES) in REPORT_WORDS for w in left + right):
            return True

        def marked(ws: list[str], end: int) -> bool:
            return any(w[end] in QUOTE_MARKS or w.rstrip(".,;:!?")[end:] in QUOTE_MARKS
                       for w in ws if w.rstrip(".,;:!?"))

        return marked([*left, words[i]], 0) and any(
            w.rstrip(".,;:!?")[-1:] in tuple(QUOTE_MARKS) for w in [words[i], *right])


@dataclass
class Model:
    """A lexicon, the scale of the features and the logistic weights."""

    terms: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = ((rows - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(rows: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> tuple:
    """Weighted ridge logistic regression by Newton steps."""
    mean = np.average(rows, axis=0, weights=w)
    scale = np.sqrt(np.average((rows - mean) ** 2, axis=0, weights=w)) + 1e-6
    x = np.column_stack([(rows - mean) / scale, np.ones(len(rows))])
    beta = np.zeros(x.shape[1])
    keep = np.diag([ridge] * rows.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        grad = x.T @ (w * (y - p)) - keep @ beta
        move = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + keep, grad)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return mean, scale, beta[:-1], float(beta[-1])


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labelled rows that are not held out."""
    return labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))


def labelled_texts(docs: DataFrame, known: DataFrame, text: str, doc_id: str) -> DataFrame:
    """text, toxic, fold of the rows with a label, exact copies once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(
        known, "doc_id").filter("text IS NOT NULL")
    once = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    return once.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))


def training_sample(docs: DataFrame, known: DataFrame, text: str, doc_id: str) -> tuple:
    """(text, toxic, fold) of the sampled labelled rows, and the class counts."""
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(
            F.xxhash64("doc_id"), "doc_id").limit(ROWS_PER_CLASS)
        drawn = part if drawn is None else drawn.unionByName(part)
    # at most 2 * ROWS_PER_CLASS pairs of numbers: a bound that no input can raise
    return materialize(labelled_texts(docs, F.broadcast(drawn), text, doc_id),
                       "toxicity-train"), counts


def learn_terms(texts: DataFrame) -> tuple[dict, dict, dict]:
    """Lexicons learned from both folds, fold 0 and fold 1: term -> weight, the
    strongest first.

    The weight is a lower bound of the log odds, so a rare word must be far more
    frequent among toxic texts, and a frequent word with a slight lean (one of a
    language with more toxic texts) ranks below every clear term.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"]):
                words = {w.strip(EDGES) for w in words_of(text)}
                seen.update((w, int(fold), int(toxic)) for w in words if 3 <= len(w) <= 40)
                seen["", int(fold), int(toxic)] += 1    # the texts themselves
            yield pd.DataFrame([(*k, n) for k, n in seen.items()],
                               columns=["word", "fold", "toxic", "n"])

    parts = [(f, t) for f in (0, 1) for t in (0, 1)]
    counts = texts.mapInPandas(count, "word string, fold int, toxic int, n long").groupBy(
        "word").agg(*[F.sum(F.expr(f"CASE WHEN fold = {f} AND toxic = {t} THEN n ELSE 0 END"))
                      .alias(f"n{f}{t}") for f, t in parts])
    counts = materialize(counts.filter(F.expr(f"word = '' OR n01 + n11 >= {MIN_TERM_DOCS}")),
                         "toxicity-words", narrow=True)
    totals = Counter({(f, t): r[f"n{f}{t}"] for r in counts.filter("word = ''").collect()
                      for f, t in parts})
    out = []
    for folds in ((0, 1), (0,), (1,)):
        pos = sum(F.col(f"n{f}1") for f in folds)
        neg = sum(F.col(f"n{f}0") for f in folds)
        all_pos = sum(totals[f, 1] for f in folds)
        all_neg = sum(totals[f, 0] for f in folds)
        odds = (F.log((pos + 0.5) / (all_pos + 1)) - F.log((neg + 0.5) / (all_neg + 1)))
        weight = odds - ERRORS_OFF * F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        rows = counts.select("word", weight.alias("weight"), pos.alias("pos")).filter(
            (F.col("word") != "") & (F.col("pos") >= MIN_TERM_DOCS)
            & (F.col("weight") >= MIN_WEIGHT)).orderBy(F.desc("weight"), "word").collect()
        out.append({r["word"]: float(r["weight"]) for r in rows})
    return tuple(out)


def features_of(docs: DataFrame, terms: dict[str, float], text: str, name: str) -> DataFrame:
    """``docs`` with the array column ``features``."""

    @F.pandas_udf("array<double>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = worker_cache(name, lambda: Reader(terms))
        for batch in batches:
            yield pd.Series([reader.features(t) for t in batch])

    return docs.withColumn("features", read(F.col(text)))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text",
          doc_id: str = "doc_id") -> Model:
    """Lexicon and logistic model from the labelled rows that are not held out."""
    known = known_labels(labels)
    sample, counts = training_sample(docs, known, text, doc_id)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    # the labels grow with the input: joined by a shuffle at every size, without a sort
    terms, of_0, of_1 = learn_terms(
        labelled_texts(docs, known.hint("shuffle_hash"), text, doc_id))
    rows = []
    for fold, lexicon in ((0, of_1), (1, of_0)):
        part = features_of(sample.filter(F.col("fold") == fold), lexicon, "text",
                           f"toxic-{hash(tuple(sorted(lexicon.items())))}")
        rows += part.select("toxic", "features").collect()
    y = np.array([r["toxic"] for r in rows], dtype=float)
    n = len(FEATURES)
    if not len(y) or y.min() == y.max():
        bias = math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0)
        return Model(terms, np.zeros(n), np.ones(n), np.zeros(n), bias)
    x = np.array([r["features"] for r in rows])
    w = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return Model(terms, *fit_logistic(x, y, w))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` double, the toxicity of each whole text."""
    name = f"toxic-{hash(tuple(sorted(model.terms.items())))}"

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = worker_cache(name, lambda: Reader(model.terms))
        for batch in batches:
            rows = np.array([reader.features(t) for t in batch]).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(rows))

    return docs.withColumn(free_name(docs.columns, "score"), rate(F.col(text)))
