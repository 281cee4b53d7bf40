"""License scan (operator 5).

An Aho-Corasick automaton over words finds notice phrases and the words of the
identifier tag in one pass over the text.  The expression behind a tag is read
by a shunting-yard parser into postfix order (``with`` binds tighter than
``and``, ``and`` tighter than ``or``) and evaluated.

Words are maximal runs of digits, a-z and code points from 128 on, after A-Z
is lower-cased.  In UTF-8 this is a rule over single bytes, so the text is cut
with one byte table.

Score: how restrictive the found terms are, 0 (none found) to 1.  A license has
a fixed weight; ``or`` takes the lesser side, since a user may choose, ``and``
the greater, and ``with`` (an exception) halves the weight.  The document's
score is the greatest over its notices and expressions.

An expression starts at every tag, goes to the line's end or the next tag, and
ends before the first token that its grammar cannot continue with; its longest
complete prefix counts.  A tag not spelled with hyphens needs a colon behind it
or an identifier of a known family, else it is prose about tags.

Edge cases: a null or empty text has no words, no labels and score 0.  Rows are
independent: repeated rows repeat, an empty table gives an empty result, and
extra columns pass through the operator.  The time for a text grows with its
length, however long an expression in it is.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.llm.common import free_name

#: The notice phrases that every scan looks for, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further phrases of this scan.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Identifier families by their first letters, longest first.
FAMILIES = ("agpl", "lgpl", "gpl", "apache", "cc-by", "cc0", "mit", "mpl", "epl", "bsd", "isc")
#: How restrictive each label is.
WEIGHTS = {"public-domain": 0.05, "cc0": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.15,
           "apache": 0.2, "cc-by": 0.3, "mpl": 0.5, "epl": 0.5, "lgpl": 0.6, "gpl": 0.8,
           "agpl": 0.9, "proprietary": 1.0}
OTHER_WEIGHT = 0.5
BINDS = {"or": 1, "and": 2, "with": 3}

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
                  else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_COLON = re.compile(rb"\s*:")
_EXPRESSION = re.compile(rb"\s*:?[ \t]*([^\n]*)")
#: Identifiers, operators and brackets; any other character is a token that ends
#: an expression, or is skipped before it (quotation marks, comment signs).
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*|\S")
_LEADING = re.compile(r"[^(A-Za-z0-9]*")



def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class WordAutomaton:
    """Aho-Corasick over words: finds every place of every phrase in one pass."""

    def __init__(self, phrases: dict[str, str]):
        self.next: list[dict[bytes, int]] = [{}]
        self.found: list[list[tuple[int, str]]] = [[]]
        self.vocabulary: set[bytes] = set()
        for phrase in phrases:
            state = 0
            words = phrase.encode().split()
            self.vocabulary.update(words)
            for w in words:
                if w not in self.next[state]:
                    self.next[state][w] = len(self.next)
                    self.next.append({})
                    self.found.append([])
                state = self.next[state][w]
            self.found[state].append((len(words), phrase))
        self.fail = [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            state = waiting.popleft()
            self.found[state] = self.found[state] + self.found[self.fail[state]]
            for w, child in self.next[state].items():
                back = self.fail[state]
                while back and w not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(w, 0)
                waiting.append(child)

    def scan(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start word, phrase) of every place.  A word outside the vocabulary
        leads to the root, so only the others are walked."""
        vocabulary, places = self.vocabulary, []
        state, last = 0, -2
        for i in [i for i, w in enumerate(words) if w in vocabulary]:
            if i != last + 1:
                state = 0
            last = i
            w = words[i]
            while state and w not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(w, 0)
            places += [(i + 1 - n, phrase) for n, phrase in self.found[state]]
        return places


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: the longest prefix of infix tokens that is an expression, in
    postfix order.

    The output only grows, so a complete prefix is remembered by its length and
    by the operators still on the stack, of which there are at most three
    outside brackets.
    """
    out: list[str] = []
    stack: list[str] = []
    length, waiting = 0, []
    brackets = 0
    operand_next = True
    for token in tokens:
        low = token.lower()
        if low == "(" and operand_next:
            stack.append(low)
            brackets += 1
        elif low == ")" and not operand_next and brackets:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            brackets -= 1
        elif low in BINDS and not operand_next:
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        elif low[0].isascii() and low[0].isalnum() and low not in BINDS and operand_next:
            out.append(token)
            operand_next = False
        else:
            break
        if not operand_next and not brackets:
            length, waiting = len(out), stack[::-1]
    return out[:length] + waiting


def family(identifier: str) -> str:
    """The label of a license identifier: its family, else itself in lower case."""
    low = identifier.lower()
    return next((f for f in FAMILIES if low.startswith(f)), low)


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels and restrictiveness of a license expression.

    Labels are kept in one list, in the order of the operands; a value is where
    its labels start there, and its weight.  What stands behind ``with`` adds no
    label, and its labels are always the last of the list.
    """
    postfix = to_postfix(_TOKEN.findall(expression, _LEADING.match(expression).end()))
    labels: list[str] = []
    values: list[tuple[int, float]] = []
    for token in postfix:
        op = token.lower()
        if op in BINDS:
            (at, right), (start, left) = values.pop(), values.pop()
            if op == "with":
                del labels[at:]
                values.append((start, left / 2))
            else:
                values.append((start, min(left, right) if op == "or" else max(left, right)))
        else:
            label = family(token)
            values.append((len(labels), WEIGHTS.get(label, OTHER_WEIGHT)))
            labels.append(label)
    return set(labels), values[0][1] if values else 0.0


def expressions(text: str, tags: list[int]) -> Iterator[str]:
    """The text behind each tag, given the tags' first words."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(raw.translate(_TO_WORDS))]
    n = len(TAG.split())
    starts = [spans[i][0] for i in tags]
    for i, start, stop in zip(tags, starts, [*starts[1:], len(raw)]):
        end = spans[i + n - 1][1]
        found = _EXPRESSION.match(raw, end, stop)[1].decode("utf-8", "replace")
        first = _TOKEN.findall(found, _LEADING.match(found).end())
        name = next((t for t in first if t != "("), "")
        if raw[start:end].lower() == TAG.replace(" ", "-").encode() or _COLON.match(
                raw, end, stop) or family(name) in FAMILIES:
            yield found


def scan_text(automaton: WordAutomaton, text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = words_of(text)
    places = automaton.scan(words)
    if not places:
        return len(words), 0, None, None, "", "", 0.0
    base = [(at, BASE_PHRASES[p]) for at, p in places if p in BASE_PHRASES]
    base_labels = {label for _, label in base}
    labels = base_labels | {MORE_PHRASES[p] for _, p in places if p in MORE_PHRASES}
    score = max((WEIGHTS[x] for x in labels), default=0.0)
    tags = [at for at, p in places if p == TAG]
    if tags:
        for expression in expressions(text or "", tags):
            names, weight = evaluate(expression)
            labels |= names
            score = max(score, weight)
    at = [i for i, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)


FIELDS = ("n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double")


def scan_licenses(docs: DataFrame, text: str = "text", out: str = "license") -> DataFrame:
    """``docs`` with the struct column ``out`` (see FIELDS) for each whole text.

    If that name is taken, it gets underscores.
    """
    automaton = WordAutomaton(dict.fromkeys([*BASE_PHRASES, *MORE_PHRASES, TAG], ""))
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(f.replace(' ', ':') for f in FIELDS.split(', '))}>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([scan_text(automaton, t) for t in batch], columns=names)
            for c in names[:4]:
                found[c] = found[c].astype("Int64")
            yield found

    return docs.withColumn(free_name(docs.columns, out), scan(F.col(text)))
