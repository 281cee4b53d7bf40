"""Byte-level BPE encoding and decoding (operator 6).

A text is cut into words by the vocabulary's split pattern.  Each word starts
as a doubly linked list of byte symbols; a priority queue holds the merge rank
of every neighbouring pair, and popping it applies the lowest rank, leftmost
first.  An entry whose pair has changed since it was pushed is stale and is
skipped.  Decoding concatenates the vocabulary strings of the ids and maps
their characters back to bytes.

Cost: a word of n bytes takes O(n log n).  Words repeat, so each worker keeps a
bounded table of segments it has encoded; it is emptied when full and holds
nothing that the result depends on.

Edge cases: a null text encodes as the empty text (no ids); the special-token
strings of the file are found in the text first and give their own id, as the
library's ``encode`` does; unused truncation and padding are off.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.llm.common import free_name, worker_cache

#: Fixed value: the split pattern of the byte-level vocabularies (letters,
#: numbers, other marks, white space).
SPLIT_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                 r"|\s+(?!\S)|\s+")
#: The same pattern over plain Latin text, for the faster standard matcher;
#: it is used only where ``PLAIN`` covers the whole segment.
PLAIN_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+"
                 r"| ?[^ \t\n\rA-Za-zÀ-ÖØ-öø-ÿ0-9]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
PLAIN = r"[ -~\t\n\rÀ-ÖØ-öø-ÿ]*"
#: Segments and words kept per worker; beyond it the table starts anew.
CACHE_ENTRIES = 250_000
_PAIR = 1 << 20
_PLACE = 32
_PLACES = (1 << _PLACE) - 1


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand
    for themselves, the others take the code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b if b in printable else next(extra)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder for one byte-level BPE tokenizer file (JSON text)."""

    def __init__(self, spec: str):
        import regex

        data = json.loads(spec)
        vocab = data["model"]["vocab"]
        alphabet = byte_alphabet()
        self.byte_ids = [vocab.get(c, -1) for c in alphabet]
        # pair of ids -> ((rank + 1) << 20 | id of the merged symbol)
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[left] * _PAIR + vocab[right],
                                   (rank + 1) * _PAIR + vocab[left + right])
        to_byte = {c: bytes([b]) for b, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = 1 + max(chain(vocab.values(), self.special.values()))
        self.bytes_of = [b""] * size
        for token, i in chain(vocab.items(), self.special.items()):
            self.bytes_of[i] = b"".join(to_byte.get(c) or c.encode() for c in token)
        self.decimal = [str(i) for i in range(size)]
        self.le32 = [i.to_bytes(4, "little") for i in range(size)]
        self.words_of = regex.compile(SPLIT_PATTERN).findall
        self.plain_words_of = re.compile(PLAIN_PATTERN).findall
        self.is_plain = re.compile(PLAIN).fullmatch
        self.cut_special = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ).split if self.special else None
        self._words: dict[str, tuple[int, ...]] = {}
        self._segments: dict[str, tuple[int, ...]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to a list of symbol ids by queue and linked list.

        A queue entry is one integer: the merge (rank first), then the place of
        its left symbol.  ``pending[i]`` is the merge of the pair that now starts
        at i; an entry that differs from it is stale.
        """
        n = len(symbols)
        merges = self.merges.get
        pending = [merges(a * _PAIR + b, 0) for a, b in zip(symbols, symbols[1:])]
        queue = [found << _PLACE | i for i, found in enumerate(pending) if found]
        if not queue:
            return symbols
        pending.append(0)
        heapq.heapify(queue)
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & _PLACES
            found = entry >> _PLACE
            if pending[i] != found:
                continue
            made = symbols[i] = found % _PAIR
            j = after[i]
            symbols[j] = -1
            pending[j] = -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                found = pending[i] = merges(made * _PAIR + symbols[j], 0)
                if found:
                    push(queue, found << _PLACE | i)
            else:
                pending[i] = 0
            h = before[i]
            if h >= 0:
                found = pending[h] = merges(symbols[h] * _PAIR + made, 0)
                if found:
                    push(queue, found << _PLACE | h)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        got = self._words.get(word)
        if got is None:
            if len(self._words) >= CACHE_ENTRIES:
                self._words.clear()
            byte_ids = self.byte_ids
            got = tuple(self.merge([byte_ids[b] for b in word.encode()]))
            if len(word) < 64:
                self._words[word] = got
        return got

    def segment(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch of text that starts and ends at word bounds."""
        body = text[1:] if text.startswith(" ") else text
        if body.isalpha():
            return self.word(text)
        got = self._segments.get(text)
        if got is None:
            if len(self._segments) >= CACHE_ENTRIES:
                self._segments.clear()
            if body[-1:] in _ENDS and body[:-1].isalpha():
                got = self.word(text[:-1]) + self.word(text[-1])
            else:
                cut = self.plain_words_of if self.is_plain(text) else self.words_of
                got = tuple(chain.from_iterable(map(self.word, cut(text))))
            if len(text) < 64:
                self._segments[text] = got
        return got

    def ordinary(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids by segment.  A space before a non-space always starts a word, so
        the text may be cut there; runs of spaces keep their text whole."""
        if not text:
            return
        parts = text.split(" ")
        if "  " in text or " \n" in text or any(map(_starts_odd, parts)):
            parts = re.split(r" (?=\S)", text)
        words, segments = self._words.get, self._segments.get
        yield self.segment(parts[0])
        for part in parts[1:]:
            part = " " + part
            yield words(part) or segments(part) or self.segment(part)

    def encode(self, text: str) -> list[int]:
        if self.cut_special is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(self.ordinary(text)))
        ids: list[int] = []
        for k, part in enumerate(self.cut_special(text)):
            if k % 2:
                ids.append(self.special[part])
            else:
                ids.extend(chain.from_iterable(self.ordinary(part)))
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_ENDS = frozenset(".,;:!?)")


def _starts_odd(part: str) -> bool:
    """Whether a part cut at single spaces is empty or starts with white space."""
    return not part or part[0].isspace()


def read_spec(path: str) -> str:
    """The tokenizer file's text; the driver reads it and ships it to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer(spark: SparkSession, path: str):
    """A broadcast handle of the tokenizer file (a fixed 1.5 MB, whatever the data)."""
    return spark.sparkContext.broadcast(read_spec(path))


def held(spec) -> ByteBpe:
    """The worker's encoder for a broadcast tokenizer file."""
    return worker_cache(f"bpe-{hash(spec.value)}", lambda: ByteBpe(spec.value))


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int>, the BPE ids of ``text``.

    A column already named ``ids`` is kept; the new one then gets underscores.
    """
    spec = tokenizer(docs.sparkSession, path)
    out = free_name(docs.columns, "ids")

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = held(spec)
        for batch in texts:
            yield pd.Series([bpe.encode(t or "") for t in batch])

    return docs.withColumn(out, encode(F.col(text)))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` string, the text of ``ids`` (null ids: null)."""
    spec = tokenizer(docs.sparkSession, path)
    out = free_name(docs.columns, "decoded")

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = held(spec)
        for batch in batches:
            yield pd.Series([None if x is None else bpe.decode(list(x)) for x in batch])

    return docs.withColumn(out, decode(F.col(ids)))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of the ids and of
    the text decoded from them, in one pass and without a shuffle."""
    spec = tokenizer(docs.sparkSession, path)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = held(spec)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = bpe.encode(text or "")
                decimals = ",".join(map(bpe.decimal.__getitem__, ids))
                decoded = bpe.decode(ids)
                rows.append((doc_id, len(ids), hashlib.sha256(decimals.encode()).hexdigest(),
                             hashlib.sha256(decoded.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
