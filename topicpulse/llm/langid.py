"""Language identification (operator 3).

A byte convolutional network: byte embeddings, filters of several widths,
rectifier, max pooling over a fixed-length window, softmax.  It is trained in
numpy on windows of labelled texts and applied to every window of every whole
text; a document's class is the one with the greatest mean probability over
its windows, weighted by their bytes.

Every label that occurs is learned.  Training reads a bounded sample of each:
about ``DOCS_PER_LANG`` texts, fewer when there are so many labels that
``TRAIN_DOCS`` would be passed, but ``LEAST_DOCS`` or all that a label has; and
at most ``WINDOWS_PER_DOC`` windows of each text.  Sampling is by text hash, so
copies of a text are in or out together and give their windows once.

For application the embedding and the first layers are folded into tables over
byte pairs, so a filter response is a sum of one or two table rows.  Python
workers hold these tables (a fixed 17 MB) and one chunk of windows.

Edge cases: a null text, or one without a letter, gets ``und`` and score 0;
so does everything when no labelled row exists.  Ties go to the label that
sorts first.  Columns of the input pass through; where one is called like a
result, the result's name gets underscores.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicpulse.llm.common import free_name

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
DOCS_PER_LANG = 500
TRAIN_DOCS = 32_000
LEAST_DOCS = 20
WINDOWS_PER_DOC = 6
EPOCHS = 6
BATCH = 128
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: Windows scored at a time.
_CHUNK = 512


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode's letter categories is in the text; numerals
    such as superscripts and fractions are word characters, but no letters."""
    return bool(text) and any(unicodedata.category(m.group())[0] == "L"
                              for m in _LETTER.finditer(text))


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept away from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts (zero-padded uint8 rows) and how many each text has."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], dtype=np.int64)
    flat = b"".join(t + bytes(n * WINDOW - len(t)) for t, n in zip(texts, counts.tolist()))
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), counts


@dataclass
class ByteNet:
    """Weights of the network; ``labels`` in sorted order."""

    labels: list[str]
    embed: np.ndarray            # (256, EMBED)
    filters: list[np.ndarray]    # per width: (width, EMBED, FILTERS)
    bias: list[np.ndarray]       # per width: (FILTERS,)
    out: np.ndarray              # (len(WIDTHS) * FILTERS, labels)
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 0) -> ByteNet:
        rng = np.random.default_rng(seed)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(labels, draw(256, EMBED, scale=0.5),
                   [draw(w, EMBED, FILTERS, scale=(w * EMBED) ** -0.5) for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                   draw(len(WIDTHS) * FILTERS, len(labels), scale=0.1),
                   np.zeros(len(labels), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def taps(self, k: int) -> list[np.ndarray]:
        """Per tap of filter bank k: the response to each byte, (256, FILTERS)."""
        return [self.embed @ self.filters[k][j] for j in range(WIDTHS[k])]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rectified maxima (n, banks * FILTERS) and where each was reached."""
        tops, places = [], []
        for k, w in enumerate(WIDTHS):
            span = WINDOW - w + 1
            response = sum(np.take(t, windows[:, j:j + span], axis=0)
                           for j, t in enumerate(self.taps(k)))
            at = response.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0] + self.bias[k])
        return np.maximum(np.concatenate(tops, 1), 0), places

    def step(self, windows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy, in the order of ``parameters``."""
        n = len(windows)
        hidden, places = self.pooled(windows)
        p = softmax(hidden @ self.out + self.out_bias)
        p[np.arange(n), y] -= 1
        p /= n
        d_hidden = (p @ self.out.T) * (hidden > 0)
        d_embed = np.zeros_like(self.embed)
        d_filters, d_bias = [], []
        for k, w in enumerate(WIDTHS):
            g = d_hidden[:, k * FILTERS:(k + 1) * FILTERS]
            d_bias.append(g.sum(0))
            d_bank = np.zeros_like(self.filters[k])
            for j in range(w):
                seen = np.take_along_axis(windows, places[k] + j, 1)       # (n, FILTERS) bytes
                d_bank[j] = np.einsum("nf,nfe->ef", g, self.embed[seen])
                np.add.at(d_embed, seen, g[:, :, None] * self.filters[k][j].T[None])
            d_filters.append(d_bank)
        return [d_embed, *d_filters, *d_bias, hidden.T @ p, p.sum(0)]

    def fit(self, windows: np.ndarray, y: np.ndarray, seed: int = 0, rate: float = 0.01) -> None:
        """Adam over shuffled batches, with a falling step size."""
        rng = np.random.default_rng(seed)
        params = self.parameters()
        m = [np.zeros_like(a) for a in params]
        v = [np.zeros_like(a) for a in params]
        t, total = 0, EPOCHS * max(1, -(-len(y) // BATCH))
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                take = order[i:i + BATCH]
                t += 1
                lr = rate * (1 - (t - 1) / total)
                for a, g, mi, vi in zip(params, self.step(windows[take], y[take]), m, v):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    a -= lr * (mi / (1 - 0.9 ** t)) / (np.sqrt(vi / (1 - 0.999 ** t)) + 1e-8)

    def folded(self) -> list[tuple[int, np.ndarray | None, np.ndarray]]:
        """Per bank: (width, table over the first byte pair, table over the rest)."""
        banks = []
        for k, w in enumerate(WIDTHS):
            t = self.taps(k)
            first = (t[0][:, None] + t[1][None]).reshape(65536, FILTERS) + self.bias[k]
            rest = None if w == 2 else t[2] if w == 3 else (
                t[2][:, None] + t[3][None]).reshape(65536, FILTERS)
            banks.append((w, first, rest))
        return banks


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(net: ByteNet, banks: list, windows: np.ndarray) -> np.ndarray:
    """Class probabilities of each window, in chunks of bounded size."""
    out = np.empty((len(windows), len(net.labels)), np.float32)
    for i in range(0, len(windows), _CHUNK):
        part = windows[i:i + _CHUNK].astype(np.intp)
        pairs = part[:, :-1] * 256 + part[:, 1:]
        hidden = []
        for w, first, rest in banks:
            span = WINDOW - w + 1
            response = np.take(first, pairs[:, :span], axis=0)
            if w == 3:
                response += np.take(rest, part[:, 2:2 + span], axis=0)
            elif w == 4:
                response += np.take(rest, pairs[:, 2:2 + span], axis=0)
            hidden.append(response.max(axis=1))
        out[i:i + _CHUNK] = softmax(np.maximum(np.concatenate(hidden, 1), 0) @ net.out
                                    + net.out_bias)
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> ByteNet | None:
    """Train on the rows of ``docs`` with a label; None when there are none."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        "text IS NOT NULL AND lang IS NOT NULL")
    # distinct texts, since copies are drawn together
    counts = rows.groupBy("lang").agg(
        F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()
    if not counts:
        return None
    docs_each = max(LEAST_DOCS, min(DOCS_PER_LANG, TRAIN_DOCS // len(counts)))
    share = {r["lang"]: docs_each / max(r["n"], 1) for r in counts}
    # of a few texts all are drawn, whatever the estimate's error
    limits = docs.sparkSession.createDataFrame(
        [(k, 1.0 if v > 0.5 else v) for k, v in share.items()], "lang string, share double")
    # one row a label, and the model holds a column for each
    drawn = rows.join(F.broadcast(limits), "lang").filter(
        F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < F.col("share") * (1 << 40))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text_, lang_ in zip(batch["text"], batch["lang"]):
                raw = text_.encode("utf-8", "replace")
                n = max(1, -(-len(raw) // WINDOW))
                take = min(n, WINDOWS_PER_DOC)
                for k in (j * n // take for j in range(take)):
                    made.append((lang_, raw[k * WINDOW:(k + 1) * WINDOW]))
            yield pd.DataFrame(made, columns=["lang", "bytes"])

    got = drawn.select("text", "lang").mapInPandas(
        cut, "lang string, bytes binary").distinct().orderBy(
        F.xxhash64("bytes", "lang"), "bytes", "lang").toPandas()
    labels = sorted(share)
    net = ByteNet.fresh(labels)
    if len(got) and len(labels) > 1:
        windows, _ = windows_of([bytes(b) for b in got["bytes"]])
        net.fit(windows, np.searchsorted(labels, got["lang"].to_numpy().astype(str)))
    return net


def result_names(docs: DataFrame) -> tuple[str, str]:
    """What the columns lang_pred and score are called beside those of ``docs``."""
    return free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")


def predict(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` string and ``score`` double for each whole text."""
    lang_out, score_out = result_names(docs)
    if net is None:
        return docs.withColumns({lang_out: F.lit(UNKNOWN), score_out: F.lit(0.0)})
    model = net

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        banks = model.folded()
        labels = np.array(model.labels, dtype=object)
        for batch in batches:
            known = [has_letter(t) for t in batch]
            pred = np.full(len(batch), UNKNOWN, dtype=object)
            score = np.zeros(len(batch))
            at = np.flatnonzero(known)
            for part in np.array_split(at, max(1, len(at) // 256)):
                if len(part) == 0:
                    continue
                windows, counts = windows_of([batch.iloc[i].encode("utf-8", "replace")
                                              for i in part])
                weight = (windows != 0).sum(1).astype(np.float64)
                owner = np.repeat(np.arange(len(part)), counts)
                mean = np.zeros((len(part), len(labels)))
                # a chunk at a time: windows times labels may be many
                for i in range(0, len(windows), _CHUNK):
                    now = slice(i, i + _CHUNK)
                    p = probabilities(model, banks, windows[now]) * weight[now, None]
                    starts = np.flatnonzero(np.diff(owner[now], prepend=-1))
                    mean[owner[now][starts]] += np.add.reduceat(p, starts)
                mean /= np.maximum(np.bincount(owner, weight), 1)[:, None]
                best = mean.argmax(1)
                pred[part] = labels[best]
                score[part] = np.clip(mean[np.arange(len(part)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    both = free_name(docs.columns, "language")
    return docs.withColumn(both, classify(F.col(text))).select(
        *docs.columns, F.col(f"{both}.lang_pred").alias(lang_out),
        F.col(f"{both}.score").alias(score_out))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang",
             doc_id: str = "doc_id") -> DataFrame:
    """Learn from the rows that are not held out, then predict every row."""
    net = learn(docs.filter(~held_out(F.col(doc_id))), text, lang)
    return predict(docs, net, text)
