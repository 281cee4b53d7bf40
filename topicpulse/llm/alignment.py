"""Cross-tokenizer alignment by divide and conquer at shared cuts (operator 12).

Two tokenizers, A and B, cut the same bytes.  A place where a token of both
ends is a shared cut, and between neighbouring cuts lies one group of tokens.
The cuts are found by halving: in an interval of tokens the common end nearest
to its middle is located by bisecting each side's ends in turn, and both halves
go on; an interval without a common end inside is a leaf and one group.  All
intervals of a slice of texts are halved together, level by level, so a level
costs a few vector operations.

At a cut one occurrence of A and one of B end together: a link.  Links are
counted over the corpus per pair of ids.  Since two tokens that end together
have bytes of which one is a suffix of the other, the pairs that can occur are
bounded by the two vocabularies whatever the corpus, and that bound decides
whether the counts are broadcast to the texts or joined by a shuffle.

Edge cases: a null or empty text, and one whose joined token bytes differ from
space + text on either side, has no tokens: zeros and an empty digest; special
tokens' strings are plain text; repeated rows count each; texts of any length
are worked off in slices of whole texts; an empty table gives an empty result;
the given columns come back inside ``row``, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.llm.bpe import SPLIT_PATTERN
from topicpulse.llm.common import materialize, worker_cache

#: Bytes of text aligned at a time (one text is never split).
SLICE = 2 << 20
#: Pair counts are broadcast up to this proven size.
BROADCAST_MAX_BYTES = 256 << 20
PAIR_BYTES = 64

_COLUMNS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
            ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()),
            ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
_DDL = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
        "pairs array<long>, counts array<long>")


class Tokenizers:
    """Both encoders and the bytes of every id."""

    def __init__(self, ranks: str, model: bytes):
        import sentencepiece
        import tiktoken

        table = {base64.b64decode(t): int(r) for t, r in map(str.split, ranks.splitlines())}
        self.a = tiktoken.Encoding("alignment", pat_str=SPLIT_PATTERN, mergeable_ranks=table,
                                   special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes_a[rank] = token
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # an id's decimals with what follows it: inside its side, or at its side's end
        self.written = [f"{i}{end}" for n, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";"))
                        for i in range(n) for end in (",", last)]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B per text; none where their bytes are not space + text."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            if not text:
                out.append(([], []))
                continue
            whole = (" " + text).encode()
            a = self.a.encode_ordinary(" " + text)
            same = (b"".join(map(self.bytes_a.__getitem__, a)) == whole
                    and b"".join(map(self.bytes_b.__getitem__, b)) == whole)
            out.append((a, b) if same else ([], []))
        return out


def _meet(ends: np.ndarray, other: np.ndarray, at: np.ndarray, stop: np.ndarray,
          step: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place from ``at`` on (``step`` 1) or back (-1), before ``stop``,
    whose end is also one of ``other``, and its place there; -1 where there is none.

    Each side's end is bisected in the other's: a miss gives the other's next
    end, which is bisected in turn, so whole stretches without a common end are
    leapt over.
    """
    found, mates = np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int64)
    todo = np.arange(len(at))
    here = at.copy()
    while len(todo):
        inside = here < stop[todo] if step > 0 else here > stop[todo]
        todo, here = todo[inside], here[inside]
        if not len(todo):
            break
        value = ends[here]
        j = np.searchsorted(other, value, "left" if step > 0 else "right") - (step < 0)
        theirs = other[np.clip(j, 0, len(other) - 1)]
        hit = (theirs == value) & (j >= 0) & (j < len(other))
        found[todo[hit]], mates[todo[hit]] = here[hit], j[hit]
        miss = ~hit & (j >= 0) & (j < len(other))
        todo, theirs = todo[miss], theirs[miss]
        here = np.searchsorted(ends, theirs, "left" if step > 0 else "right") - (step < 0)
    return found, mates


def _halves(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Left and right halves in turn, so that intervals stay in text order."""
    out = np.empty(2 * len(left), np.int64)
    out[0::2], out[1::2] = left, right
    return out


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray,
                last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of the tokens that end together, in text order.

    ``ends_*`` rise over all texts of a slice; ``last_*`` are the places of each
    text's last tokens, which end together.
    """
    first_a = np.concatenate([[0], last_a[:-1] + 1]).astype(np.int64)
    first_b = np.concatenate([[0], last_b[:-1] + 1]).astype(np.int64)
    cuts_a, cuts_b = [], []
    # an interval's own end is a cut; inside it are the tokens before that
    lo_a, hi_a, lo_b, hi_b = first_a, last_a, first_b, last_b
    while len(lo_a):
        leaf = (lo_a == hi_a) | (lo_b == hi_b)
        cuts_a.append(hi_a[leaf])
        cuts_b.append(hi_b[leaf])
        lo_a, hi_a, lo_b, hi_b = (x[~leaf] for x in (lo_a, hi_a, lo_b, hi_b))
        middle = (lo_a + hi_a) // 2
        cut, mate = _meet(ends_a, ends_b, middle, hi_a, 1)
        none = np.flatnonzero(cut < 0)
        cut[none], mate[none] = _meet(ends_a, ends_b, middle[none] - 1, lo_a[none] - 1, -1)
        none = cut < 0
        cuts_a.append(hi_a[none])
        cuts_b.append(hi_b[none])
        lo_a, hi_a, lo_b, hi_b, cut, mate = (x[~none] for x in (lo_a, hi_a, lo_b, hi_b, cut, mate))
        lo_a, hi_a = _halves(lo_a, cut + 1), _halves(cut, hi_a)
        lo_b, hi_b = _halves(lo_b, mate + 1), _halves(mate, hi_b)
    a = np.concatenate(cuts_a) if cuts_a else np.zeros(0, np.int64)
    b = np.concatenate(cuts_b) if cuts_b else np.zeros(0, np.int64)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _flat(parts: list[list[int]]) -> np.ndarray:
    sizes = sum(map(len, parts))
    return np.fromiter(chain.from_iterable(parts), np.int64, sizes)


def align_texts(tools: Tokenizers, texts: list[str | None], groups: bool) -> list[pa.Array]:
    """The columns of ``_COLUMNS`` for a slice of texts."""
    coded = tools.encode([t or "" for t in texts])
    n_a = np.array([len(a) for a, _ in coded], np.int64)
    n_b = np.array([len(b) for _, b in coded], np.int64)
    a, b = _flat([x for x, _ in coded]), _flat([x for _, x in coded])
    full = np.flatnonzero(n_a)
    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
    cut_a, cut_b = shared_cuts(np.cumsum(tools.sizes_a[a]), np.cumsum(tools.sizes_b[b]),
                               stop_a[full] - 1, stop_b[full] - 1)
    first = np.searchsorted(cut_a, stop_a - n_a)
    n_groups = np.searchsorted(cut_a, stop_a) - first
    pairs, counts, bounds = _pairs(a[cut_a] * len(tools.bytes_b) + b[cut_b], n_groups)
    written = _written(tools, a, b, cut_a, cut_b, stop_a + stop_b - n_a - n_b, n_a + n_b)
    digests = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
    counted = pa.array(n_groups, pa.int64())
    return [pa.array(n_a), pa.array(n_b), counted, counted, pa.array(digests, pa.string()),
            pa.array(written if groups else [None] * len(texts), pa.string()),
            pa.ListArray.from_arrays(bounds, pa.array(pairs, pa.int64())),
            pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int64()))]


def _pairs(links: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each text's distinct pairs, how often each, and the texts' bounds in them."""
    text = np.repeat(np.arange(len(per_text)), per_text)
    order = np.lexsort((links, text))
    links, text = links[order], text[order]
    new = np.ones(len(links), bool)
    new[1:] = (links[1:] != links[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(links)))
    bounds = np.searchsorted(text[at], np.arange(len(per_text) + 1))
    return links[at], counts, pa.array(bounds, pa.int32())


def _written(tools: Tokenizers, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray,
             cut_b: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2`` per text."""
    sizes_a, sizes_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[cut_a] = 1
    last_b[cut_b] = 1
    # an A token stands after all B tokens of earlier groups, a B token after all
    # A tokens up to its own group
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(cut_b + 1 - sizes_b, sizes_a)] = 2 * a + last_a
    out[np.arange(len(b)) + np.repeat(cut_a + 1, sizes_b)] = 2 * (len(tools.bytes_a) + b) + last_b
    words = list(map(tools.written.__getitem__, out.tolist()))
    return ["".join(words[s:s + n])[:-1] for s, n in zip(start.tolist(), size.tolist())]


def align(docs: DataFrame, ranks_path: str, model_path: str, text: str = "text",
          groups: bool = False) -> DataFrame:
    """row (the columns of ``docs`` but the text), n_a, n_b, n_groups, n_links,
    groups_sha256, groups (written out if asked for, else null), and the text's
    distinct linked id pairs (A id * size of B + B id) with their counts."""
    context = docs.sparkSession.sparkContext
    with open(ranks_path, encoding="ascii") as f:
        ranks = context.broadcast(f.read())       # a fixed 0.8 MB
    with open(model_path, "rb") as f:
        model = context.broadcast(f.read())       # a fixed 0.5 MB
    name = f"alignment-{ranks_path}-{model_path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = worker_cache(name, lambda: Tokenizers(ranks.value, model.value))
        for batch in batches:
            weights = np.cumsum([len(t) + 1 if t else 1 for t in batch.column("text").to_pylist()])
            slice_of = weights // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(slice_of)) + 1).tolist(), len(weights)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                made = align_texts(tools, part.column("text").to_pylist(), groups)
                yield pa.RecordBatch.from_arrays([part.column("row"), *made],
                                                 names=["row", *[c for c, _ in _COLUMNS]])

    given = docs.select(F.struct(*[c for c in docs.columns if c != text],
                                 F.monotonically_increasing_id().alias("__row")).alias("row"),
                        F.col(text).alias("text"))
    schema = f"row {given.schema['row'].dataType.simpleString()}, {_DDL}"
    return given.mapInArrow(run, schema)


def pair_bound(ranks_path: str, model_path: str) -> int:
    """How many id pairs can end together: those where one's bytes end the other's."""
    with open(ranks_path, encoding="ascii") as f, open(model_path, "rb") as g:
        tools = Tokenizers(f.read(), g.read())
    sides = []
    for tokens in (tools.bytes_a, tools.bytes_b):
        ids: dict[bytes, int] = {}
        for t in tokens:
            ids[t] = ids.get(t, 0) + 1
        sides.append(ids)
    bound = 0
    for mine, others, whole in ((*sides, 0), (*sides[::-1], 1)):
        bound += sum(n * others.get(t[k:], 0) for t, n in mine.items()
                     for k in range(whole, len(t)))
    return bound


def with_corpus_counts(aligned: DataFrame, n_b: int, bound: int) -> DataFrame:
    """``aligned`` (written out) with n_best and count_sum in place of its pairs."""
    links = aligned.select("row", *[c for c, _ in _COLUMNS if c not in ("pairs", "counts", "groups")],
                           F.explode_outer(F.arrays_zip("pairs", "counts")).alias("link"))
    counts = (links.filter("link IS NOT NULL").groupBy(F.col("link.pairs").alias("pair"))
              .agg(F.sum("link.counts").alias("total")))
    counts = materialize(counts, "pair-counts", narrow=True)
    side_b = F.expr(f"pair % {n_b}").alias("b")
    most = counts.groupBy(side_b).agg(F.max("total").alias("most"))
    judged = counts.select("pair", "total", side_b).join(most, "b").select(
        "pair", "total", (F.col("total") == F.col("most")).alias("best"))
    if bound * PAIR_BYTES <= BROADCAST_MAX_BYTES:
        judged = F.broadcast(judged)
    joined = links.join(judged, F.col("link.pairs") == F.col("pair"), "left")
    own = [c for c in joined.columns if c in dict(_COLUMNS)]
    n = F.col("link.counts")
    # a text's links lie in one task, so they meet there before the shuffle
    return joined.groupBy("row", *own).agg(
        F.coalesce(F.sum(F.when(F.col("best"), n)), F.lit(0)).alias("n_best"),
        F.coalesce(F.sum(n * F.col("total")), F.lit(0)).alias("count_sum"))


def aligned_counts(docs: DataFrame, ranks_path: str, model_path: str,
                   text: str = "text") -> DataFrame:
    """row, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum per row of
    ``docs``; ``row`` holds the other columns and ``__row``, a number of its own."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=model_path).vocab_size()
    aligned = materialize(align(docs, ranks_path, model_path, text), "aligned")
    return with_corpus_counts(aligned, size_b, pair_bound(ranks_path, model_path))

