"""Phrase collocation mining by top-order marginalisation (operator 11).

Texts are cut into pieces at sentence marks and pieces into words.  Only the
longest windows are counted: each word with the three that follow it in its
piece, padded where the piece ends.  Spark's ROLLUP over the window's columns
then sums them to every shorter prefix, and since each occurrence of a phrase
is the prefix of exactly one window, those sums are the counts of all phrases
of one to four words.  No n-gram explosion per length.

A window is also padded from the first pair or triple on that occurs fewer
than ``min_count`` times, because no phrase across it can be a candidate.  What
is known of pairs and triples are two bitmaps of hash buckets of fixed size,
made one after the other: a bucket that reaches the count keeps its members, so
a shared bucket only saves less, and no count of a phrase that can matter
changes.

A candidate of 2 to 4 words is cut at each place; the score of a cut is
floor(2000000 a / (l + r)) from the counts of the whole and its two parts, and
the lowest cut counts (ties: the first).  A candidate inside a longer one that
holds at least CONTAINED percent of its occurrences is dropped.

Edge cases: null text is empty, a null stratum is ``und``; a text without
words adds nothing; repeated rows count each; a long text is worked off in
slices cut between pieces (one piece is never cut); an empty table gives an
empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicpulse.llm.common import materialize

ORDER = 4
MIN_COUNT = 30
TOP = 2000
CONTAINED = 80
#: Buckets of a bitmap: 2 ** BUCKET_BITS bits, 16 MB, whatever the data.
BUCKET_BITS = 27
#: Bytes of text that a task cuts into words at a time.
SLICE = 2 << 20
TOP_SALT = 32

_WORDS = [f"w{i}" for i in range(1, ORDER + 1)]
#: A byte that UTF-8 never holds marks the end of a piece.
_END = b"\xff"
_FOLD = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09
              else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK_BITS = 15      # bits of one row that bitmap_construct_agg makes


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(stratum, folded text) of about ``size`` bytes, cut between pieces only."""
    held: dict[str, list[bytes]] = {}
    weight: dict[str, int] = {}

    def cut(body: bytes) -> Iterator[bytes]:
        at = 0
        while len(body) - at > size and (end := body.find(_END, at + size)) >= 0:
            yield body[at:end]
            at = end
        yield body[at:]

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for stratum, text in zip(batch.column("lang").to_pylist(), texts):
            body = text.as_py()
            if not body:
                continue
            held.setdefault(stratum, []).append(body.translate(_FOLD))
            weight[stratum] = weight.get(stratum, 0) + len(body)
            if weight[stratum] >= size:
                weight[stratum] = 0
                for part in cut(_END.join(held.pop(stratum))):
                    yield stratum, part
    for stratum, parts in held.items():
        for part in cut(_END.join(parts)):
            yield stratum, part


def coded(body: bytes) -> tuple[np.ndarray, pa.Array, int]:
    """Word codes in text order, the words, and the code that ends a piece; three
    ends follow the last word."""
    words = body.replace(_END, b" \xff ").split()
    words += [_END] * (ORDER - 1)
    column = pa.array(words, pa.binary()).dictionary_encode()
    end = column.dictionary.index(pa.scalar(_END, pa.binary())).as_py()
    return column.indices.to_numpy().astype(np.int64), column.dictionary, end


def word_hashes(codes: np.ndarray, words: pa.Array, stratum: str) -> np.ndarray:
    """A 64-bit hash of each word, seeded by the stratum."""
    import xxhash

    seed = xxhash.xxh32_intdigest(stratum.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()], np.uint64)[codes]


def run_buckets(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bucket of each run of ``size`` words."""
    n = len(hashes) - size + 1
    mixed = hashes[:n]
    for k in range(1, size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def usual_runs(codes: np.ndarray, end: int, hashes: np.ndarray,
               bitmaps: list[np.ndarray]) -> list[np.ndarray]:
    """For sizes 1, 2, ...: whether the run that starts at a place lies in a piece
    and the bitmaps of its size and below know it and all runs inside it."""
    usual = [codes != end]
    for size, bitmap in enumerate(bitmaps, 2):
        bucket = run_buckets(hashes, size)
        known = (bitmap[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1
        usual.append(usual[-1][:-1] & usual[-1][1:] & known)
    return usual


def window_lengths(usual: list[np.ndarray]) -> np.ndarray:
    """Per place the words of its window: up to a piece's end or a rare run."""
    n = len(usual[0]) - (ORDER - 1)
    length = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    for k in range(ORDER):
        # word k belongs if the longest known run that ends there is usual
        size = min(k + 1, len(usual))
        open_ &= usual[size - 1][k + 1 - size:][:n]
        length += open_
    return length


def counted(codes: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, places, counts): one place for each distinct padded window."""
    places = np.flatnonzero(length)
    key = codes[places]
    width = np.int64(codes.max() + 1) if len(codes) else 1
    for k in range(1, ORDER + 1):
        ends = length[places] == k
        if ends.any():
            _, at, n = np.unique(key[ends], return_index=True, return_counts=True)
            yield k, places[ends][at], n
        places, key = places[~ends], key[~ends]
        if not len(places):
            return
        _, key = np.unique(key * width + codes[places + k], return_inverse=True)


def usual_buckets(docs: DataFrame, min_count: int, size: int, known: list):
    """A broadcast bitmap of the buckets in which ``min_count`` runs of ``size``
    words meet; only runs whose shorter runs are all ``known`` are counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [np.frombuffer(b.value, np.uint8) for b in known]
        for stratum, body in slices(batches, SLICE):
            codes, words, end = coded(body)
            hashes = word_hashes(codes, words, stratum)
            inner = usual_runs(codes, end, hashes, bitmaps)[-1]
            bucket, n = np.unique(run_buckets(hashes, size)[inner[:-1] & inner[1:]],
                                  return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(n, pa.int32())],
                                             names=["bucket", "n"])

    block, bit = F.shiftright("bucket", _BLOCK_BITS), F.col("bucket").bitwiseAND((1 << _BLOCK_BITS) - 1)
    rows = (docs.mapInArrow(count, "bucket int, n int")
            .groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
            .groupBy(block.alias("block")).agg(F.bitmap_construct_agg(bit.cast("long")).alias("bits")))
    bitmap = bytearray(1 << (BUCKET_BITS - 3))
    size_of = 1 << (_BLOCK_BITS - 3)
    for row in rows.collect():          # at most 4,096 rows of 4 KB
        bitmap[row["block"] * size_of:(row["block"] + 1) * size_of] = row["bits"]
    return docs.sparkSession.sparkContext.broadcast(bytes(bitmap))


def windows(docs: DataFrame, min_count: int) -> DataFrame:
    """lang, w1..w4 (padded with ''), n: a slice's distinct longest windows."""
    known: list = []
    for size in range(2, ORDER):
        known.append(usual_buckets(docs, min_count, size, list(known)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [np.frombuffer(b.value, np.uint8) for b in known]
        for stratum, body in slices(batches, SLICE):
            codes, words, end = coded(body)
            length = window_lengths(usual_runs(codes, end, word_hashes(codes, words, stratum),
                                               bitmaps))
            texts = words.to_pylist()
            texts[end] = b""
            texts = pa.array(texts, pa.binary()).cast(pa.string())
            for k, places, n in counted(codes, length):
                columns = [texts.take(pa.array(codes[places + i] if i < k
                                               else np.full(len(places), end)))
                           for i in range(ORDER)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([stratum] * len(places)), *columns, pa.array(n, pa.int64())],
                    names=["lang", *_WORDS, "n"])

    return docs.mapInArrow(count, "lang string, " + ", ".join(f"{w} string" for w in _WORDS)
                           + ", n long")


def phrase_counts(docs: DataFrame, min_count: int, text: str = "text",
                  stratum: str = "lang") -> DataFrame:
    """lang, words array, phrase, f of every phrase of 1 to 4 words found at least
    ``min_count`` times, and per stratum a row without words whose f counts all."""
    given = docs.select(F.coalesce(F.col(stratum), F.lit("und")).alias("lang"),
                        F.col(text).alias("text"))
    level = F.grouping_id()
    longest = windows(given, min_count).groupBy("lang", *_WORDS).agg(F.sum("n").alias("n"))
    summed = longest.rollup("lang", *_WORDS).agg(
        F.sum("n").alias("f"), level.alias("level"))
    # the levels that keep k words: 2 ** (4 - k) - 1
    k = sum((F.col("level") == (1 << (ORDER - i)) - 1).cast("int") * i for i in range(1, ORDER + 1))
    last = F.element_at(F.array(*_WORDS), F.greatest(k, F.lit(1)))
    words = F.slice(F.array(*_WORDS), F.lit(1), k)
    kept = ((k > 0) & (last != "") & (F.col("f") >= min_count)) | (F.col("level") == (1 << ORDER) - 1)
    return summed.filter(kept).select("lang", words.alias("words"),
                                      F.array_join(words, " ").alias("phrase"), "f")


def _part(start: int | object, length: int | object):
    return F.array_join(F.slice("words", start, length), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score: each candidate at its lowest cut."""
    cands = phrases.filter(F.size("words") >= 2)
    cuts = cands.select("lang", "phrase", "words", F.col("f").alias("a"),
                        F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"),
                       _part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"),
                       F.size("words").alias("size"))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    score = F.expr("CAST((2000000BD * CAST(a AS DECIMAL(28,0))) DIV "
                   "(CAST(l AS DECIMAL(28,0)) + CAST(r AS DECIMAL(28,0))) AS BIGINT)")
    best = cuts.groupBy("lang", "phrase", "a", "size").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def contained(phrases: DataFrame) -> DataFrame:
    """lang, phrase, holder: the count of the most frequent longer candidate around it."""
    longer = phrases.filter(F.size("words") >= 3)
    spans = F.expr("flatten(transform(sequence(2, size(words) - 1), n -> "
                   "transform(sequence(1, size(words) - n + 1), i -> "
                   "array_join(slice(words, i, n), ' '))))")
    return (longer.select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("f").alias("holder")))


def mine(docs: DataFrame, text: str = "text", stratum: str = "lang", min_count: int = MIN_COUNT,
         top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each stratum's first ``top`` phrases."""
    phrases = materialize(phrase_counts(docs, min_count, text, stratum), "phrases")
    total = phrases.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    wide = "DECIMAL(38,0)"
    kept = (scored(phrases).join(contained(phrases), ["lang", "phrase"], "left")
            .filter(F.expr(f"holder IS NULL OR 100 * CAST(holder AS {wide}) "
                           f"< {CONTAINED} * CAST(a AS {wide})")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a stratum's last task gets at most TOP_SALT * top rows
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALT))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    first = kept.withColumn("nth", F.row_number().over(near)).filter(F.col("nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
