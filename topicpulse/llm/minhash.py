"""Near duplicates among texts by weighted MinHash (operator 4).

A text is a weighted set of its five-word shingles (lower case, white-space
words; a shorter text is one shingle), weight tf * idf.  Improved consistent
weighted sampling draws K samples of it, such that two texts agree in a sample
with probability equal to their weighted Jaccard similarity.

1. Equal texts are merged first, so every later step sees a text once.
2. The samples are cut into bands; texts that share a band meet in a bucket.
   Inside a bucket the share of equal samples estimates the similarity, and a
   forest over the pairs estimated at LOOSE or more is kept: at most one row
   per member, never all pairs.
3. The forest's components are small groups of likely copies.  Their texts are
   fetched once, and pairs of a group estimated at TIGHT or more are verified
   by their weighted Jaccard similarity, unless both are already linked.
4. Components of the verified links are the classes.

Buckets and groups beyond BLOCK members or UNIT_BYTES are dealt to blocks, each a
unit of work of its own (``components``).  A round links the members of a block;
only one root per linked set goes on to the next round, where the roots are dealt
anew, so a group of n copies costs O(n) rows.  A root does not speak for its set:
what is not linked to a key's largest component after the rounds is compared with
all members of the key, in pairs of blocks, on samples first; only texts that then
have an unlinked candidate are fetched.  Nothing is left out, and only members that
share a key without being copies cost more than O(n).
With r = 5 rows in each of b = 20 bands a pair of similarity 0.8 shares a
bucket with probability 0.9996; estimates that far below a true 0.8 (LOOSE and
TIGHT) are five and four standard deviations away.

Idf: document frequencies are counted over all distinct texts in DF_BUCKETS hash
buckets, a table of fixed size.  idf = ln(1 + n / max(df, n * COMMON)): only
shingles found in more than a third of the texts weigh less, because a
group of copies may hold a third, and its own shingles must not lose weight
against the few edits in it.

Edge cases: a text that is null or has no words forms no class but its own;
the class is named by its least doc_id, and one row with it is kept (of
repeated rows, one); null doc_ids never name a class that has another id.
Which row stays is decided within each class: classes of one name (a doc_id on
unrelated texts, or only null doc_ids) keep one row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicpulse.llm.common import free_name, materialize, shuffle_width, worker_cache
from topicpulse.llm.components import connected

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 20
ROWS = 5
SAMPLES = BANDS * ROWS
LOOSE = 0.6
TIGHT = 0.65
#: Members and bytes of a unit of work (a text is never cut).
BLOCK = 256
UNIT_BYTES = 16 << 20
DF_BUCKETS = 1 << 16
COMMON = 1 / 3
#: Distinct random draws per sample; a shingle takes one by its hash.
DRAWS = 1 << 15
SEED = 7
CACHE_ENTRIES = 200_000
_CHUNK = 2048
#: Odd multipliers of the hash mix.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Word -> 64-bit hash, computed when first asked for."""

    def __missing__(self, word: str) -> int:
        import xxhash

        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(words: Words, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text and how often each occurs."""
    parts = (text or "").lower().split()
    n = len(parts)
    if len(words) > CACHE_ENTRIES:
        words.clear()
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    width = min(SHINGLE, n)
    if not n:
        return h, np.zeros(0, np.int64)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += h[k:n - width + 1 + k] * _MIX[k]
    return np.unique(mix(total + np.uint64(width)), return_counts=True)


class Sampler:
    """Improved consistent weighted sampling with a fixed table of draws."""

    def __init__(self, idf: np.ndarray):
        self.log_idf = np.log(idf).astype(np.float32)
        self.idf = idf
        self.words = Words()
        rng = np.random.default_rng(SEED)
        shape = (DRAWS, SAMPLES)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape, dtype=np.float32)

    def weights(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * self.idf[(h >> np.uint64(48)).astype(np.intp)]

    def samples(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """SAMPLES 32-bit sample identities (shingle and level) of a weighted set."""
        best = np.full(SAMPLES, np.inf, np.float32)
        won = np.zeros(SAMPLES, np.uint64)
        for i in range(0, len(h), _CHUNK):
            part = h[i:i + _CHUNK]
            draw = ((part >> np.uint64(20)) & np.uint64(DRAWS - 1)).astype(np.intp)
            log_w = self.log_idf[(part >> np.uint64(48)).astype(np.intp)] + np.log(
                tf[i:i + _CHUNK]).astype(np.float32)
            r, beta = self.r[draw], self.beta[draw]
            level = np.floor(log_w[:, None] / r + beta)
            log_a = self.log_c[draw] - r * (level - beta + 1)
            at = log_a.argmin(0)
            k = np.arange(SAMPLES)
            least = log_a[at, k]
            identity = mix(part[at] + level[at, k].astype(np.int64).astype(np.uint64) * _MIX[2])
            won = np.where(least < best, identity, won)
            best = np.minimum(best, least)
        return (won >> np.uint64(32)).astype(np.uint32)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[3]
    for k in range(ROWS):
        key = mix(key + rows[:, k] * _MIX[k] + np.uint64(k))
    return key.view(np.int64)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Similarity of two weighted sets given as (sorted hashes, weights)."""
    ha, wa = a
    hb, wb = b
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    on = hb[at] == ha
    both = np.minimum(wa[on], wb[at[on]]).sum()
    return float(both / (wa.sum() + wb.sum() - both))


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def distinct_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """node, digest, least doc_id and text of every distinct text that has words."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).alias("text")).filter(has_words(F.col("text")))
    once = rows.groupBy(F.md5("text").alias("digest")).agg(
        F.min("doc_id").alias("least"), F.first("text").alias("text"))
    return materialize(once.withColumn("node", F.monotonically_increasing_id()), "texts")


def learn_idf(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """idf per hash bucket, from the shingles of all distinct texts of ``docs``."""
    return idf_of(distinct_texts(docs, text, doc_id))


def idf_of(texts: DataFrame) -> np.ndarray:
    """idf per hash bucket, from the shingles of all ``texts``.

    A task sends one count per bucket, so what is shuffled per task and what
    reaches the driver (DF_BUCKETS numbers) does not depend on the data.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        seen = np.zeros(DF_BUCKETS, np.int64)
        n = 0
        for batch in batches:
            for t in batch["text"]:
                h, _ = shingles(words, t)
                b = (h >> np.uint64(48)).astype(np.intp)
                n += 1
                if len(b) > 1024:
                    seen += np.bincount(b, minlength=DF_BUCKETS) > 0
                else:
                    seen[np.unique(b)] += 1
        yield pd.DataFrame({"bucket": np.append(np.arange(DF_BUCKETS), -1),
                            "n": np.append(seen, n)})

    got = texts.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toPandas()
    df = np.zeros(DF_BUCKETS)
    n = float(got.loc[got["bucket"] == -1, "n"].sum())
    known = got[got["bucket"] >= 0]
    df[known["bucket"].to_numpy()] = known["n"].to_numpy()
    return np.log1p(n / np.maximum(df, max(n * COMMON, 1.0))) if n else np.ones(DF_BUCKETS)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal keys in a sorted stream, each whole."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        k = rows[keys].to_numpy()
        starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(1))) if len(rows) else []
        for a, b in zip(starts[:-1], starts[1:]):
            yield rows.iloc[a:b]
        rest = rows.iloc[starts[-1]:] if len(rows) else None
    if rest is not None and len(rest):
        yield rest


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per index the least index reachable over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (old == label).all():
            return label


def estimates(sig: np.ndarray, right: np.ndarray, diagonal: bool) -> tuple:
    """(a, b, estimate) of the pairs of a unit of work: all pairs of one block, or
    the pairs across two blocks; only those at LOOSE or more."""
    n = len(sig)
    left_at = np.arange(n) if diagonal else np.flatnonzero(~right)
    right_at = np.arange(n) if diagonal else np.flatnonzero(right)
    out_a, out_b, out_e = [], [], []
    for x in left_at:
        others = right_at[right_at > x] if diagonal else right_at
        e = (sig[others] == sig[x]).mean(1) if len(others) else np.zeros(0)
        on = e >= LOOSE
        if on.any():
            out_a.append(np.full(int(on.sum()), x))
            out_b.append(others[on])
            out_e.append(e[on])
    if not out_a:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_e)


def blocks_of(n: Column, size: Column) -> Column:
    """Units of work that n members of ``size`` bytes in all are dealt to."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / UNIT_BYTES)).cast("int")


def dealt(blocks: Column, *by: Column | str) -> Column:
    return F.pmod(F.xxhash64(*by), blocks).cast("int")


def in_blocks(members: DataFrame) -> DataFrame:
    """key, node, size, blocks: the members of keys with more than one of them."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all"))
    sizes = sizes.filter("n > 1").select("key", blocks_of(F.col("n"), F.col("all")).alias("blocks"))
    return members.join(sizes, "key")


def per_unit(rows: DataFrame, by: list[str], work: Callable, schema: str) -> DataFrame:
    """``work`` applied to the rows of each unit, in order of their nodes."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for unit in runs(batches, by):
            made = work(unit)
            if len(made):
                out.append(made)
                held += len(made)
            if held > 10_000:
                yield pd.concat(out)
                out, held = [], 0
        if out:
            yield pd.concat(out)

    return rows.repartition(shuffle_width(rows.sparkSession), *by).sortWithinPartitions(
        *by, "node").mapInPandas(each, schema)


def samples_of(unit: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(unit["sig"]), np.uint16).reshape(-1, SAMPLES)


def candidates(unit: pd.DataFrame, least: float) -> tuple:
    """(a, b, estimate) of a unit's pairs estimated at ``least`` or more: all pairs of
    a block, or across two blocks those whose ends are not yet linked."""
    if "right" not in unit:
        a, b, e = estimates(samples_of(unit), np.zeros(len(unit), bool), True)
        on = e >= least
    else:
        a, b, e = estimates(samples_of(unit), unit["right"].to_numpy(),
                            unit["i"].iloc[0] == unit["j"].iloc[0])
        label = unit["label"].to_numpy()
        on = (e >= least) & (label[a] != label[b])
    return a[on], b[on], e[on]


def components(members: DataFrame, payload: DataFrame, link: Callable, least: float,
               name: str) -> DataFrame:
    """node, label: the components of the links among the members (key, node, size,
    blocks) of each key; ``link`` gives the linked pairs (a, b) of a unit's rows, all of them
    estimated at ``least`` or more.  ``payload`` has sig, and what else ``link`` reads,
    by node."""
    def rooted(unit: pd.DataFrame) -> pd.DataFrame:
        label = least_labels(len(unit), *link(unit))
        out = unit[["key", "node", "size", "blocks"]].assign(root=unit["node"].to_numpy()[label])
        return out[(out["blocks"] > 1) | (out["root"] != out["node"])]

    live, links, step = members, None, 0
    while True:
        rows = live.withColumn("unit", dealt(F.col("blocks"), "key", "node", F.lit(step))).join(
            payload, "node")
        found = materialize(per_unit(rows, ["key", "unit"], rooted,
                                     "key long, node long, size long, blocks int, root long"),
                            f"{name}-round", narrow=True)
        made = found.filter("node != root").select(F.col("node").alias("a"),
                                                   F.col("root").alias("b"))
        links = made if links is None else links.unionByName(made)
        many = found.filter("blocks > 1")
        if not step:
            hot = many.select("key", "node", "size")
        # a key goes on while its roots need at most half the blocks
        was = many.groupBy("key").agg(F.first("blocks").alias("was"))
        live = materialize(in_blocks(many.filter("node = root").select("key", "node", "size")).join(
            was, "key").filter("blocks = 1 OR 2 * blocks <= was").drop("was"),
            f"{name}-roots", narrow=True)
        step += 1
        if not live.limit(1).count():
            break
    labels = connected(links)
    if not hot.limit(1).count():
        return labels
    units = unlinked_units(hot, labels, name)
    if not units.limit(1).count():
        return labels

    def involved(unit: pd.DataFrame) -> pd.DataFrame:
        a, b, _ = candidates(unit, least)
        return unit.iloc[np.union1d(a, b)].drop(columns="sig")

    def joined(unit: pd.DataFrame) -> pd.DataFrame:
        node = unit["node"].to_numpy()
        label = least_labels(len(unit), *link(unit))
        on = label != np.arange(len(node))
        return pd.DataFrame({"a": node[on], "b": node[label[on]]})

    by = ["key", "i", "j"]
    open_rows = per_unit(units.join(payload.select("node", "sig"), "node").select(
        *units.columns, "sig"), by, involved, "key long, i int, j int, right boolean, node long, label long")
    more = per_unit(materialize(open_rows, f"{name}-open", narrow=True).join(payload, "node"), by,
                    joined, "a long, b long")
    old = labels.filter("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return connected(old.unionByName(more))


def unlinked_units(hot: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """key, i, j, right, node, label: pairs of blocks of a key's members, such that all
    its members outside its largest component meet all its members."""
    at = materialize(hot.join(labels, "node", "left").select(
        "key", "node", "size", F.coalesce("label", "node").alias("label")),
        f"{name}-labelled", narrow=True)
    sets = at.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    by_n = F.struct("n", "label")
    keys = sets.groupBy("key").agg(
        F.max_by("label", by_n).alias("main"), F.count("*").alias("sets"), F.max("n").alias("n"),
        F.max_by("size", by_n).alias("size"), F.sum("n").alias("all_n"),
        F.sum("size").alias("all_size")).filter("sets > 1").select(
        "key", "main", blocks_of(F.col("n"), F.col("size")).alias("inner"),
        blocks_of(F.col("all_n") - F.col("n"), F.col("all_size") - F.col("size")).alias("outer"))
    rows = at.join(keys, "key").withColumn("off", F.col("label") != F.col("main"))
    rows = rows.withColumn("mine", F.when(
        F.col("off"), dealt(F.col("outer"), "key", "node")).otherwise(
        F.col("outer") + dealt(F.col("inner"), "key", "node")))
    last = F.when(F.col("off"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("key", F.least("mine", "other").alias("i"),
                       F.greatest("mine", "other").alias("j"),
                       (F.col("mine") == F.greatest("mine", "other")).alias("right"),
                       "node", "label")


def likely_groups(reps: DataFrame) -> DataFrame:
    """node, label of the texts that may have a near duplicate."""
    rows = reps.select("node", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"),
                                    F.sum(F.xxhash64("node") % (1 << 31)).alias("set"))
    # buckets with the same members are compared once
    once = sizes.filter("n > 1").groupBy("n", "least", "set").agg(F.min("key").alias("key"))
    size = F.lit(SAMPLES * 2).cast("long")
    members = materialize(rows.join(once.select("key", "n"), "key").select(
        "key", "node", size.alias("size"), blocks_of(F.col("n"), F.col("n") * size).alias("blocks")),
        "buckets", narrow=True)

    def link(unit: pd.DataFrame) -> tuple:
        return candidates(unit, LOOSE)[:2]

    return components(members, reps.select("node", "sig"), link, LOOSE, "likely")


def verified_groups(groups: DataFrame, reps: DataFrame, texts: DataFrame,
                    idf: np.ndarray, threshold: float) -> DataFrame:
    """node, label: the components of the verified pairs of each group."""
    # the text of a likely copy is fetched once, for all units of work it is in
    loaded = materialize(groups.join(reps.select("node", "sig"), "node").join(
        texts.select("node", "text"), "node"), "likely-texts")
    members = loaded.select(F.col("label").alias("key"), "node",
                            F.octet_length("text").cast("long").alias("size"))

    def link(unit: pd.DataFrame) -> tuple:
        words = worker_cache("minhash-words", Words)
        a, b, e = candidates(unit, TIGHT)
        text = unit["text"].to_numpy()
        sets: dict = {}

        def weighted(k: int) -> tuple:
            if k not in sets:
                h, tf = shingles(words, text[k])
                sets[k] = (h, tf * idf[(h >> np.uint64(48)).astype(np.intp)])
            return sets[k]

        root = list(range(len(text)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        out = []
        for k in np.argsort(-e, kind="stable"):
            x, y = int(a[k]), int(b[k])
            rx, ry = find(x), find(y)
            if rx != ry and weighted_jaccard(weighted(x), weighted(y)) >= threshold:
                root[max(rx, ry)] = min(rx, ry)
                out.append((x, y))
        pairs = np.array(out, dtype=int).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    return components(in_blocks(members), loaded.select("node", "sig", "text"), link, TIGHT, "verified")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
            threshold: float = THRESHOLD) -> DataFrame:
    """digest, class_id, stays: the class of every distinct text that has words, and
    whether it is the one text of its class (least digest with the name) that stays."""
    texts = distinct_texts(docs, text, doc_id)
    idf = idf_of(texts)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = worker_cache(f"icws-{hash(idf.tobytes())}", lambda: Sampler(idf))
        for batch in batches:
            made = [sampler.samples(*shingles(sampler.words, t)) for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"],
                                "sig": [s.astype(np.uint16).tobytes() for s in made],
                                "bands": [band_keys(s) for s in made]})

    reps = materialize(texts.select("node", "text").mapInPandas(
        sign, "node long, sig binary, bands array<long>"), "texts-signed")
    labels = verified_groups(likely_groups(reps), reps, texts, idf, threshold)
    named = texts.select("node", "digest", "least").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    # a null doc_id comes after all others
    best = named.groupBy("label").agg(F.min(F.struct(
        F.col("least").isNull().alias("unnamed"), "least", "digest")).alias("best"))
    return materialize(named.join(best, "label").select(
        "digest", F.col("best.least").alias("class_id"),
        (F.col("digest") == F.col("best.digest")).alias("stays")), "text-classes", narrow=True)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, kept."""
    found = classes(docs, text, doc_id, threshold)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.when(has_words(F.col(text)), F.md5(F.col(text))).alias("digest"))
    named = F.col("stays") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    rows = materialize(rows.join(found, "digest", "left").select(
        "doc_id", "digest", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(
            F.col("class_id")).alias("class_id"), F.coalesce(named, F.lit(False)).alias("named"),
        F.monotonically_increasing_id().alias("row")), "documents-classed", narrow=True)
    # of the rows with the class's id and text, one stays; texts without words all stay
    first = rows.filter("named").groupBy("digest").agg(F.min("row").alias("first"))
    kept = rows.filter("named").join(first, F.col("row") == F.col("first"), "left").select(
        "doc_id", "class_id", F.col("first").isNotNull().alias("kept"))
    return kept.unionByName(rows.filter("NOT named").select(
        "doc_id", "class_id", F.col("digest").isNull().alias("kept")))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, and all without words."""
    found = classes(docs, text, doc_id, threshold)
    names = [*docs.columns]
    digest, other, other_id = (free_name(names, n) for n in ("digest", "same_digest", "same_id"))
    rows = docs.withColumn(digest, F.when(has_words(F.col(text)), F.md5(F.col(text))))
    blank = rows.filter(F.col(digest).isNull()).drop(digest)
    pick = found.filter("stays").select(F.col("digest").alias(other),
                                        F.col("class_id").alias(other_id))
    stay = rows.join(pick, (F.col(digest) == F.col(other))
                     & F.col(doc_id).cast("long").eqNullSafe(F.col(other_id)), "left_semi")
    return stay.dropDuplicates([digest]).drop(digest).unionByName(blank)
