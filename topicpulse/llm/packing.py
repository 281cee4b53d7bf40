"""Best-fit packing by a grouping genetic algorithm on islands (operator 1).

Documents become token sequences; one longer than a sequence is cut so that
only its first piece may be short.  Full pieces fill a sequence alone.  The
others are dealt to blocks of about BLOCK pieces by hash, and every block is
solved by several islands, each a Spark row that holds a population of
groupings and is evolved by its own task:

- a crossover injects a choice of one parent's best-filled bins into the other,
  removes the bins that hold duplicates of their pieces (and some of the
  worst-filled ones), and best-fits the displaced pieces in falling size;
- fitness is the mean squared fill, so full bins are kept together;
- after each epoch the best grouping of an island migrates to the next one.

The pieces of poorly filled bins of all blocks are packed again in a further
round of fewer blocks, until one block or no gain is left.

A task holds one island: BLOCK pieces, whatever the size of the input.
State between epochs is a written table, so a lost executor repeats one epoch.

Edge cases: a null or empty text is the closing id alone (one piece of length
1); equal lengths are interchangeable and are ordered by hash; repeated rows
are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.llm.bpe import SPLIT_PATTERN
from topicpulse.llm.common import free_name, materialize, shuffle_width, worker_cache

#: Pieces per block, islands per block, groupings per island.
BLOCK = 2000
ISLANDS = 3
POPULATION = 6
EPOCHS = 2
CROSSOVERS = 20
#: Share of a parent's bins that a crossover injects, and of the worst bins it reopens.
INJECT = 0.15
REOPEN = 0.05
#: Bins filled less than this share are packed again with other blocks' bins.
WELL_FILLED = 0.97
#: Fixed value: the special token of the vocabulary, recognised in texts.
SPECIAL = {"<|endoftext|>": 50256}

_BIN = 32
_BINS = (1 << _BIN) - 1


def encoder(ranks: str):
    """A tokenizer from the text of a rank file."""
    import tiktoken

    table = {base64.b64decode(t): int(r) for t, r in map(str.split, ranks.splitlines())}
    return tiktoken.Encoding("packing", pat_str=SPLIT_PATTERN, mergeable_ranks=table,
                             special_tokens=SPECIAL)


def cut_points(n: int, size: int) -> list[int]:
    """Where a document of n ids is cut: all pieces but the first are full."""
    return [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]


def pieces_of(docs: DataFrame, ranks_path: str, size: int, text: str = "text",
              doc_id: str = "doc_id", end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    with open(ranks_path, encoding="ascii") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())   # a fixed 0.8 MB
    name = f"packing-{ranks_path}"

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = worker_cache(name, lambda: encoder(spec.value)).encode_to_numpy
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows = []
            for doc, body in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                ids = np.concatenate([encode(body, allowed_special="all"), end]) if body else end
                cuts = cut_points(len(ids), size)
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()))
                         for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            made = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).alias("text")).mapInPandas(
        tokenize, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Island:
    """Groupings of one block's pieces; a grouping is the bin number of each piece."""

    def __init__(self, lengths: np.ndarray, size: int, seed: int):
        self.lengths = lengths
        self.list = lengths.tolist()
        self.size = size
        self.rng = np.random.default_rng(seed)
        self.falling = np.argsort(-lengths, kind="stable")

    def best_fit(self, assign: np.ndarray, free: list[int], pieces: list[int]) -> None:
        """Put the pieces, in the given order, each into the fullest bin that takes it."""
        lengths, size = self.list, self.size
        least = min((lengths[p] for p in pieces), default=size)
        room = sorted(f << _BIN | b for b, f in enumerate(free) if f >= least)
        for p in pieces:
            n = lengths[p]
            k = bisect_left(room, n << _BIN)
            if k < len(room):
                entry = room.pop(k)
                b, left = entry & _BINS, (entry >> _BIN) - n
            else:
                b, left = len(free), size - n
                free.append(size)
            free[b] = left
            assign[p] = b
            if left >= least:
                insort(room, left << _BIN | b)

    def fresh(self, noise: float) -> np.ndarray:
        """Best fit in falling size, the sizes blurred by ``noise``."""
        order = self.falling
        if noise:
            order = np.argsort(-self.lengths * (1 + noise * self.rng.standard_normal(
                len(self.lengths))), kind="stable")
        assign = np.empty(len(self.lengths), dtype=np.int64)
        self.best_fit(assign, [], order.tolist())
        return assign

    def fill(self, assign: np.ndarray) -> np.ndarray:
        return np.bincount(assign, self.lengths)

    def fitness(self, assign: np.ndarray) -> float:
        fill = self.fill(assign) / self.size
        return float((fill * fill).sum() / len(fill)) if len(fill) else 1.0

    def cross(self, giver: np.ndarray, taker: np.ndarray) -> np.ndarray:
        """The taker with some of the giver's best-filled bins injected."""
        filled = self.fill(giver)
        n = max(1, int(INJECT * len(filled)))
        ranked = np.argsort(-filled + self.rng.random(len(filled)) * 0.02 * self.size)
        chosen = self.rng.choice(ranked[:max(n, len(ranked) * 3 // 4)], n, replace=False)
        injected = np.isin(giver, chosen)
        held = self.fill(taker)
        gone = np.zeros(len(held), dtype=bool)
        gone[taker[injected]] = True
        worst = np.argsort(held)[:max(1, int(REOPEN * len(held)))]
        gone[worst] = True
        displaced = gone[taker] & ~injected
        number = np.cumsum(~gone) - 1
        child = np.where(gone[taker], -1, number[taker])
        kept = int((~gone).sum())
        _, renamed = np.unique(giver[injected], return_inverse=True)
        child[injected] = kept + renamed
        free = (self.size - np.bincount(child[child >= 0],
                                        self.lengths[child >= 0])).astype(np.int64).tolist()
        order = self.falling[displaced[self.falling]]
        if self.rng.random() < 0.5:    # a blurred order reaches other groupings
            order = order[np.argsort(-self.lengths[order] * (
                1 + 0.1 * self.rng.standard_normal(len(order))))]
        self.best_fit(child, free, order.tolist())
        return child

    def evolve(self, population: list[np.ndarray]) -> list[np.ndarray]:
        """CROSSOVERS steps; a child replaces the worst grouping when it is better."""
        scored = sorted(((self.fitness(a), k, a) for k, a in enumerate(population)),
                        key=lambda x: (-x[0], x[1]))
        serial = len(scored)
        for _ in range(CROSSOVERS if len(self.lengths) > 1 else 0):
            i, j = self.rng.choice(len(scored), 2, replace=False)
            child = self.cross(scored[min(i, j)][2], scored[max(i, j)][2])
            made = (self.fitness(child), serial, child)
            serial += 1
            if made[0] > scored[-1][0]:
                scored[-1] = made
                scored.sort(key=lambda x: (-x[0], x[1]))
        return [a for _, _, a in scored]


STATE = ("block long, island int, items binary, lengths binary, population binary, "
         "fitness double")


def _state(block: int, k: int, items: bytes, island: Island, population: list) -> dict:
    return {"block": block, "island": k, "items": items,
            "lengths": island.lengths.astype(np.int32).tobytes(),
            "population": np.stack(population).astype(np.int32).tobytes(),
            "fitness": island.fitness(population[0])}


def pack_blocks(pieces: DataFrame, size: int, blocks: int) -> DataFrame:
    """item, block, bin, offset, fill for pieces (item, length), packed per block."""
    width = max(shuffle_width(pieces.sparkSession), blocks // 4)

    def seed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        block = int(key[0])
        items = rows["item"].to_numpy(np.int64).tobytes()
        lengths = rows["length"].to_numpy(np.int64)
        out = []
        for k in range(ISLANDS):
            island = Island(lengths, size, block * ISLANDS + k)
            first = [island.fresh(0.0 if i == 0 else 0.03 * i) for i in range(POPULATION)]
            first.sort(key=island.fitness, reverse=True)
            out.append(_state(block, k, items, island, first))
        return pd.DataFrame(out)

    def step(epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.to_dict("records"):
                    lengths = np.frombuffer(r["lengths"], np.int32).astype(np.int64)
                    island = Island(lengths, size, (epoch * 1_000_003 + r["block"]) * ISLANDS
                                    + r["island"])
                    population = list(np.frombuffer(r["population"], np.int32).astype(
                        np.int64).reshape(-1, len(lengths)))
                    if r["migrant"] is not None:
                        population.append(np.frombuffer(r["migrant"], np.int32).astype(np.int64))
                    population = island.evolve(population)[:POPULATION]
                    yield pd.DataFrame([_state(r["block"], r["island"], r["items"], island,
                                               population)])
        return run

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    state = materialize(dealt.repartition(width, "block").groupBy("block").applyInPandas(
        seed, STATE), "islands")
    for epoch in range(EPOCHS):
        elite = state.select(
            "block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
            # the population is sorted: its best grouping comes first
            F.expr("substring(population, 1, length(lengths))").alias("migrant"))
        if epoch == 0:
            elite = elite.withColumn("migrant", F.lit(None).cast("binary"))
        state = materialize(
            state.join(elite, ["block", "island"]).repartition(width, "block", "island")
            .mapInPandas(step(epoch), STATE), "islands")
    best = state.groupBy("block").agg(F.max_by(F.struct("items", "lengths", F.expr(
        "substring(population, 1, length(lengths))").alias("bins")),
        F.struct("fitness", -F.col("island"))).alias("s")).select("block", "s.*")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                lengths = np.frombuffer(r["lengths"], np.int32).astype(np.int64)
                bins = np.frombuffer(r["bins"], np.int32)
                order = np.lexsort((-lengths, bins))
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.searchsorted(bins[order], bins[order])
                offset = np.empty(len(lengths), dtype=np.int64)
                offset[order] = before - before[first]
                yield pd.DataFrame({"item": np.frombuffer(r["items"], np.int64),
                                    "block": r["block"], "bin": bins, "offset": offset,
                                    "fill": np.bincount(bins, lengths)[bins].astype(np.int64),
                                    "length": lengths})

    return best.mapInPandas(place, "item long, block long, bin int, offset long, fill long, "
                                   "length long")


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to size) with sequence_id and offset.

    Input columns with these names make way for the results.
    """
    pieces = pieces.drop("sequence_id", "offset")
    item = free_name(pieces.columns, "item")
    table = materialize(pieces.withColumn(item, F.monotonically_increasing_id()), "pieces")
    short = table.select(F.col(item).alias("item"), "length")
    rest = short.filter(F.col("length") < size).select("item", "length")
    done = short.filter(F.col("length") == size).select(
        "item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n, round_, last = rest.count(), 0, None
    while n:
        blocks = -(-n // BLOCK)
        packed = materialize(pack_blocks(rest, size, blocks), "packed")
        well = F.col("fill") >= WELL_FILLED * size
        left = 0
        if blocks > 1:
            # bins that stay open, if packing them again can save one
            left, bins, filled = packed.filter(~well).agg(
                F.count("*"), F.count_distinct("block", "bin"), F.sum("length")).first()
            if not left or bins <= -(-filled // size) or (last and left > 0.8 * last):
                left = 0
        closed = packed.filter(well) if left else packed
        done = done.unionByName(closed.select(
            "item", ((F.lit(round_) * (1 << 31) + F.col("block")) * (1 << 24) + F.col("bin"))
            .cast("long").alias("sequence_id"), "offset"))
        rest = packed.filter(~well).select("item", "length")
        n, last, round_ = left, left, round_ + 1
    return table.join(done.withColumnRenamed("item", item), item).drop(item)


def pack_documents(docs: DataFrame, ranks_path: str, size: int = 2048, text: str = "text",
                   doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    return pack(pieces_of(docs, ranks_path, size, text, doc_id), size)
