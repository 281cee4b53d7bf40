import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm.data import SF0001, no_documents, odd_documents
from tokenizers import Tokenizer

from topicpulse.llm import packing
from topicpulse.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def check_sequences(rows, size):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= size
    return len(seqs)


def test_ids_equal_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    with open(RANKS) as f:
        own = packing.encoder(f.read())
    for text in ("a  b\n c's", "<|endoftext|>x", "été ² 日本 \x1c", " " * 99, "ab" * 5000):
        assert own.encode(text, allowed_special="all") == library.encode(
            text, add_special_tokens=False).ids


def test_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    rows = QUERIES["op1_packing"](spark, SF0001).collect()
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
    assert set(pieces) == set(texts)
    total = 0
    for doc, text in texts.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        total += len(ids)
        at = 0
        for k in range(len(pieces[doc])):
            r = pieces[doc][k]
            assert r["start"] == at and (k == 0 or r["length"] == 2048)
            part = ids[at:at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > 2048 or len(pieces[doc]) == 1)
    assert check_sequences(rows, 2048) <= -(-total // 2048) + 1


def test_evolution_beats_best_fit():
    rng = np.random.default_rng(3)
    # triplets that fill a bin exactly: falling best fit wastes some
    parts = rng.integers(300, 500, (60, 2))
    lengths = np.concatenate([parts.ravel(), 1200 - parts.sum(1)])
    island = packing.Island(lengths, 1200, 0)
    population = [island.fresh(0.03 * k) for k in range(packing.POPULATION)]
    start = len(island.fill(population[0]))
    best = island.fitness(population[0])
    for _ in range(15):
        population = island.evolve(population)
    fill = island.fill(population[0])
    assert fill.max() <= 1200 and (fill > 0).all() and fill.sum() == lengths.sum()
    assert island.fitness(population[0]) > best and len(fill) < start


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_any_lengths(spark, n):
    pieces = spark.range(n).selectExpr("id", "1 + pmod(id * 7919, 100) AS length", "'mine' AS item",
                                       "'old' AS offset")
    rows = packing.pack(pieces, 100).collect()
    assert len(rows) == n
    if n:
        assert rows[0]["item"] == "mine"
        least = -(-sum(r["length"] for r in rows) // 100)
        assert least <= check_sequences(rows, 100) <= 1.02 * least + 1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = packing.pack_documents(docs, RANKS, 64).collect()
    check_sequences(rows, 64)
    assert sum(r["piece"] == 0 for r in rows) == docs.count()
    assert {(r["start"], r["length"]) for r in rows if r["doc_id"] in (3, 4)} == {(0, 1)}
    assert packing.pack_documents(no_documents(spark), RANKS).count() == 0
