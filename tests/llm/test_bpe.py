import hashlib
import random

import public_tokenizers
import pytest
from tests.llm.data import SF0001, no_documents, odd_documents
from tokenizers import Tokenizer

from topicpulse.llm import bpe
from topicpulse.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_strings_equal_the_library(library):
    own = bpe.ByteBpe(bpe.read_spec(PATH))
    rnd = random.Random(1)
    parts = ["a", "é", " ", "  ", "\n", "\t", "'s", "1", "²", "_", ".", "\x1c", "ß", "日", "\r", "'",
             "́", "\x0b", "ab", "the", "<|endoftext|>", "#" * 40, " ", "　", "😀"]
    texts = ["", "x" * 3000, " " * 50] + ["".join(rnd.choices(parts, k=rnd.randint(1, 30)))
                                         for _ in range(2000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_stale_entries_are_skipped(library):
    # runs of one letter make many equal pairs, most of them stale when popped
    own = bpe.ByteBpe(bpe.read_spec(PATH))
    for n in range(1, 200):
        assert own.encode("a" * n) == library.encode("a" * n, add_special_tokens=False).ids


def test_query_against_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    got = QUERIES["op6_bpe"](spark, SF0001).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows_and_round_trip(spark):
    docs = odd_documents(spark)
    encoded = bpe.encode_documents(docs, PATH)
    assert encoded.columns == [*docs.columns, "ids_"]
    back = bpe.decode_documents(encoded, PATH, "ids_")
    for r in back.collect():
        assert r["ids"] == "mine" and r["decoded_"] == (r["text"] or "")
    assert bpe.token_digests(docs, PATH).count() == docs.count()
    assert bpe.token_digests(no_documents(spark), PATH).count() == 0
