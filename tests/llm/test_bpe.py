"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tests.llm.rows import clashing, collected, no_documents, odd_documents
from tsukiori.llm import byte_bpe, queries

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def described(spark):
    """What the driver keeps of the queries that have run."""
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]


@pytest.fixture(scope="module")
def texts(spark):
    more = ["don't we'll ''s x\"'s \n's  's", "<|endoftext|>", "aaaaaaaaaaaaaaaaa", " \u0085  x", "naïve²½ ٣٤"]
    return odd_documents(spark).unionByName(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"), allowMissingColumns=True
    )


def test_ids_are_the_librarys_and_decode_to_the_text(texts):
    tokens = byte_bpe.encode(texts, RANKS, keep=["doc_id", "text"])
    rows = byte_bpe.decode(tokens, RANKS, keep=["text", "ids"]).collect()
    assert len(rows) == texts.count()
    for row in rows:
        assert row["ids"] == LIBRARY.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()


@pytest.mark.parametrize("most", [0, 30])
def test_ids_do_not_depend_on_what_is_encoded_before(spark, texts, monkeypatch, most):
    monkeypatch.setattr(byte_bpe, "MOST", most)
    monkeypatch.setattr(byte_bpe, "LONG", 12)
    for row in byte_bpe.encode(texts, RANKS, keep=["text"]).collect():
        assert row["ids"] == LIBRARY.encode_ordinary(row["text"] or "")


def test_batches_spell_new_words_only(spark):
    """Known and long words come as ids, in runs that end at a new word or with the text."""
    long = "x" * 40
    docs = spark.createDataFrame([(1, f"a b {long} new c a"), (2, ""), (3, "new"), (4, None), (5, "a b")], "doc_id long, text string")
    words = {w: LIBRARY.encode_ordinary(w) for w in ("a", " a", " b", " c")}
    packed = byte_bpe.Known.pack([pa.RecordBatch.from_arrays([pa.array([w.encode() for w in words]), pa.array(list(words.values()), pa.list_(pa.int32()))], names=["word", "ids"])])
    known = byte_bpe.Known([tuple(column[0].as_py() for column in batch.columns) for batch in packed])
    rows = byte_bpe._batches(docs.coalesce(1), ["doc_id"], "text", known, RANKS).collect()
    assert [w for row in rows for w in row["words"]] == [" new".encode().hex().upper(), "new".encode().hex().upper()]
    parts = {doc["doc_id"]: [tuple(part) for part in doc["parts"]] for row in rows for doc in row["docs"]}
    before, after = LIBRARY.encode_ordinary(f"a b {long}"), LIBRARY.encode_ordinary(" c a")
    assert parts == {1: [(before, None), (None, 0), (after, None)], 2: [], 3: [(None, 1)], 4: [], 5: [(LIBRARY.encode_ordinary("a b"), None)]}


def test_ids_that_are_parts_of_characters_decode_to_their_bytes(spark):
    pieces = [bytes([b]) for b in range(256)]
    frame = spark.createDataFrame([([RANKS[p] for p in pieces],), ([],), (None,), ([RANKS[b"\xff"], 1 << 20],)], "ids array<int>")
    decoded = [row["decoded"] for row in byte_bpe.decode(frame, RANKS, keep=[]).collect()]
    assert [None if d is None else bytes(d) for d in decoded] == [b"".join(pieces), b"", None, b"\xff"]


def test_two_words_of_one_first_hash_stay_two():
    first, second = np.array([7, 5, 7, 7, 5], np.uint64), np.array([1, 2, 3, 1, 2], np.uint64)
    at, number = byte_bpe._distinct(first, second)
    assert len(at) == 3
    assert (first[at[number]] == first).all() and (second[at[number]] == second).all()
    at, number = byte_bpe._distinct(first, first)
    assert (at.tolist(), number.tolist()) == ([0, 1], [0, 1, 0, 0, 1])
    assert [len(x) for x in byte_bpe._distinct(first[:0], first[:0])] == [0, 0]


def test_words_of_a_hundred_kilobytes(spark):
    generator = random.Random(5)
    long = ["a" * 100_000, "".join(generator.choices("abcdeé中文字", k=100_000)), base64.b64encode(generator.randbytes(200_000)).decode(), "é" * 65_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")
    start = time.monotonic()
    rows = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs, RANKS).collect()}
    assert time.monotonic() - start < 120
    for i, text in enumerate(long):
        assert rows[i] == LIBRARY.encode_ordinary(text)


def test_long_words_are_merged_as_by_the_fold():
    generator = random.Random(6)
    for _ in range(300):
        word = "".join(generator.choices("abnotheriesñé中", k=generator.randrange(1, 60)))
        assert byte_bpe.merge_long(word.encode(), RANKS) == LIBRARY.encode_ordinary(word)


def test_query_over_a_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {row["doc_id"]: row["text"] or "" for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_plans_do_not_spell_the_ranks(spark, texts):
    tokens = byte_bpe.encode(texts, RANKS)
    for frame in (tokens, byte_bpe.decode(tokens, RANKS)):
        assert len(frame._jdf.queryExecution().toString()) < 200_000
    longest = max(len(d) for d in described(spark))
    assert longest < 200_000  # of the plans that ran on the way


def test_no_documents_and_other_columns(spark, texts):
    assert byte_bpe.encode(no_documents(spark), RANKS).collect() == []
    one = byte_bpe.encode(texts, RANKS)
    other = byte_bpe.encode(clashing(texts), RANKS)
    assert collected(one) == collected(other)
