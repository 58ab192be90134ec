"""Simple-8b words, token-id files and word-piece counts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.rows import clashing, collected, no_documents, odd_documents
from tsukiori.llm import pretokens, simple8b, wordpiece
from tsukiori.llm import textbytes as tb

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
IDS = st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1))


@given(st.lists(st.lists(IDS, max_size=40).flatmap(lambda x: st.integers(1, 20).map(lambda k: x * k)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_decode_to_the_ids(documents):
    ids = np.array([i for d in documents for i in d], np.uint64)
    counts = np.array([len(d) for d in documents], np.int64)
    assert simple8b.unpack(*simple8b.pack(ids, counts), counts).tolist() == ids.tolist()


def test_a_word_holds_as_many_ids_as_fit():
    words, sizes = simple8b.encode(np.ones(240, np.uint64), np.array([0]))
    assert sizes.tolist() == [4] and (words >> np.uint64(60) == 1).all()
    words, _ = simple8b.encode(np.array([2**62, 5], np.uint64), np.array([0]))
    assert words[0] >> np.uint64(60) == 0 and words[1] == 2**62


def test_split_is_the_patterns():
    random = np.random.default_rng(5)
    letters = list("ab1 9  \n\t'''strevmdl.,-é²ñ中　 \u0085 ß日😀٣")
    texts = ["".join(random.choice(letters, random.integers(0, 40))) for _ in range(5000)] + ["don't we'll 'sure ''s x\"'s \n's  's", ""]
    pattern = regex.compile(public_tokenizers.PATTERN)
    data, offsets = tb.utf8(pa.array(texts))
    starts = pretokens.split(data, offsets)
    bounds = tb.owners(starts, offsets)
    for i, text in enumerate(texts):
        own = [*starts[bounds[i] : bounds[i + 1]], offsets[i + 1]]
        assert [data[a:b].tobytes().decode() for a, b in zip(own, own[1:])] == pattern.findall(text)


def test_a_full_word_cache_forgets_but_stays_right():
    calls = []

    def encode(text):
        calls.append(text)
        return [0 if c == "\n" else ord(c) for c in text]

    cache = pretokens.WordCache(encode, most=64)
    for _ in range(3):
        for k in range(20):
            words = [f"{k}w{i}" for i in range(30)]
            data, offsets = tb.utf8(pa.array(words))
            ids, counts = cache.look_up(data, offsets[:-1], offsets[1:])
            assert ids.tolist() == [ord(c) for w in words for c in w] and counts.tolist() == [len(w) for w in words]


def expected_files(docs):
    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    return [library.encode(row["text"] or "", add_special_tokens=False).ids + [2] for row in docs]


def test_files_hold_the_documents_in_order(spark, tmp_path):
    docs = odd_documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    simple8b.write_token_ids(docs, str(tmp_path / "ids"), TOKENIZER, end_id=2)
    files = simple8b.read_token_ids(spark, str(tmp_path / "ids"))
    rows = {row["doc_id"]: row for row in simple8b.checksums(files).collect()}
    start = 0
    source = docs.orderBy("doc_id").collect()
    for row, ids in zip(source, expected_files(source), strict=True):
        made = rows[row["doc_id"]]
        assert (made["start"], made["n_tokens"]) == (start, len(ids))
        assert made["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_odd_rows_in_files(spark, tmp_path):
    docs = odd_documents(spark)
    simple8b.write_token_ids(clashing(docs), str(tmp_path / "odd"), TOKENIZER, end_id=2)
    rows = simple8b.checksums(simple8b.read_token_ids(spark, str(tmp_path / "odd"))).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10]
    assert [r["start"] for r in rows][1:] == np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()
    simple8b.write_token_ids(no_documents(spark), str(tmp_path / "none"), TOKENIZER, end_id=2)
    assert simple8b.read_token_ids(spark, str(tmp_path / "none")).collect() == []


def test_added_tokens_are_those_of_the_library(spark, tmp_path):
    library = Tokenizer.from_file(TOKENIZER)
    end = "<|endoftext|>"
    texts = [f"a page end {end} next", f"{end}{end}", f"x{end}'s {end}\n\n{end}", "half <|endo", "ftext|> of one", f"é {end}é  {end}", f"<{end[1:-1]} >", "", None, f"  {end}"]
    random = np.random.default_rng(3)
    texts += ["".join(random.choice(["a", " ", "\n", "'s", "é", "9", "<|", end, end[:6], end[6:]], random.integers(0, 25))) for _ in range(2000)]
    data, offsets = tb.utf8(pa.array(texts))
    ids, counts = simple8b.Encoder(TOKENIZER).ids(data, offsets)
    want = [library.encode(text or "", add_special_tokens=False).ids for text in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    docs = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    simple8b.write_token_ids(docs, str(tmp_path / "added"), TOKENIZER, end_id=2)
    rows = simple8b.checksums(simple8b.read_token_ids(spark, str(tmp_path / "added"))).orderBy("doc_id").collect()
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for x in want[:40]]
    assert [r["start"] for r in rows] == [sum(len(x) + 1 for x in want[:i]) for i in range(40)]


def greedy(word, pieces):
    count = 0
    while word:
        size = next(k for k in range(len(word), 0, -1) if word[:k] in pieces)
        word, count = word[size:], count + 1
    return count


def test_piece_counts_are_those_of_greedy_matching():
    random = np.random.default_rng(7)
    for _ in range(60):
        singles = [bytes([b]) for b in range(256)]
        pieces = {*singles, *(bytes(random.choice([97, 98, 99, 32], random.integers(2, 7)).tolist()) for _ in range(25))}
        machine = wordpiece.build(pieces)
        words = [bytes(random.choice([97, 98, 99], random.integers(1, 15)).tolist()) for _ in range(40)]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        got = wordpiece.count_pieces(machine, data, ends - [len(w) for w in words], ends)
        assert got.tolist() == [greedy(b" " + w, pieces) for w in words]


def test_piece_counts_of_documents(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = set(wordpiece.read_vocabulary(path))
    docs = odd_documents(spark)
    rows = wordpiece.token_counts(docs, path, keep=["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for row in rows:
        words = regex.findall(rb"[^\x20\x09-\x0d]+", (row["text"] or "").encode())
        assert row["n_words"] == len(words)
        assert row["n_tokens"] == sum(greedy(b" " + w, pieces) for w in words)
    assert collected(wordpiece.token_counts(clashing(docs), path)) == collected(wordpiece.token_counts(docs, path))
    assert wordpiece.token_counts(no_documents(spark), path).collect() == []
