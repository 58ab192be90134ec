"""Ranked search, collocations and packing against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.rows import clashing, collected, no_documents, odd_documents
from tsukiori.llm import collocations, packing, queries, ranked_search

SF_DIR = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def brute_search(docs, items, k):
    counts = [(name, Counter(terms(text))) for name, text in docs]
    total, n = sum(sum(c.values()) for _, c in counts), sum(bool(c) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for name, text in items:
        wanted[name] |= set(terms(text))
    rows = []
    for item, own in wanted.items():
        scores = []
        for name, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t]
            )
            if score > 0:
                scores.append((-score, name is None, name))
        rows += [(name, item, i + 1, -s) for i, (s, _, name) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("block_terms", "batch"), [(200_000, 10_000), (4, 7), (30, 1)])
def test_best_documents_as_by_all_scores(spark, block_terms, batch):
    random.seed(block_terms)
    words = [f"w{i}" for i in range(30)] + ["é", "中"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(random.choices(words, weights, k=random.choice([0, 1, 3, 9, 40]))) for _ in range(150)]
    docs = [(random.randrange(100) if i % 9 else None, t) for i, t in enumerate(texts)] + [(7, None), (8, "W1-w2.É"), (8, "W1-w2.É")]
    items = [(f"i{i % 11}", " ".join(random.choices(words, k=random.choice([1, 2, 8])))) for i in range(14)] + [(None, "w3 w3 W4"), ("x", None), ("y", "unknown")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        found = collected(ranked_search.search(frame, asked, 5, block_terms=block_terms))
    finally:
        spark.conf.set(key, before)
    assert found == brute_search(docs, items, 5)


def test_accumulators_stop_and_survivors_are_exact():
    """A common term's list opens no accumulators once k documents of a rare one are ahead."""
    doc = np.concatenate([np.arange(3), np.arange(1000)])
    term = np.concatenate([np.zeros(3, np.int64), np.ones(1000, np.int64)])
    lists = ranked_search.Lists(1000, doc, term, np.full(1003, 10))
    totals = lists.scores(np.array([0, 1]), np.array([100, 1]), 3, 0)
    assert totals[:3].tolist() == [1010] * 3 and not totals[3:].any()
    assert np.count_nonzero(lists.scores(np.array([0, 1]), np.array([100, 1]), 4, 0)) == 1000
    assert not lists.scores(np.array([0, 1]), np.array([100, 1]), 4, 2000).any()


def test_search_over_odd_documents(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "rain falls on old"), (2, "TEXT without an"), (3, "русский größer 中文字")], "item_id long, text string")
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.collect()], 50)
    assert collected(ranked_search.search(docs, items)) == want
    assert collected(ranked_search.search(clashing(docs), clashing(items))) == want
    assert ranked_search.search(no_documents(spark), items).collect() == []
    assert ranked_search.search(docs, items.limit(0)).collect() == []


# ---------------------------------------------------------------------------


def brute_collocations(docs, least, top, longest=5):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    rows = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {o[i : i + m] for o, a in candidates.items() for m in range(2, len(o)) for i in range(len(o) - m + 1) if a >= own[o[i : i + m]]}
        scored = []
        for phrase, a in candidates.items():
            cuts = [(1000 * a * totals[lang] // (own[phrase[:k]] * own[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            if phrase not in inside:
                scored.append((-score, -a, " ".join(phrase).encode(), own[phrase[:k]], own[phrase[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top]):
            rows.append((-a, left, lang, totals[lang], phrase.decode(), right, i + 1, -score))
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("least", "top", "longest"), [(3, 20, 5), (2, 2000, 5), (6, 7, 3)])
def test_phrases_as_by_counting_all(spark, least, top, longest):
    random.seed(least)
    words = ["a", "B", "of", "Éa", "the", "x-y", "中文", "z"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "?! ", " ; "]
    fixed = ["the best of a kind indeed", "Of THE best"]
    rows = []
    for _ in range(120):
        parts = [random.choice(words + fixed) + random.choice(marks) for _ in range(random.randrange(25))]
        rows.append((random.choice(["en", "de", None, "und", ""]), "".join(parts)))
    rows += [("en", None), ("en", "the best " * 50), ("en", "the best " * 50)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found = collected(collocations.collocations(docs, least=least, top=top, longest=longest))
    assert found == brute_collocations(rows, least, top, longest)


def test_collocations_of_odd_documents(spark):
    docs = odd_documents(spark)
    want = brute_collocations([(r["lang"], r["text"]) for r in docs.collect()], 2, 2000)
    assert len(want) > 10
    assert collected(collocations.collocations(docs, least=2)) == want
    assert collected(collocations.collocations(clashing(docs), least=2)) == want
    assert collocations.collocations(no_documents(spark)).collect() == []
    assert collocations.collocations(docs, least=10**6).collect() == []


def test_scores_pass_64_bits(spark):
    """1000 a n is beyond 64 bits here only as a product; the quotient is exact."""
    windows = spark.createDataFrame([(1, 2, None, None, None, 3 * 10**15)], "w1 long, w2 long, w3 long, w4 long, w5 long, n long")
    assert collocations._frequent_phrases(windows, 100, 5).collect()[0]["a"] == 3 * 10**15
    expression = "(1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    rows = spark.createDataFrame([(10**13 - 1, 10**14 - 3, 10**13 + 7, 10**13 - 1)], "a long, n long, l long, r long")
    a, n, left, right = rows.first()
    assert rows.selectExpr(f"{expression} AS s").first()["s"] == 1000 * a * n // (left * right)


# ---------------------------------------------------------------------------


def check_plan(lengths, pieces, sizes):
    covered = defaultdict(list)
    windows = defaultdict(list)
    for doc, start, length, size, number, offset in pieces:
        assert length > 0
        covered[doc].append((start, length))
        windows[size, number].append((offset, length))
    for doc, length in enumerate(lengths):
        at = 0
        for start, part in sorted(covered[doc]):
            assert start == at
            at += part
        assert at == length
    short = 0
    for (size, _), parts in windows.items():
        at = 0
        for offset, part in sorted(parts):
            assert offset == at
            at += part
        assert at <= size
        short += at < size
        assert size == sizes[-1] or at == size
    assert short <= 1
    for size in sizes:
        numbers = sorted(n for s, n in windows if s == size)
        assert numbers == list(range(len(numbers)))


def test_plans_fill_all_windows_but_one():
    random_ = np.random.default_rng(3)
    for sizes in [(4, 8, 16), (16,), packing.SIZES]:
        for _ in range(60):
            lengths = np.ceil(random_.lognormal(random_.uniform(0, 6), random_.uniform(0.1, 2), random_.integers(1, 60))).astype(np.int64)
            check_plan(lengths, packing.plan(lengths, sizes), sizes)
    assert packing.plan(np.zeros(0, np.int64)) == []


def test_whole_texts_fill_gaps_of_longer_windows_first():
    pieces = packing.plan(np.array([1500, 548, 700, 324, 256]))
    assert {(doc, size) for doc, _, _, size, _, _ in pieces} == {(0, 2048), (1, 2048), (2, 1024), (3, 1024), (4, 256)}


@pytest.mark.parametrize("group", [4000, 30])
def test_pieces_hold_each_id_once(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    library = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    pieces = packing.pack(docs, TOKENIZER, 1, step=1 << 13)
    ids = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = pieces.collect()
    for doc_id, own in ids.items():
        mine = sorted((r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows if r["doc_id"] == doc_id)
        assert [i for _, part in mine for i in part] == own
        assert [s for s, _ in mine] == [sum(len(p) for _, p in mine[:k]) for k in range(len(mine))]
    assert {r["doc_tokens"] == len(ids[r["doc_id"]]) for r in rows} == {True}
    made = [r.asDict() | {"ids": np.frombuffer(r["ids"], "<u4")} for r in packing.sequences(pieces, 0).collect()]
    sizes = {r["sequence_id"]: r["size"] for r in rows}
    assert sorted(r["sequence_id"] for r in made) == list(range(len(sizes)))
    assert all(len(r["ids"]) == sizes[r["sequence_id"]] for r in made)
    groups = -(-len(ids) // group)
    assert sum(r["n_pad"] > 0 for r in made) <= groups
    assert sum(r["n_pad"] for r in made) == sum(len(r["ids"]) for r in made) - sum(map(len, ids.values()))

    steps = defaultdict(list)
    for r in made:
        steps[r["step"]].append(len(r["ids"]))
    assert sorted(steps) == list(range(len(steps)))
    assert all(len(set(own)) == 1 and sum(own) <= 1 << 13 for own in steps.values())
    assert sum(sum(own) < 1 << 13 for own in steps.values()) <= len(set(sizes.values()))


def test_packing_odd_documents(spark):
    docs = odd_documents(spark)
    rows = packing.pack(docs, TOKENIZER, 1).collect()
    whole = {(r["doc_id"], r["doc_tokens"]) for r in rows}
    assert (1, 1) in whole and (2, 1) in whole and any(d is None for d, _ in whole)
    library = Tokenizer.from_file(TOKENIZER)
    tokens = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r["length"] for r in rows) == tokens
    assert sum(r["length"] for r in packing.pack(clashing(docs), TOKENIZER, 1).collect()) == tokens
    empty = packing.pack(no_documents(spark), TOKENIZER, 1)
    assert empty.collect() == [] and empty.columns == packing.pack(docs, TOKENIZER, 1).columns


def test_packing_query(spark):
    library = Tokenizer.from_file(TOKENIZER)
    ids = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_packing"](spark, SF_DIR).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"]
