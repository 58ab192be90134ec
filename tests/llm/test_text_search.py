"""Test-item search, language spans and line windows."""

import itertools
import random
import re

import numpy as np
import pytest

from tests.llm.rows import WORDS, clashing, collected, no_documents, odd_documents
from tests.oracle import connect
from tsukiori.llm import language_spans, line_windows, queries, wu_manber

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF_DIR)
    found = connect(SF_DIR).execute(queries.ORACLES[name])
    names = [column[0] for column in found.description]
    assert sorted(names) == sorted(frame.columns)
    order = [names.index(n) for n in sorted(names)]
    assert collected(frame) == sorted((tuple(row[i] for i in order) for row in found.fetchall()), key=repr)


def brute_items(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[i : i + size]:
                    hit.update(range(at, at + size))
                    found.add(name)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_items_are_found_as_by_comparison(spark, block_bytes):
    random.seed(4)
    few = ["a", "b", "ab", "É", "x1"]
    texts = [" ".join(random.choice(few) for _ in range(random.randrange(30))) for _ in range(60)] + [None, "", "A-b. AB", "b" * 300]
    items = [(str(i), " ".join(random.choice(few) for _ in range(random.choice([1, 2, 4, 6])))) for i in range(14)] + [("9", None), ("n", "..")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    rows = wu_manber.find_test_items(docs, benchmark, window=4, block_bytes=block_bytes).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = brute_items(texts[row["doc_id"]], items, 4)
        assert (row["n_words"], row["n_hit"], row["item_ids"]) == want
        assert row["contaminated"] == (want[1] > 0)


def test_odd_documents_and_items(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "rain falls on old"), (None, "TEXT without an"), (1, "the the the"), (3, None)], "item_id long, text string")
    rows = wu_manber.find_test_items(docs, items)
    assert rows.count() == docs.count()
    assert {tuple(r["item_ids"]) for r in rows.where("doc_id IS NULL OR doc_id = 8").collect()} == {("null",), ("1",)}
    assert collected(rows) == collected(wu_manber.find_test_items(clashing(docs), clashing(items)))
    assert wu_manber.find_test_items(no_documents(spark), items).collect() == []
    none = wu_manber.find_test_items(docs, items.limit(0))
    assert not none.where("contaminated").collect() and none.count() == docs.count()


# ---------------------------------------------------------------------------


def test_viterbi_finds_the_best_of_all_paths():
    random_ = np.random.default_rng(1)
    for _ in range(150):
        lengths = random_.integers(0, 6, 4)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        scores = random_.integers(-6, 1, (bounds[-1], 3)).astype(np.float32)
        label = language_spans.viterbi(scores, bounds, 2.0)

        def total(path, part):
            return sum(part[i, s] for i, s in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))

        for a, b in itertools.pairwise(bounds):
            part = scores[a:b]
            best = max((total(p, part) for p in itertools.product(range(3), repeat=int(b - a))), default=0)
            assert total(label[a:b], part) == best


def test_languages_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = [r for r in queries.QUERIES["op6_language_spans"](spark, SF_DIR).collect() if r["held_out"]]
    assert len(rows) > 20
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) >= 0.95


def test_spans_of_mixed_texts(spark):
    english, german = "the house and the garden of the old man with the dog", "der Hund und die Katze auf dem Dach von der Straße"
    russian = "собака и кошка в саду у старого дома"
    rows = [(i, t, n) for i, (t, n) in enumerate([(english, "en"), (german, "de"), (russian, "ru")] * 5)]
    model = language_spans.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = f"{english}. {german}! {russian}"
    got = language_spans.label_spans(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in got["spans"]] == ["en", "de", "ru"]
    assert [mixed[s["start"] : s["end"]] for s in got["spans"]] == [english, german, russian]
    assert got["lang_pred"] == "ru" and 0.3 < got["score"] < 0.6


def test_rare_languages_are_learned_and_copies_count_once(spark):
    rows = [(f"the house number {i} and the garden", "en") for i in range(400)] + [("der Hund und die Katze", "de")]
    once = language_spans.train(spark.createDataFrame(rows, "text string, lang string"), sample=20)
    copies = [("a very common text", "en")] * 300 + [("der Hund und die Katze", "de")] * 50
    more = language_spans.train(spark.createDataFrame(rows[:10] + copies, "text string, lang string"), sample=100)
    single = language_spans.train(spark.createDataFrame([*rows[:10], *dict.fromkeys(copies)], "text string, lang string"), sample=100)
    assert once.languages == more.languages == ["de", "en"]
    assert np.array_equal(more.weights, single.weights)


def test_odd_documents_have_a_language(spark):
    docs = odd_documents(spark)
    model = language_spans.train(docs)
    rows = language_spans.label_spans(docs, model)
    assert rows.count() == docs.count()
    unknown = rows.where("lang_pred = 'und'").collect()
    assert {r["doc_id"] for r in unknown} == {1, 2, 3, 9} and all(r["score"] == 0 and r["spans"] == [] for r in unknown)
    assert collected(rows) == collected(language_spans.label_spans(clashing(docs), model))
    assert language_spans.label_spans(no_documents(spark), model).collect() == []
    nothing = language_spans.train(no_documents(spark))
    assert {r["lang_pred"] for r in language_spans.label_spans(docs, nothing).collect()} == {"und"}


# ---------------------------------------------------------------------------


def brute_lines(texts):
    seen, out = set(), []
    for text in texts:
        lines = (text or "").split("\n") if text is not None else []
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if "".join(window).strip(" ") == "":
                continue
            if window in seen:
                gone.update(range(i, i + 3))
            seen.add(window)
        out.append((text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out


def test_windows_go_as_by_comparison(spark):
    random.seed(6)
    texts = ["\n".join(random.choice(["a", "b", "c d", "", " "]) for _ in range(random.randrange(14))) for _ in range(80)] + [None, "", "\n\n\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = line_windows.dedup_lines(docs).orderBy("doc_id").collect()
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in rows] == brute_lines(texts)


def test_windows_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = line_windows.dedup_lines(docs)
    assert rows.count() == docs.count() and rows.columns == [*docs.columns, "n_lines", "n_removed"]
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "x\na\nb\nc")], "doc_id long, text string")
    left = {(r["doc_id"], r["text"]) for r in line_windows.dedup_lines(twice).collect()}
    assert left == {(None, "a\nb\nc"), (1, ""), (2, "x")}
    assert line_windows.dedup_lines(no_documents(spark)).collect() == []
    names = [c for c in rows.columns]
    assert collected(rows) == collected(line_windows.dedup_lines(clashing(docs)).select(*names))


def test_long_words_do_not_matter_to_windows(spark):
    text = "\n".join([" ".join(WORDS)] * 2000)
    row = line_windows.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_lines"], row["n_removed"], row["text"]) == (2000, 1999, " ".join(WORDS))
