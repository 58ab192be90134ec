"""Near duplicates, repeated byte strings, nearest vectors and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.rows import WORDS, clashing, collected, no_documents, odd_documents
from tsukiori.llm import anchors, language_spans, multi_index, parity_join, suffix_dedup, suffixes
from tsukiori.llm import textbytes as tb
from tsukiori.scratch import stage


def sets_of(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_groups(rows, size, percent):
    sets = [(i, sets_of(t, size)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                one, other = sorted((find(i), find(j)))
                root[other] = one
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def edited(words, changes):
    words = list(words)
    for _ in range(changes):
        at = random.randrange(len(words))
        words[at : at + random.randrange(2)] = [f"w{random.randrange(1000)}"] * random.randrange(2)
        words = words or ["w"]
    return words


@pytest.mark.parametrize(("size", "percent", "crowd"), [(4, 85, 24), (5, 80, 2), (2, 60, 4)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, size, percent, crowd):
    monkeypatch.setattr(parity_join, "CROWD", crowd)
    monkeypatch.setattr(parity_join, "BLOCK", 3)
    random.seed(size)
    passage = [random.choice(WORDS) for _ in range(25)]
    texts = []
    for length in (1, 3, 5, 8, 12, 20, 40, 90, 300):
        for _ in range(3):
            base = [random.choice(WORDS) + str(random.randrange(60)) for _ in range(length)]
            texts += [base, base, *(edited(base, random.randrange(1 + length // 6)) for _ in range(5)), base[: length // 2] + passage]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = parity_join.link_groups(docs, size=size, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows, size, percent)


def test_chains_are_one_group(spark):
    words = [f"w{i}" for i in range(260)]
    rows = [(100 - k, " ".join(words[3 * k : 3 * k + 200])) for k in range(20)]  # neighbours are similar, the ends are not
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in parity_join.link_groups(docs).collect()} == {81}


def test_similar_sets_share_a_key():
    random_ = np.random.default_rng(2)
    grid = parity_join.bands(85)
    for _ in range(300):
        size = int(random_.integers(1, 400))
        one = np.unique(random_.integers(0, 2**63, size, dtype=np.uint64))
        many = int(0.0811 * 2 * size)
        gone = int(random_.integers(0, many // 2 + 1))
        other = np.unique(np.concatenate([one[gone:], random_.integers(0, 2**63, gone, dtype=np.uint64)]))
        both = len(np.intersect1d(one, other))
        if 100 * both < 85 * (len(one) + len(other) - both) or len(one) == both == len(other):
            continue
        for bands, rounds in ((grid, range(64)), (parity_join.fine(grid), range(64, 65))):
            keys = [parity_join.keys(parity_join.Sets(x, np.array([0, len(x)])), bands, rounds) for x in (one, other)]
            common = set(keys[0].key.tolist()) & set(keys[1].key.tolist())
            assert common
            for found in keys:  # as many more as can be ignored for a band
                spare = [s for k, s in zip(found.key.tolist(), found.spare.tolist()) if k in common]
                assert len(common) > min(spare)


def test_sketches_have_few_keys():
    """Not many more than the bound asks for, and nearly all of one sketch, at a similarity with a small margin too."""
    random_ = np.random.default_rng(5)
    made = [np.unique(random_.integers(0, 2**63, n, dtype=np.uint64)) for n in random_.integers(50, 1500, 300)]
    sets = parity_join.Sets(np.concatenate(made), np.cumsum([0, *map(len, made)]))
    for percent, most in ((80, 0.42), (85, 0.3)):
        grid = parity_join.bands(percent)
        for found in (parity_join.keys(sets, grid), parity_join.keys(sets, parity_join.fine(grid), range(64, 65))):
            assert len(found.key) < most * len(sets.hashes)


def test_a_large_group_of_near_copies_needs_no_second_sketch(spark, monkeypatch):
    """Its keys are crowded, but comparing with the first of each makes it one component."""
    again = []
    monkeypatch.setattr(parity_join, "CROWD", 4)
    monkeypatch.setattr(parity_join, "_keyed_again", lambda contents, grid, f=parity_join._keyed_again: again.append(contents.count()) or f(contents, grid))
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base[: 3 * k], f"x{k}", *base[3 * k + 1 :]])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = parity_join.link_groups(docs, size=5, percent=80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows, 5, 80)
    assert sum(again) == 0


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """Every key is crowded, those of the second sketch too."""
    monkeypatch.setattr(parity_join, "CROWD", 0)
    monkeypatch.setattr(parity_join, "BLOCK", 3)
    random.seed(100)
    rows = []
    for length in (5, 20, 90, 300):
        base = [random.choice(WORDS) + str(random.randrange(60)) for _ in range(length)]
        rows += [(len(rows) + k, " ".join(edited(base, random.randrange(1 + length // 6)))) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = parity_join.link_groups(docs, size=5, percent=80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows, 5, 80)


def test_language_counts_come_as_arrow(spark, monkeypatch):
    """As rows they would fill the driver: there is one for each language and feature."""
    docs = spark.createDataFrame([("the house", "en"), ("das Haus", "de"), ("дом", "ru"), ("no language", None)], "text string, lang string")
    for name in ("toPandas", "collect"):
        monkeypatch.setattr(type(docs), name, lambda self: pytest.fail("rows in the driver"))
    assert language_spans.train(docs).languages == ["de", "en", "ru"]
    assert language_spans.train(docs.limit(0)).languages == []


def test_odd_documents_have_groups(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.dropDuplicates().collect()]
    got = parity_join.link_groups(docs)
    assert got.count() == docs.count()
    assert sorted(set(map(tuple, got.collect())), key=repr) == brute_groups(rows, 4, 85)
    assert collected(got) == collected(parity_join.link_groups(clashing(docs)))
    assert parity_join.link_groups(no_documents(spark)).collect() == []
    shared = spark.createDataFrame([(5, "a b c d"), (5, "e f g h"), (2, "e f g h"), (7, "a b c d")], "doc_id long, text string")
    assert {r["component_id"] for r in parity_join.link_groups(shared).collect()} == {2}


# ---------------------------------------------------------------------------


def brute_spans(texts, window):
    blobs = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + window] for b in blobs for i in range(len(b) - window + 1))
    out = []
    for blob in blobs:
        gone = np.zeros(len(blob), bool)
        for i in range(len(blob) - window + 1):
            if counts[blob[i : i + window]] > 1:
                gone[i : i + window] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(b for b, g in zip(blob, gone, strict=True) if not g)
        out.append((len(blob), [tuple(map(int, e)) for e in edges.reshape(-1, 2)], kept))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefghij é"])
def test_spans_are_those_of_all_windows(spark, letters):
    random.seed(len(letters))
    pool = ["".join(random.choice(letters) for _ in range(random.randrange(20, 400))) for _ in range(12)]
    texts = [None, "", "a" * 150, "ab" * 90]
    for _ in range(60):
        text = "".join(random.choice(pool)[random.randrange(15) :][: random.randrange(120)] for _ in range(random.randrange(6)))
        texts.append(text + random.choice(["", "".join(random.choice(letters) for _ in range(50))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = suffix_dedup.repeated_spans(docs, window=40)
    rows = {r["doc_id"]: r for r in found.collect()}
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.without_spans(docs.join(found, "doc_id")).collect()}
    assert len(rows) == len(texts)
    for i, (size, spans, rest) in enumerate(brute_spans(texts, 40)):
        assert (rows[i]["n_bytes"], [tuple(s) for s in rows[i]["spans"]], kept[i]) == (size, spans, rest)
        assert rows[i]["kept_sha256"] == hashlib.sha256(rest).hexdigest()


def test_odd_documents_have_spans(spark):
    docs = odd_documents(spark)
    texts = [r["text"] for r in docs.collect()]
    got = suffix_dedup.repeated_spans(docs)
    want = sorted((n, tuple(s), hashlib.sha256(k).hexdigest()) for n, s, k in brute_spans(texts, 200))
    assert sorted((r["n_bytes"], tuple(map(tuple, r["spans"])), r["kept_sha256"]) for r in got.collect()) == want
    assert collected(got) == collected(suffix_dedup.repeated_spans(clashing(docs)))
    assert suffix_dedup.repeated_spans(no_documents(spark)).collect() == []


def test_equal_windows_have_equal_anchors():
    random_ = np.random.default_rng(3)
    rolling = tb.Rolling(20)
    for _ in range(100):
        data = random_.integers(97, 100, 120).astype(np.uint8)
        offsets = np.array([0, 50, 50, 120])
        found = anchors.find(rolling, rolling.prefix(data), offsets, 12, 4)
        where = {}
        for at, first, last in zip(found.at, found.first, found.last, strict=True):
            for start in range(first, last + 1):
                window = data[start : start + 12].tobytes()
                assert where.setdefault(window, at - start) == at - start
        assert sum(found.last - found.first + 1) == (50 - 11) + (70 - 11)


def test_multikey_order_is_the_lexical_order():
    random_ = np.random.default_rng(4)
    words = [random_.integers(0, 4, 500) for _ in range(4)]
    order = suffixes.multikey_order(words)
    rows = list(zip(*(w[order].tolist() for w in words), strict=True))
    assert rows == sorted(rows)


def test_repeats_across_buckets(spark):
    """More equal suffixes than a bucket holds, and pairs that a bound may part."""
    rows = [(5, 5, 5, i, 0, i) for i in range(500)] + [(i + 6, i, i // 2, i, 1, 0) for i in range(300)] + [(7000 + i // 2, 1, 1, i, 2, 0) for i in range(200)]
    table = spark.createDataFrame(rows, suffixes.SCHEMA)
    found = suffixes.repeated(table, "test").groupBy("copy").count().collect()
    assert {r["copy"]: r["count"] for r in found} == {0: 500, 2: 200}


def test_buckets_follow_the_number_of_suffixes(spark, monkeypatch):
    """As many as are needed for buckets of bounded size, with the same result."""
    rows = [(5, 5, 5, i, 0, i) for i in range(300)] + [(i // 2, i // 2, 1, i, 1, 0) for i in range(200)]
    table = spark.createDataFrame(rows, suffixes.SCHEMA)

    def found():  # states 2 and 3 both say that all is equal; which row stands for others is free
        return sorted((r["copy"], r["id"], r["state"] > 1) for r in suffixes.repeated(table, "test").collect())

    whole, sizes = found(), []
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 20)
    monkeypatch.setattr(suffixes, "stage", lambda df, name: sizes.append(df.rdd.getNumPartitions()) or stage(df, name))
    assert found() == whole
    assert len(whole) == 500
    assert sizes == [25]


# ---------------------------------------------------------------------------


def vectors_of(spark, count, size=24):
    random_ = np.random.default_rng(8)
    data = random_.normal(size=(count, size)).astype(np.float32)  # four of them alike
    data[count // 2 : count // 2 + 4] = data[0]
    odd = [(9001, None, 0), (9002, [0.0] * size, 0), (9003, [float("nan")] + [1.0] * (size - 1), 0), (9004, [None] + [1.0] * (size - 1), 0),
           (9005, [float("inf")] + [1.0] * (size - 1), 0), (9006, [], 0), (9007, [1.0], 0), (None, [1.0] * size, 0)]
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(data)]
    return data.astype(float), spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>, id long")


def test_nearest_vectors(spark):
    data, frame = vectors_of(spark, 1500)
    found = multi_index.nearest(frame, frame.where("vec_id % 20 = 0"), 20).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 20))
    recall = []
    for query, rows in got.items():
        scores = (data * data[query]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(len(data)), -scores)) if i != query][:20]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(abs(r[2] - scores[r[1]]) < 1e-12 for r in rows)
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        recall.append(len({r[1] for r in rows} & set(want)) / 20)
    assert np.mean(recall) >= 0.9


def test_few_vectors(spark):
    _, frame = vectors_of(spark, 6)
    rows = multi_index.nearest(frame, frame.where("vec_id = 3"), 20).collect()
    assert sorted(r["vec_id"] for r in rows) == [0, 1, 2, 4, 5]
    assert multi_index.nearest(frame.limit(0), frame, 20).collect() == []
    assert multi_index.nearest(frame, frame.limit(0), 20).collect() == []


def test_vectors_of_one_id_and_of_other_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.1, 0.2]), (2, [0.9, 0.0]), (2, [0.9, 0.0]), (3, [0.5, 0.5, 0.5]), (4, [1.0, 0.0, 0.0]), (None, [5.0, 5.0]), (5, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = multi_index.nearest(frame, frame.where("vec_id IN (1, 4)"), 20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 1, 2, 0.9), (1, 2, 2, 0.1), (4, 1, 3, 0.5)]
    own = multi_index.nearest(frame, frame.where("vec_id = 2"), 20).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in own) == [(1, 1, 0.1), (1, 1, 0.9), (2, 2, 0.09000000000000001), (2, 2, 0.09000000000000001)]


def test_probing_finds_all_codes_within_a_radius():
    random_ = np.random.default_rng(9)
    codes = random_.integers(0, 2**64, 3000, dtype=np.uint64)
    codes[:300] = codes[0] ^ (np.uint64(1) << random_.integers(0, 64, 300).astype(np.uint64))
    index = multi_index.Index(codes)
    for radius in (0, 1, 5, 9, 22, 31, 64):
        for code in codes[:3]:
            assert index.within(code, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ code) <= radius).tolist()


# ---------------------------------------------------------------------------


def test_pipeline_on_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    docs.limit(0).select("doc_id", "text").withColumnRenamed("doc_id", "item_id").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, no_documents(spark)):
        made = start
        for name, work in corpus_pipeline.STAGES[:-1]:
            made = work(spark, made, str(tmp_path))
            assert made.columns == list(corpus_pipeline.COLUMNS), name
        rows = corpus_pipeline.STAGES[-1][1](spark, made, str(tmp_path)).collect()
        texts = {r["doc_id"]: r["text"] for r in made.collect()}
        assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)
    assert {4, 6, 8} <= {r["doc_id"] for r in made.collect()} or made.isEmpty()


def test_pipeline_keeps_texts_of_several_languages(spark, tmp_path):
    english, german = "the house and the garden of the old man with the dog", "der Hund und die Katze auf dem Dach von der Straße"
    russian = "собака и кошка в саду у старого дома"
    texts = [(english, "en"), (german, "de"), (russian, "ru")] * 5 + [(f"{english}. {german}! {russian}", None), ("สวัสดีชาวโลก ภาษาไทย", None), ("12 34", None)]
    docs = spark.createDataFrame([(i, t, n, "a", len(t)) for i, (t, n) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()}
    assert set(kept) == set(range(16)) and kept[15] == "ru"


def test_pipeline_drops_short_items_as_whole_lines_only(spark, tmp_path):
    long = "one two three four five six seven eight nine ten eleven"
    items = [(1, "yes"), (2, "The answer is"), (3, long), (4, None), (5, "..."), (6, "What is\n2+2?"), (7, "ÉTÉ")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = ["oh yes, I think so", "the answer is 7\nyes it is", "one two three four five six seven eight nine", "we ask what is 2+2? here", "an été", None, "...", "yes/no"]
    gone = ["Yes!", "a line\n yes. \r\nmore", "the Answer is:", f"so {long} follow", "a\nwhat is\n2+2?\nb", "x\nWhat is 2+2?", "ÉTÉ\nb", "the\n--\nanswer is"]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(kept + gone)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(len(kept)))


def test_pipeline_keeps_what_brute_force_keeps(spark):
    """On a given table: no contaminated document stays, no two near duplicates, and clean ones do."""
    sf_dir = "/root/testdata/sf0.001"
    source = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = docs
    for _, work in corpus_pipeline.STAGES[:2]:
        left = work(spark, left, sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    groups = {i: root for i, _, root in brute_groups(rows, 5, 80)}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))

    windows = {tuple(w[i : i + 10]) for w in map(words, items) for i in range(max(1, len(w) - 9))}
    clean = {
        i for i, text in rows
        if groups[i] == i and not any(tuple(words(text)[k : k + 10]) in windows for k in range(len(words(text))))
    }
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == clean
    assert len(clean) > 0.8 * len(source)
