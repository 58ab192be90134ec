"""Each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsukiori.llm import (
    byte_bpe,
    collocations,
    language_spans,
    line_windows,
    multi_index,
    packing,
    parity_join,
    ranked_search,
    simple8b,
    suffix_dedup,
    weak_pii,
    wordpiece,
    wu_manber,
)
from tsukiori.llm.registry import ORACLES, QUERIES, query, table
from tsukiori.scratch import new_path

__all__ = ["ORACLES", "QUERIES"]


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's token ids, and the bytes they decode to."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokens = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks)
    return byte_bpe.decode(tokens, ranks, keep=["doc_id", "ids"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_weak_pii")
def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document."""
    found = weak_pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    return found.select(
        "doc_id",
        *[(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in weak_pii.BASE_KINDS],
        F.sha2(weak_pii.span_text(base).cast("binary"), 256).alias("base_sha256"),
        weak_pii.span_text(F.col("spans")).alias("spans"),
    )


@query("op3_simple8b")
def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in files of packed words, and their checksum as read back."""
    path = new_path(spark, "token-ids")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    simple8b.write_token_ids(table(spark, sf_dir, "documents"), path, tokenizer, end_id=2)
    return simple8b.checksums(simple8b.read_token_ids(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op4_wu_manber", """
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM documents),
item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM benchmark),
patterns AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS size,
           array_to_string(words[p:p + 9], ' ') AS pattern
    FROM item_words, unnest(range(1, greatest(len(words) - 8, 2))) AS t(p)
    WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM patterns),
places AS (
    SELECT doc_id, p, size, array_to_string(words[p:p + size - 1], ' ') AS pattern
    FROM doc_words, sizes, unnest(range(1, len(words) - size + 2)) AS t(p)),
found AS (SELECT doc_id, p, size, item_id FROM places JOIN patterns USING (size, pattern)),
hits AS (SELECT doc_id, count(DISTINCT w) AS n_hit
         FROM found, unnest(range(p, p + size)) AS t(w) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document occurs in the benchmark."""
    found = wu_manber.find_test_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op5_wordpiece")
def op5_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word-pieces of each document."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), vocabulary)


@query("op6_language_spans")
def op6_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = language_spans.train(docs.where(~held_out))
    found = language_spans.label_spans(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op7_parity_join", """
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, hash(array_to_string(w[p:p + 3], ' ')) AS s
    FROM words, unnest(range(1, greatest(len(w) - 2, 2))) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
joint AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y USING (s)
    WHERE x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
    SELECT a, b FROM joint JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * k >= 85 * (p.n + q.n - k)),
paths AS (
    WITH RECURSIVE r(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents
        UNION
        SELECT r.doc_id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END
        FROM r JOIN links l ON l.a = r.other OR l.b = r.other)
    SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN paths USING (doc_id)
""")
def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with a similarity of 0.85 or more by runs of four words."""
    return parity_join.link_groups(table(spark, sf_dir, "documents"), size=4, percent=85)


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strings of 200 bytes that occur more than once cover in each document."""
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


@query("op9_line_windows", """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
windows AS (
    SELECT doc_id, p, lines[p] AS a, lines[p + 1] AS b, lines[p + 2] AS c
    FROM docs, unnest(range(1, len(lines) - 1)) AS t(p)
    WHERE trim(lines[p] || lines[p + 1] || lines[p + 2]) <> ''),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, p + k AS line FROM ranked, unnest(range(3)) AS t(k) WHERE n > 1),
numbered AS (SELECT doc_id, i, lines[i] AS line FROM docs, unnest(range(1, len(lines) + 1)) AS t(i)),
kept AS (
    SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) FILTER (WHERE g.line IS NULL) AS text,
           count(*) AS n_lines, count(g.line) AS n_removed
    FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.line GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM docs d LEFT JOIN kept k USING (doc_id)
""")
def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without the lines of repeated windows."""
    left = line_windows.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "text", "n_lines", "n_removed")


@query("op10_multi_index")
def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


@query("op11_ranked_search", """
WITH own AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM documents),
sizes AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM own GROUP BY doc_id),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark),
tf AS (
    SELECT doc_id, term, count(*) AS tf FROM own
    WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
added AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS score
    FROM tf JOIN sizes USING (doc_id) JOIN weights USING (term), totals),
scores AS (
    SELECT item_id, doc_id, CAST(sum(score) AS BIGINT) AS score
    FROM wanted JOIN added USING (term) GROUP BY item_id, doc_id),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that match each benchmark item best."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


@query("op12_collocations", """
WITH pieces AS (
    SELECT lang, i, string_split_regex(piece, '[ \\t]+') AS split
    FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS i,
                 unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
          FROM documents)),
words AS (SELECT lang, list_filter(split, lambda w: w <> '') AS w FROM pieces),
phrases AS (
    SELECT lang, size, array_to_string(w[p:p + size - 1], ' ') AS phrase, CAST(count(*) AS BIGINT) AS a
    FROM words, range(1, 6) AS s(size), unnest(range(1, len(w) - size + 2)) AS t(p)
    GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM phrases WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM phrases WHERE size > 1 AND a >= 100),
cuts AS (
    SELECT c.lang, c.phrase, c.a, k, f.a AS l, b.a AS r, n,
           CAST((1000 * CAST(c.a AS HUGEINT) * n) // (CAST(f.a AS HUGEINT) * b.a) AS BIGINT) AS score
    FROM candidates c, unnest(range(1, size)) AS t(k), totals, phrases f, phrases b
    WHERE totals.lang = c.lang AND f.lang = c.lang AND b.lang = c.lang
      AND f.phrase = array_to_string(w[1:k], ' ') AND b.phrase = array_to_string(w[k + 1:], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
inside AS (
    SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN (
        SELECT lang, a, array_to_string(w[p:p + m - 1], ' ') AS phrase
        FROM candidates, unnest(range(2, size)) AS t(m), unnest(range(1, size - m + 2)) AS u(p)) o
    ON s.lang = o.lang AND s.phrase = o.phrase AND 100 * o.a >= 100 * s.a),
ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank,
           phrase, a, l, r, n, score
    FROM lowest ANTI JOIN inside USING (lang, phrase) WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language that are more than their words suggest."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in training sequences."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer, end_id=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
