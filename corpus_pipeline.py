"""From raw documents to token ids: five stages, each written before the next reads it.

STAGES lists them; each takes (spark, docs, sf_dir) and returns a frame. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsukiori.llm import byte_bpe, language_spans, line_windows, parity_join, wu_manber
from tsukiori.scratch import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle, and the similarity in hundredths from which texts are near duplicates.
SHINGLE, SIMILAR = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in known languages, the main one of which fills in a null ``lang``.

    Rejected are texts that are null or have no letter, and those no word of
    which has a script of a learned language. Texts of several languages stay,
    whatever the share of the main one. The model learns from the labelled documents;
    if there are none, no text with letters is rejected.
    """
    model = language_spans.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language_spans.label_spans(docs, model, keep=COLUMNS)
    kept = found.where((F.col("lang_pred") != language_spans.UNKNOWN) & F.col("fits"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of windows that occur earlier; ``n_chars`` counts what is left.

    A document that loses lines goes if nothing but white space is left.
    """
    left = line_windows.dedup_lines(docs)
    left = left.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id.

    Documents without an id or without words are in no group and stay. Rows of
    one id are one document and stay or go together.
    """
    groups = parity_join.link_groups(docs, size=SHINGLE, percent=SIMILAR)
    others = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def _words(text: Column) -> Column:
    """The words of ``wu_manber`` in a text, joined by spaces."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_join(F.regexp_extract_all(plain, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)), " ")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: a window of words, or a short item as whole lines.

    An item of fewer words than a window is a passage only where it takes up
    one or more whole lines of a document, or all of it; lines without words do
    not count.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).withColumn("words", _words(F.col("text")))
    size = F.size(F.split("words", " "))
    found = wu_manber.find_test_items(docs, items.where(size >= wu_manber.WINDOW), keep=COLUMNS)
    left = found.where(~F.col("contaminated")).select(*COLUMNS)
    short = items.where((F.col("words") != "") & (size < wu_manber.WINDOW)).select(F.col("words").alias("item_id"), "text").distinct()
    if short.isEmpty():
        return left
    found = wu_manber.find_test_items(left, short, keep=COLUMNS)
    lines = F.filter(F.transform(F.split("text", "\n"), _words), lambda line: line != "")
    body = F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))
    whole = F.exists("item_ids", lambda item: F.regexp_like(body, F.concat(F.lit("\n"), F.replace(item, F.lit(" "), F.lit("[ \n]")), F.lit("\n"))))
    return found.where(~F.coalesce(whole, F.lit(False))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the hash of the bytes they decode to."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokens = byte_bpe.encode(docs, ranks)
    return byte_bpe.decode(tokens, ranks, keep=["doc_id", "ids"]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: Rows of run() in SQL; none, because language ID and tokenization have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
