"""Small tables with what an operator must cope with."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the quick brown fox jumps over a lazy dog while rain falls on old roofs near quiet river banks".split()


def odd_documents(spark, more: str = ""):
    """Nulls in every column, empty, blank and long texts, repeated rows, other scripts."""
    long = " ".join(WORDS[i * i % len(WORDS)] for i in range(3000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, "a", 4),
        (4, long, "en", None, len(long)),
        (4, long, "en", None, len(long)),
        (5, "x" * 700, "en", "b", 700),
        (None, "a text without an id", "en", "b", 20),
        (6, "Füße größer, ¡niño! 中文字 и русский текст 😀", "de", "b", 41),
        (7, "one\r\ntwo\r\nthree\r\none\r\ntwo\r\nthree", "en", "c", 30),
        (8, "the the the the the the the the", "en", "c", 31),
        (9, "...!!! 12345 ???", None, "c", 16),
        (10, long[:400], "en", "c", 400),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """The same documents with columns named as operators name theirs."""
    names = ["id", "key", "n", "spans", "ids", "n_words", "n_tokens", "place", "state", "doc", "pos", "first", "copy", "rep", "word", "k0"]
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(i))
    return docs


def collected(frame) -> list[tuple]:
    """All rows, columns by name, in an order of their own."""
    names = sorted(frame.columns)
    return sorted((tuple(row[name] for name in names) for row in frame.collect()), key=repr)
