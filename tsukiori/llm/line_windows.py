"""Line dedup by overlapping windows of three lines, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsukiori.scratch import stage

#: Consecutive lines that make up a window.
WINDOW = 3


def _of_lines(text: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the lines of a text, which is split once."""
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), use), F.lit(0))


def _windows(lines: Column, window: int) -> Column:
    """Position and hash of each window that is not blank. Two hashes: 128 bits."""

    def at(i: Column) -> Column:
        own = [F.get(lines, i + k) for k in range(window)]
        blank = F.trim(F.concat(*own)) == ""
        return F.when(~blank, F.struct(
            i.cast("int").alias("pos"),
            F.xxhash64(*own).alias("h1"),
            F.xxhash64(F.lit("second"), *own).alias("h2"),
        ))

    positions = F.when(F.size(lines) >= window, F.sequence(F.lit(0), F.size(lines) - window))
    return F.filter(F.transform(positions, at), lambda w: w.isNotNull())


def dedup_lines(
    docs: DataFrame, *, order: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """The documents without the lines of windows that occur earlier.

    Lines are what line feeds separate. A window is ``window`` consecutive lines
    of a document, not all blank. Windows of equal lines are one group; its
    first, by document and line, stays, and each line that any later one covers
    goes. Windows may overlap, and all are judged on the input.

    Returns all columns, ``text`` being what is left, and ``n_lines``,
    ``n_removed`` (long). Input columns of these names are replaced.

    Null and empty texts have no window and stay as they are; an empty text is
    one line. Documents that share ``order`` are taken in order of a hash of
    their text; rows that also share the text are one document, and each gets
    its result. A null ``order`` comes first. Documents of which all lines go
    keep their row, with an empty text.

    Windows meet by their 128-bit hash. The first of a group is taken before the
    shuffle, so that a window in a third of all documents costs a row a task.
    The groups are written as a table; the windows join it by a plain equi-join,
    of which adaptive execution splits the hot keys.
    """
    own = F.col(f"`{text}`")
    key = F.struct(
        F.col(f"`{order}`").alias("id"),
        F.xxhash64(own).alias("t1"),
        F.xxhash64(F.lit("second"), own).alias("t2"),
    )
    windows = F.explode(_of_lines(own, lambda lines: _windows(lines, window))).alias("w")
    found = docs.select(key.alias("doc"), windows).select("doc", "w.*")
    place = F.struct("doc", "pos")
    repeated = stage(
        found.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("h1", "h2", "first"),
        "line-windows",
    )
    later = (
        found.join(repeated, ["h1", "h2"])
        .where(place > F.col("first"))
        .groupBy(F.col("doc").alias("__doc"))
        .agg(F.collect_set("pos").alias("__later"))
    )
    covered = F.transform("__later", lambda p: F.sequence(p, p + (window - 1)))
    marked = docs.withColumn("__doc", key).join(
        later.select("__doc", F.array_distinct(F.flatten(covered)).alias("__gone")), "__doc", "left"
    )
    gone = F.col("__gone")

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    outputs = {
        text: F.when(gone.isNull(), own).otherwise(_of_lines(own, rest)),
        "n_lines": F.coalesce(_of_lines(own, F.size), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
    }
    kept = [c for c in docs.columns if c == text or c.lower() not in outputs]
    return marked.select(
        *[outputs[c].alias(c) if c == text else F.col(f"`{c}`") for c in kept],
        *[column.alias(name) for name, column in outputs.items() if name != text],
    )
