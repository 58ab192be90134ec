"""Column types of text tables, found from all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: an integer cell, or with the fraction a decimal one; all else is text.
NUMBER_PATTERN = r"-?\d+(?:\.\d+)?"

# From narrow to wide. The type of a column is the widest one among its cells.
TYPES = ("INT", "BIGINT", "DOUBLE", "STRING")

# What an integer column needs to stay exact beside decimals: a DOUBLE holds this many digits.
_DOUBLE_DIGITS = 15


def _cell_rank(cell: Column) -> Column:
    """What a column's type depends on, by cell: null for a blank, else a number.

    0 and 1: an integer for INT and BIGINT; 2: one for BIGINT that a DOUBLE would
    round; 4: a decimal; 8: text. The pattern is tried once a cell.
    """
    digits = F.octet_length(cell) - cell.startswith("-").cast("int")  # of an integer
    whole = F.when(digits <= 9, 0).when(digits <= _DOUBLE_DIGITS, 1).when(digits <= 18, 2).otherwise(8)
    number = cell.rlike(rf"\A{NUMBER_PATTERN}\z")
    return F.when(cell != "", F.when(~number, 8).when(cell.contains("."), 4).otherwise(whole))


def infer_column_types(df: DataFrame) -> DataFrame:
    """``(position, column, type)`` for every column of a frame of texts.

    All rows have a say. Blanks say nothing about a type; a column of blanks is
    text, and so is one of decimals and integers of more than 15 digits, which a
    DOUBLE would round. One global aggregate finds all columns in one pass,
    without a row per cell.
    """
    # Ranks first, then their aggregate: the code generated for both in one was half as fast.
    cells = df.select(*[_cell_rank(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    ranks = cells.agg(*[F.bit_or(c).alias(c) for c in cells.columns])

    def type_of(seen: Column) -> Column:
        def has(bit: int) -> Column:
            return seen.bitwiseAND(F.lit(bit)) > 0

        return (
            F.when(seen.isNull() | has(8) | (has(4) & has(2)), TYPES[3])
            .when(has(4), TYPES[2])
            .when(has(1) | has(2), TYPES[1])
            .otherwise(TYPES[0])
        )

    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            type_of(F.col(f"_{i}")).alias("type"),
        )
        for i, c in enumerate(df.columns)
    ]
    return ranks.select(F.inline(F.array(*entries)))
