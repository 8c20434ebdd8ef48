"""Column expressions on text that several native operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = r"[\x20\x09-\x0D]+"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased; the JVM's quick form where the text is plain ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def trimmed(parts: Column) -> Column:
    """What split() gives without the empty strings at its ends; parts must be a plain column."""
    first = (F.get(parts, F.lit(0)) == "").cast("int")
    last = ((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == "")).cast("int")
    return F.slice(parts, first + 1, F.size(parts) - first - last)


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def packed(df: DataFrame, replaced: tuple[str, ...], shared: bool = False, **columns: str) -> tuple[DataFrame, list[Column]]:
    """df with the columns named by keyword, and all of its columns apart from these in a struct `row_`.

    Whatever a user's columns are called, they don't meet those of an operator;
    the second result takes them out of row_ again.  Columns that are called as
    one of an operator's results (`replaced`) are left out.  With shared, a column
    that is named by keyword isn't in row_ as well, so the operator must leave it as it is.
    """
    kept = [c for c in df.columns if c not in replaced]
    named = {c: name for name, c in columns.items()} if shared else {}
    row = F.struct(F.lit(0).alias("n"), *(df[c].alias(f"c{i}") for i, c in enumerate(kept) if c not in named))
    out = df.select(row.alias("row_"), *(df[c].alias(name) for name, c in columns.items()))
    return out, [F.col(named[c]).alias(c) if c in named else F.col("row_")[f"c{i}"].alias(c) for i, c in enumerate(kept)]
