"""Scans along a vehicle's time in two levels, so that a busy vehicle is spread over tasks.

Rows are dealt to (key, time bucket).  Within a bucket a window does the work;
over a key's buckets, of which each is one row, a window carries what must be
known from before: the last row, counts, or a map of what comes in to what goes
out.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.session import shared_dir

#: Seconds of a bucket.
DAY = 86_400
#: Rows of a key that a task takes at once, in one bucket, as calls per bucket cost more than so few rows.
WHOLE = 10_000


class Buckets:
    """Rows in (key, bucket), and one row for each bucket with what its own rows say (`ends`)."""

    def __init__(self, df: DataFrame, key: str, at: str, ties: list[str], width: int = DAY) -> None:
        self.df = df.withColumn("_b", F.floor(F.col(at) / width))
        self.key = key
        self.within = Window.partitionBy(key, "_b").orderBy(at, *ties)
        self.over = Window.partitionBy(key).orderBy("_b")
        self.earlier = self.over.rowsBetween(Window.unboundedPreceding, -1)

    def carried(self, rows: DataFrame, said: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
        """rows with the columns of carry: expressions over a key's buckets (self.over, self.earlier) of what each says."""
        some = rows.groupBy(self.key, "_b").agg(*(c.alias(n) for n, c in said.items()))
        known = some.select(F.col(self.key).alias("_k"), F.col("_b").alias("_kb"), *(c.alias(n) for n, c in carry.items()))
        return rows.join(known, F.col(self.key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")), "left").drop("_k", "_kb")


def sessions(df: DataFrame, key: str, at: str, ties: list[str], gap: float, width: int = DAY) -> DataFrame:
    """Adds before (seconds since the key's last row, null for the first), session (from 1) and place (rows of the key before).

    A session ends where the next row comes more than gap seconds later.
    """
    b = Buckets(df, key, at, ties, width)
    local = F.col(at) - F.lag(at).over(b.within)
    rows = b.df.withColumns({"_gap": local, "_n": F.row_number().over(b.within)})
    rows = rows.withColumn("_new", F.sum(F.coalesce((F.col("_gap") > gap).cast("int"), F.lit(0))).over(b.within.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.lag("_last").over(b.over)
    opens = F.when(F.coalesce(F.col("_first") - last, F.lit(gap + 1)) > gap, 1).otherwise(0)
    # Whether a bucket opens a session is known from the bucket before, and how many it opens in all after that.
    some = rows.groupBy(key, "_b").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.max("_new").alias("_inner"), F.count("*").alias("_rows"))
    some = some.withColumns({"_before_last": last, "_opens": opens})
    known = some.select(
        F.col(key).alias("_k"), F.col("_b").alias("_kb"), "_before_last", "_opens",
        F.coalesce(F.sum(F.col("_inner") + F.col("_opens")).over(b.earlier), F.lit(0)).alias("_sessions"), F.coalesce(F.sum("_rows").over(b.earlier), F.lit(0)).alias("_count"),
    )
    out = rows.join(known, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return out.select(
        *df.columns, F.coalesce("_gap", F.col(at) - F.col("_before_last")).alias("before"), (F.col("_sessions") + F.col("_opens") + F.col("_new")).alias("session"),
        (F.col("_count") + F.col("_n") - 1).alias("place"),
    )


def saved(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def three_passes(
    df: DataFrame, key: str, at: str, width: int, first: Callable[[pa.Table], pa.Table], summary: str, over: Callable[[pa.Table], pa.Table], carry: str, last: Callable[[pa.Table], pa.Table], out: str
) -> DataFrame:
    """A fold along each key's time that windows can't express, with a busy key spread over tasks.

    first turns a bucket's rows into one row of what the bucket does to whatever
    comes in (_b and `summary`), over turns a key's summaries into what comes into
    each bucket (_b and `carry`), and last goes over a bucket's rows again, which
    have the columns of carry, to give `out`.  Tables are not ordered.  A task
    holds the rows of one bucket, or one row for each bucket of a key.  A key of
    WHOLE rows at most has one bucket, that of its first row.
    """
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_size"), F.min(at).alias("_first_at"))
    rows = df.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_b", F.floor(F.when(F.col("_size") <= WHOLE, F.col("_first_at")).otherwise(F.col(at)) / width)).select(*df.columns, "_b")
    kind = df.schema[key].dataType.simpleString()
    some = rows.groupBy(key, "_b").applyInArrow(first, f"{key} {kind}, _b long, {summary}")
    known = some.groupBy(key).applyInArrow(over, f"{key} {kind}, _b long, {carry}")
    known = known.withColumnsRenamed({key: "_k", "_b": "_kb"})
    both = rows.join(known, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb"))).drop("_k", "_kb")
    return both.groupBy(key, "_b").applyInArrow(last, out)
