"""Distributed connected components, and tables between the steps of a job that all executors can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a step is written, its shuffle files go when it ends, and Arrow batches are bounded in bytes too.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables between the steps of one job, in a folder of their own that all executors share.

    keep() writes a step as Parquet and reads it back, so that executors lost later
    cost nothing that was written.  drop() removes tables that no later step reads;
    those that the job's result reads stay.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.steps = spark, f"{shared_dir(spark)}/tramline-{uuid.uuid4().hex}", 0
        self.kept: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.steps += 1
        path = f"{self.folder}/{self.steps:04d}"
        with _writing(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if found := self.kept.pop(id(t), None):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(found[1])
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tramline-")


def connected_components(edges: DataFrame, work: Scratch | None = None) -> DataFrame:
    """Smallest reachable node of every node of an undirected graph, as (node, component).

    edges has the columns u and v.  Alternates the large-star and small-star
    steps of Kiveris et al. (2014) until the edges no longer change: each step
    is one aggregation and one join, a hub's edges are never gathered in one
    row, and the number of rounds is logarithmic in the longest path.  Null
    ends, loops and repeated edges are allowed and ignored.
    """
    work = work or Scratch(edges.sparkSession)
    e = work.keep(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        before, e = e, work.keep(small)
        work.drop(before)
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    out = work.keep(roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct()))
    work.drop(e)
    return out


def _state(e: DataFrame) -> tuple:
    x = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.sum(x % 1000003), F.bit_xor(x)).first())


def numbered_rows(docs: DataFrame, work: Scratch) -> tuple[DataFrame, bool]:
    """docs with a unique row number: doc_id, or a number below all of them where it is null or repeated; and whether there are such."""
    ids = docs.groupBy("doc_id").agg((F.count("*") > 1).alias("again"))
    low, odd = ids.agg(F.min("doc_id"), F.max(F.col("again") | F.col("doc_id").isNull())).first()
    if not odd:
        return docs.withColumn("row", F.col("doc_id")), False
    ids = work.keep(ids.where("again OR doc_id IS NULL").select(F.col("doc_id").alias("odd_id")))
    hard = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("odd_id")), "left_semi")
    # Written once, so that the numbers stay as they are.
    hard = work.keep(hard.withColumn("row", F.lit(min(low or 0, 0)) - 1 - F.monotonically_increasing_id()))
    easy = docs.where("doc_id IS NOT NULL").join(ids, F.col("doc_id") == F.col("odd_id"), "left_anti").withColumn("row", F.col("doc_id"))
    return easy.unionByName(hard), True
