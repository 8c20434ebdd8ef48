"""Source divergence audit: how far the term distributions of a language's sources lie apart.

Every (language, source) group is a vector of counts over the language's kept
terms, cut into chunks of terms and packed with up to `block` groups to a row.
The rows stay in their partitions while the rows of other blocks circulate: in
each round of a round-robin tournament a block meets at most one other of its
language, and the meeting gives the values of both directions.  All arithmetic
is in integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm import kernel as K
from tramline.llm.graph import Scratch

SCALE = 1_000_000_000
#: Letters A-Z and a-z and all that is beyond ASCII make terms; everything else parts them.
_APART = np.full(256, 0x20, np.uint8)
_APART[0x80:] = np.arange(0x80, 0x100)
_APART[ord("a") : ord("z") + 1] = _APART[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)

_ENTRIES = "array<struct<seat:int,idx:int,n:bigint>>"


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as a string column."""
    sizes = ends - starts
    offs = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], sizes)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data[at])]).cast(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group of a slice, and a row without a term for each group."""
    for whole in batches:
        for batch in K.slices(whole, most=2 << 20):
            data, offs = K.text_bytes(batch.column("text"))
            data = _APART[data]
            starts, ends, rows = K.word_spans(data, offs)
            where, which = K.numbered(data, starts, ends, K.span_hashes(data, starts, ends))
            names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            known: dict[tuple[str, str], int] = {}
            group = np.array([known.setdefault(x, len(known)) for x in names], np.int64)
            owner = np.repeat(np.arange(len(group)), np.diff(rows))
            terms = max(1, len(where))
            inside, times = np.unique(owner * terms + which, return_counts=True)  # a document's term
            keys, at = np.unique(group[inside // terms] * terms + inside % terms, return_inverse=True)
            n, docs = np.bincount(at, times, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))
            who, term = keys // terms, where[keys % terms] if len(where) else np.zeros(0, np.int64)
            who = np.concatenate([who, np.arange(len(known))]).tolist()
            groups = list(known)
            text = pa.concat_arrays([_strings(data, starts[term], ends[term]), pa.nulls(len(known), pa.string())])
            zeros = np.zeros(len(known), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([groups[g][0] for g in who], pa.string()), pa.array([groups[g][1] for g in who], pa.string()), text, pa.array(np.concatenate([n, zeros])), pa.array(np.concatenate([docs, zeros]))],
                names=["lang", "source", "term", "n", "docs"],
            )


def _shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The smoothed share of counts, in units of 1 / SCALE, plus one."""
    if len(n) and int(n.max()) > 2**63 // SCALE - 3:  # beyond 64 bits: Python's own integers
        return np.array([1 + SCALE * (x + 2) // (total + 2 * terms) for x in n.tolist()], np.int64)
    return 1 + SCALE * (n + 2) // (total + 2 * terms)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Block:
    """The groups of one row: their names, and their shares over the row's chunk of terms."""

    def __init__(self, row: dict, seats: str = "seats", entries: str = "entries") -> None:
        self.sources = [s["source"] for s in row[seats]]  # in order of their seats, from 0
        self.counts = np.zeros((len(self.sources), row["size"]), np.int64)
        e = row[entries]
        self.counts[e["seat"], e["idx"]] = e["n"]
        self.shares = np.stack([_shares(c, s["total"], row["terms"]) for c, s in zip(self.counts, row[seats], strict=True)])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch; lists of entries as arrays."""
    for i in range(batch.num_rows):
        row = {}
        for name in batch.schema.names:
            value = batch.column(name)[i]
            if name.endswith("entries"):
                flat = value.values if value.is_valid else None
                row[name] = {c: flat.field(c).to_numpy(zero_copy_only=False) if flat is not None else np.zeros(0, np.int64) for c in ("seat", "idx", "n")}
            else:
                row[name] = value.as_py()
        yield row


_PAIR = "lang string, source string, item string, value long"
_TERM = "lang string, source string, chunk long, idx int, value long"


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of every pair of groups of a row: within its block, or between it and the peer that it meets."""
    for batch in batches:
        out: list[tuple] = []
        for row in _rows(batch):
            a = _Block(row)
            b = _Block(row, "peer_seats", "peer_entries") if "peer_seats" in row else None
            for i, s in enumerate(a.sources):
                for j, t in enumerate(b.sources if b else a.sources):
                    if b or j > i:
                        value = int(_apart(a.shares[i], (b or a).shares[j]).sum())
                        out += [(row["lang"], s, t, value), (row["lang"], t, s, value)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.string(), pa.string(), pa.int64())], names=["lang", "source", "item", "value"])


def _leading(most: int):  # noqa: ANN202
    """The `most` leading terms of each group of a row; of equal values the smaller term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in _rows(batch):
                block = _Block(row)
                total = np.array(row["lang_counts"], np.int64)
                q = _shares(total, row["lang_total"], row["terms"])
                for s, n, p in zip(block.sources, block.counts, block.shares, strict=True):
                    at = np.flatnonzero((n > 0) & (p > q))
                    heap = heapq.nsmallest(most, zip((-_apart(p[at], q[at])).tolist(), at.tolist(), strict=True))
                    out += [(row["lang"], s, row["chunk"], i, -v) for v, i in heap]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "source", "chunk", "idx", "value"])

    return run


def opponent(block: Column, seats: Column, round_: int) -> Column:
    """Whom a block meets in a round of the tournament of an even number of seats (circle method)."""
    ring = seats - 1
    other = F.pmod(F.lit(round_) - block, ring)
    return F.when(block == ring, F.pmod(F.lit(round_) * (seats / 2).cast("long"), ring)).when(other == block, ring).otherwise(other)


def audit(
    documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10, block: int = 8, chunk: int = 32_768
) -> DataFrame:
    """lang, source, part, item, value, rank: for each group all other sources of its language, and its `top` terms against the language.

    Terms are runs of letters and of all beyond ASCII, A-Z lower-cased; a language
    keeps those in `least_docs` or more of its rows.  Null texts, languages and
    sources count as ''.  Every row is a document, equal ones too; groups without
    terms take part, and an empty table gives no rows.  Of further columns none is
    read, so their names don't matter.  A row of the tournament holds `block`
    groups and about `chunk` terms, so memory is bounded whatever the number of
    either.
    """
    spark = documents.sparkSession
    work = Scratch(spark)
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    made = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = work.keep(made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))

    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    kept = work.keep(kept.select("lang", "term", "lang_n"))
    langs = work.keep(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")))
    numbered = kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / chunk)))
    order = Window.partitionBy("lang", "chunk").orderBy("term")
    terms = work.keep(numbered.withColumn("idx", F.row_number().over(order) - 1))
    work.drop(kept)
    chunks = terms.groupBy("lang", "chunk", "terms", "lang_total").agg(
        F.count("*").cast("int").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "lang_n"))), lambda x: x["lang_n"]).alias("lang_counts")  # a chunk's terms
    )
    chunks = work.keep(chunks)

    entries = work.keep(counts.where("term IS NOT NULL").join(terms.select("lang", "term", "chunk", "idx"), ["lang", "term"]).select("lang", "source", "chunk", "idx", "n"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left")
    seat = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    seats = work.keep(groups.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), seat.alias("number")).select("*", F.floor(F.col("number") / block).alias("block"), (F.col("number") % block).cast("int").alias("seat")))
    work.drop(counts)

    blocks = seats.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("seat", "source", "total"))).alias("seats"))  # `block` at most
    packed = entries.join(seats.select("lang", "source", "block", "seat"), ["lang", "source"]).groupBy("lang", "chunk", "block").agg(F.collect_list(F.struct("seat", "idx", "n")).alias("entries"))
    full = blocks.join(chunks.select("lang", "chunk", "terms", "size"), "lang").join(packed, ["lang", "chunk", "block"], "left")
    rows = work.keep(full.withColumn("entries", F.coalesce("entries", F.array().cast(_ENTRIES))))
    work.drop(entries)

    cut = rows.join(chunks.select("lang", "chunk", "lang_total", "lang_counts"), ["lang", "chunk"])
    first = cut.mapInArrow(_leading(top), _TERM)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    leading = first.join(terms.select("lang", "chunk", "idx", F.col("term").alias("item")), ["lang", "chunk", "idx"])
    leading = leading.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    pairs = _tournament(work, seats, rows)
    # Groups whose language keeps no term meet nowhere, and so lie at 0 from each other.
    bare = seats.join(langs.select("lang"), "lang", "left_anti").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = pairs.unionByName(bare).withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(leading.select(*columns))


def _tournament(work: Scratch, seats: DataFrame, rows: DataFrame) -> DataFrame:
    """The values of all pairs of groups of a language, each in both directions, from one round after the other."""
    spark = work.spark
    sizes = seats.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    most = sizes.agg(F.max("blocks")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    even = sizes.select("lang", (F.col("blocks") + F.col("blocks") % 2).alias("in_ring"))
    # Residents are dealt once and stay; a lost partition is dealt again from the written table.
    resident = rows.join(even, "lang").repartition(parts, "lang", "chunk", "block").persist(StorageLevel.DISK_ONLY)

    def summed(met: DataFrame) -> DataFrame:
        return work.keep(met.mapInArrow(_meetings, _PAIR).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))

    out = summed(resident.drop("in_ring"))
    for r in range(most + most % 2 - 1):
        host = opponent(F.col("block"), F.col("in_ring"), r)
        peers = rows.join(even, "lang").where((F.col("in_ring") - 1 > r) & (host < F.col("block")))
        peers = peers.select("lang", "chunk", host.alias("block"), F.col("seats").alias("peer_seats"), F.col("entries").alias("peer_entries")).repartition(parts, "lang", "chunk", "block")
        out = out.unionByName(summed(resident.drop("in_ring").join(peers, ["lang", "chunk", "block"])))
    resident.unpersist()
    return out
