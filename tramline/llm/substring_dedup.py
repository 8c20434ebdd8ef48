"""Exact substring deduplication by seed and extend over winnowed anchors.

Every window of `min_words` words picks its smallest k-gram as anchor
(winnowing), so equal windows pick equal anchors, and each passage that two
documents share is seeded in both.  Neighbouring windows that pick the same
anchor are the seed's extension to both sides; their span has a digest of its
own.  Documents are joined on anchors.  Where the spans agree, the match covers
all of the span's windows; where a match ends inside a span, its windows are
compared one by one.  Matched windows are merged to maximal repeats.

An anchor is a 64-bit hash and only finds candidates.  Spans and windows are
taken as equal by digests of 128 bits over all of their words.

Only anchors that occur in two documents are shuffled with their positions, and
a group of copies is reduced to its smallest document id, never to pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import kernel as K
from tramline.llm.graph import Scratch, numbered_rows

_PIECE = 16  # windows of a span at most; a longer run of one anchor is cut into several spans
_RUN = 32  # a span is kept as first * _RUN + count


def _windows(words: np.ndarray, rows: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor hash, and which windows lie within one row."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0], np.zeros(0, bool)
    low, width, need = K.gram_hashes(words, k), 1, size - k + 1
    while width < need:  # running minimum by doubling
        step = min(width, need - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    ends = np.repeat(rows[1:], np.diff(rows))[:n]
    return low, np.arange(n) + size <= ends


def _runs(hashes: np.ndarray, rows: np.ndarray, size: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor, row, first window, number of windows."""
    low, valid = _windows(hashes, rows, size, k)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[: len(low)]
    new = np.ones(len(low), bool)
    if len(low):
        new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    edge = np.flatnonzero(new | ~valid)
    stop = np.append(edge, len(low))[np.searchsorted(edge, first, side="right")] if len(first) else first
    pieces = -(-(stop - first) // _PIECE)
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    stop = np.repeat(stop, pieces)
    first = np.repeat(first, pieces) + inner * _PIECE
    return low[first], owner[first], first, np.minimum(stop - first, _PIECE)


def _parsed(batch: pa.RecordBatch, lanes: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words, as many independent ones as lanes, and each row's range in them."""
    data, offs = K.text_bytes(batch.column("text"))
    starts, ends, rows = K.word_spans(data, offs)
    return [K.span_hashes(data, starts, ends, lane) for lane in range(lanes)], rows


def _seeds(batches: Iterator[pa.RecordBatch], size: int, k: int) -> Iterator[pa.RecordBatch]:
    """Distinct anchors of each slice, with the smallest and largest document that has them."""
    for whole in batches:
        for batch in K.slices(whole, most=2 << 20):
            (hashes,), rows = _parsed(batch, 1)
            anchor, row, _, _ = _runs(hashes, rows, size, k)
            order = np.argsort(anchor, kind="stable")
            anchor, doc = anchor[order], np.asarray(batch.column("doc_id"))[row[order]]
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
            if len(first):
                lo, hi = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(anchor[first])), pa.array(lo), pa.array(hi)], names=["anchor", "lo", "hi"])


def _occurrences(batches: Iterator[pa.RecordBatch], size: int, k: int, keys: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.slices(whole, most=1 << 20):
            words, rows = _parsed(batch)
            anchor, row, first, count = _runs(words[0], rows, size, k)
            a, b = K.run_digests(words, first, count + size - 1)
            run = (first - rows[row]) * _RUN + count
            kept = [batch.column(c).take(pa.array(row)) for c in keys]
            yield pa.RecordBatch.from_arrays([*(pa.array(K.signed(x)) for x in (anchor, a, b)), *kept, pa.array(run)], names=["anchor", "span_a", "span_b", *keys, "run"])


def _single(batches: Iterator[pa.RecordBatch], size: int, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The windows of the given runs, one by one: digest, document and position."""
    for whole in batches:
        for batch in K.slices(whole):
            words, rows = _parsed(batch)
            n = np.asarray(pa.compute.list_value_length(batch.column("runs"))).astype(np.int64)
            runs = np.asarray(batch.column("runs").flatten()).astype(np.int64)
            count, at = runs % _RUN, runs // _RUN
            row = np.repeat(np.arange(len(n)), n)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start, row = np.repeat(at, count) + inner, np.repeat(row, count)
            begin = start + rows[row]
            ok = begin + size <= rows[row + 1]
            start, row, begin = start[ok], row[ok], begin[ok]
            a, b = K.run_digests(words, begin, np.full(len(begin), size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(K.signed(a)), pa.array(K.signed(b)), *(batch.column(c).take(pa.array(row)) for c in keys), pa.array(start * _RUN + 1)],
                names=["window_a", "window_b", *keys, "run"],
            )


_CLEAN = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()),
        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def _clean(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.slices(whole):
            out: list[tuple] = []
            for doc, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("runs"), strict=True):
                words = (text or "").encode().split()
                n, spans = len(words), []
                runs = np.asarray(runs.values if runs.is_valid else [], dtype=np.int64)
                if len(runs):
                    at, count = runs // _RUN, runs % _RUN
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, np.minimum(at, n), 1)
                    np.add.at(depth, np.minimum(at + count + size - 1, n), -1)
                    cover = np.concatenate([[False], np.cumsum(depth[:n]) > 0, [False]])
                    edges = np.flatnonzero(cover[1:] != cover[:-1]).tolist()
                    spans = list(zip(edges[::2], edges[1::2], strict=True))
                    kept, last = [], 0
                    for a, b in spans:
                        kept += words[last:a]
                        last = b
                    words = kept + words[last:]
                out.append((doc, n, n - len(words), b" ".join(words).decode(), [{"start": a, "end": b} for a, b in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _CLEAN.types, strict=True)], schema=_CLEAN)


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, seed_words: int = 5) -> DataFrame:
    """Each text without the words of passages that begin in a document with a smaller id.

    A passage is min_words or more consecutive words (runs without white space,
    compared as they are); it may begin anywhere in either document.  Returns
    (doc_id, n_words, n_removed, text, removed), one row per input row: the kept
    words joined by one space, and the maximal repeats as word positions [start,
    end).  Null texts count as empty.  Rows with a null id are returned whole and
    are no source.  Rows that repeat an id are documents of their own, none of
    which is a source of the others.  Other columns are left out.  Texts of any
    length are searched whole, and an empty table gives an empty one.
    """
    work = Scratch(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known, odd = numbered_rows(docs.where("doc_id IS NOT NULL"), work)
    # A row goes by its id, or where ids repeat by a number of its own; which is earlier is told by ids in any case.
    keys, key = (["doc_id", "row"], "row") if odd else (["doc_id"], "doc_id")
    known = known.select(*keys, "text")
    of_row = ", ".join(f"{c} long" for c in keys)
    # What is joined below is written first: a join splits a hot key's rows over several
    # tasks only where both of its sides come straight from a shuffle.
    shared = work.keep(
        known.mapInArrow(lambda it: _seeds(it, min_words, seed_words), "anchor long, lo long, hi long")
        .groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("anchor")
    )
    found = work.keep(
        known.mapInArrow(lambda it: _occurrences(it, min_words, seed_words, keys), f"anchor long, span_a long, span_b long, {of_row}, run long")
        .join(shared, "anchor")
    )
    work.drop(shared)
    spans = work.keep(found.groupBy("anchor", "span_a", "span_b").agg(F.min("doc_id").alias("source")))
    several = work.keep(spans.groupBy("anchor").agg(F.count("*").alias("spans")).where("spans > 1").select("anchor"))
    placed = work.keep(found.join(spans, ["anchor", "span_a", "span_b"]).select("anchor", key, "run", (F.col("doc_id") > F.col("source")).alias("again")))
    work.drop(found, spans)
    whole = placed.where("again").select(key, "run")
    open_ = work.keep(placed.where("NOT again").join(several, "anchor").select(key, "run"))
    open_runs = open_.groupBy(key).agg(F.collect_list("run").alias("runs"))  # a row's own runs
    windows = work.keep(
        known.join(open_runs, key).select(*keys, "text", "runs").mapInArrow(lambda it: _single(it, min_words, keys), f"window_a long, window_b long, {of_row}, run long")
    )
    work.drop(several, open_)
    first = work.keep(windows.groupBy("window_a", "window_b").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last"))
    part = work.keep(windows.join(first, ["window_a", "window_b"]).where("doc_id > source").select(key, "run"))
    work.drop(windows, first)
    gone = whole.unionByName(part).groupBy(key).agg(F.collect_list("run").alias("runs"))
    nameless = docs.where("doc_id IS NULL").withColumn("runs", F.lit(None).cast("array<bigint>"))
    return known.join(gone, key, "left").select("doc_id", "text", "runs").unionByName(nameless).mapInArrow(
        lambda it: _clean(it, min_words), "doc_id long, n_words long, n_removed long, text string, removed array<struct<start:long,end:long>>"
    )
