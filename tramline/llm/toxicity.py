"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its
beginnings, so that inflected forms of a stem share what is learnt.  Filters of
several widths pass over the words, the largest response of each filter in the
whole text goes through a rectifier, and one linear layer gives the logit.
Training mixes parameters: every round each part of the labelled rows trains a
copy on its own rows, and the copies are averaged.  The number of parts grows with
the rows, and the copies are averaged in as many pieces.  Rows held back from
training give each language its own threshold; the language is read off the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm import kernel as K
from tramline.llm.graph import Scratch

BUCKETS, DIM, FILTERS = 1 << 16, 8, 16
WIDTHS = (1, 2, 3)
#: Bytes of the beginnings that are units beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
UNITS = 1 + len(BEGINNINGS)
PAD = max(WIDTHS)
_DROPPED = 0.3  # share of the words that a training step leaves out, so that no text is learnt by heart
_CHUNK = 1 << 15  # positions whose responses are held at once

#: Frequent words that tell languages apart.
STOP_WORDS = {
    "en": "the and of to in that is was for with".split(),
    "de": "der die und den das von zu mit sich nicht".split(),
    "fr": "le la les des et du que dans pour une".split(),
    "es": "el los las del que y por con para una".split(),
}

#: Letters and what is beyond ASCII make words, A-Z lower-cased.
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _whole(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = K.word_spans(data, np.array([0, len(data)]))
    return K.span_hashes(data, starts, ends)


def _stop_table() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all stop words in order, and the languages of each as bits."""
    hashes = np.concatenate([_whole(w) for w in STOP_WORDS.values()])
    owner = np.repeat(np.arange(len(STOP_WORDS)), [len(w) for w in STOP_WORDS.values()])
    known, which = np.unique(hashes, return_inverse=True)
    bits = np.zeros((len(known), len(STOP_WORDS)), np.int64)
    bits[which, owner] = 1
    return known, bits


_STOP, _SPEAKS = _stop_table()


class Words:
    """The words of a batch of texts, and the units of any range of them."""

    def __init__(self, column: pa.Array) -> None:
        data, offs = K.text_bytes(column)
        self.data = _LETTER[data]
        self.starts, self.ends, self.rows = K.word_spans(self.data, offs)

    def units(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets (from 1; 0 for a beginning that is the word itself) of words a to b, and their whole words' hashes."""
        starts, ends = self.starts[a:b], self.ends[a:b]
        out = np.zeros((b - a, UNITS), np.int32)
        whole = K.span_hashes(self.data, starts, ends)
        out[:, 0] = whole % K.U64(BUCKETS - 1) + K.U64(1)
        for i, size in enumerate(BEGINNINGS, 1):
            longer = np.flatnonzero(ends - starts > size)
            out[longer, i] = K.span_hashes(self.data, starts[longer], starts[longer] + size, i) % K.U64(BUCKETS - 1) + K.U64(1)
        return out, whole


@dataclass
class Net:
    """The parameters, and the sums of squared gradients that scale their steps."""

    embed: np.ndarray
    filters: list[np.ndarray]  # of width w: (w, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    seen: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def new(seed: int) -> Net:
        r = np.random.default_rng(seed)
        f = np.float32
        net = Net(
            r.normal(0, 0.02, (BUCKETS, DIM)).astype(f), [r.normal(0, 0.5, (w, DIM, FILTERS)).astype(f) for w in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.02, f),
            r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(f), np.zeros(1, f),
        )
        net.embed[0] = 0
        net.seen = [np.full(BUCKETS, 1e-6, f), *(np.full(p.shape, 1e-6, f) for p in net.arrays()[1:])]
        return net

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.shift]

    def flat(self) -> np.ndarray:
        """All numbers in a row."""
        return np.concatenate([p.ravel() for p in [*self.arrays(), *self.seen]])

    @staticmethod
    def of(flat: np.ndarray) -> Net:
        """The net of such a row."""
        like = Net.new(0)
        shapes = [p.shape for p in [*like.arrays(), *like.seen]]
        ends = np.cumsum([math.prod(x) for x in shapes])
        p = [part.reshape(x).copy() for part, x in zip(np.split(flat, ends[:-1]), shapes, strict=True)]
        k, n = len(WIDTHS), len(like.arrays())
        return Net(p[0], p[1 : 1 + k], *p[1 + k : n], seen=p[n:])

    def responses(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors, and each filter's response at each position from which all widths have room (PAD - 1 fewer)."""
        e = self.embed[units].sum(axis=1)
        n = max(0, len(e) - PAD + 1)
        y = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for k, (w, c) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            part = e[:n] @ c[0]
            for j in range(1, w):
                part += e[j : j + n] @ c[j]
            y[:, k * FILTERS : (k + 1) * FILTERS] = part
        return e, y

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift

    def step(self, docs: list[np.ndarray], y: np.ndarray, rate: float, weight: np.ndarray | float = 1.0) -> None:
        """One step down the weighted logistic loss of some documents, each given by the units of its words."""
        gap = np.zeros((PAD, UNITS), np.int32)
        units = np.concatenate([x for d in docs for x in (d, gap)])
        sizes = np.array([len(d) + PAD for d in docs])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        e, resp = self.responses(np.concatenate([units, gap]))
        at = np.stack([a + resp[a : a + n - PAD + 1].argmax(axis=0) for a, n in zip(first, sizes, strict=True)])
        pooled = np.take_along_axis(resp, at, axis=0)
        hidden = np.maximum(pooled + self.bias, 0)
        off = (1 / (1 + np.exp(-np.clip(hidden @ self.out + self.shift, -30, 30))) - y) * weight / len(y)
        back = (off[:, None] * self.out) * (hidden > 0)
        places, pushes, turns = [], [], []
        for k, (w, c) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            turn = np.zeros_like(c)
            for j in range(w):
                p = at[:, own] + j
                turn[j] = np.einsum("bf,bfd->df", back[:, own], e[p])
                places.append(p.ravel())
                pushes.append((back[:, own, None] * c[j].T[None]).reshape(-1, DIM))
            turns.append(turn)
        place, which = np.unique(np.concatenate(places), return_inverse=True)
        push = np.zeros((len(place), DIM), np.float32)
        np.add.at(push, which, np.concatenate(pushes))
        bucket, which = np.unique(units[np.minimum(place, len(units) - 1)].ravel(), return_inverse=True)
        moved = np.zeros((len(bucket), DIM), np.float32)
        np.add.at(moved, which, np.repeat(push, UNITS, axis=0))
        moved[bucket == 0] = 0
        self.seen[0][bucket] += (moved**2).sum(axis=1)
        self.embed[bucket] -= rate * moved / np.sqrt(self.seen[0][bucket])[:, None]
        for p, s, g in zip(self.arrays()[1:], self.seen[1:], [*turns, back.sum(axis=0), hidden.T @ off, off.sum(keepdims=True)], strict=True):
            s += g**2
            p -= (rate * g / np.sqrt(s)).astype(np.float32)


def _pooled(words: Words, net: Net) -> tuple[np.ndarray, np.ndarray]:
    """Each text's largest response of each filter, and its stop words by language; positions go in chunks, texts of any length."""
    n = len(words.rows) - 1
    best = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    votes = np.zeros((n, len(STOP_WORDS)), np.int64)
    count = np.diff(words.rows)
    place = words.rows[:-1] + PAD * np.arange(n)  # of each text's first word; PAD empty places follow each text
    total = int(words.rows[-1]) + PAD * n
    for a in range(0, total, _CHUNK):
        b = min(a + _CHUNK + PAD - 1, total)
        lo, hi = int(np.searchsorted(place, a, side="right")) - 1, int(np.searchsorted(place, b, side="left"))  # texts with places in the chunk
        first = max(0, min(a - int(place[lo]), int(count[lo]))) + int(words.rows[lo])
        last = max(0, min(b - int(place[hi - 1]), int(count[hi - 1]))) + int(words.rows[hi - 1])
        units, whole = words.units(first, last)
        owner = np.searchsorted(words.rows, np.arange(first, last), side="right") - 1
        at = np.arange(first, last) + PAD * owner - a
        known = np.minimum(np.searchsorted(_STOP, whole), len(_STOP) - 1)
        said = (_STOP[known] == whole) & (at < _CHUNK)
        np.add.at(votes, owner[said], _SPEAKS[known[said]])
        grid = np.zeros((b - a, UNITS), np.int32)
        grid[at] = units
        _, y = net.responses(np.concatenate([grid, np.zeros((PAD, UNITS), np.int32)]) if b == total else grid)
        texts = np.arange(lo, hi)
        begins = np.maximum(place[texts] - a, 0)
        keep = begins < len(y)
        texts, begins = texts[keep], begins[keep]
        ends = np.minimum(place[texts] + count[texts] + 1 - a, len(y))  # the last place still counts, so that empty texts have one
        keep = ends > begins
        texts, begins, ends = texts[keep], begins[keep], ends[keep]
        if len(texts):
            inner = np.column_stack([begins, ends]).ravel()
            padded = np.concatenate([y, np.full((1, y.shape[1]), -np.inf, np.float32)])
            best[texts] = np.maximum(best[texts], np.maximum.reduceat(padded, inner, axis=0)[::2])
    return best, votes


def _language(votes: np.ndarray) -> np.ndarray:
    """Of each text the language with most stop words, -1 without any."""
    return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), -1)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.slices(whole, most=1 << 18):
            words = Words(batch.column("text"))
            units, _ = words.units(0, len(words.starts))
            units = units.astype(np.uint16)
            made = [units[a:b].tobytes() for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("part"), pa.array(made, pa.binary())], names=["doc_id", "y", "part", "units"])


def _scored(batches: Iterator[pa.RecordBatch], keep: list[str], net: Net, cuts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Logits and languages, or with cuts (by language, the last for none) scores."""
    for whole in batches:
        for batch in K.slices(whole, most=1 << 18):
            best, votes = _pooled(Words(batch.column("text")), net)
            logit, lang = net.logits(best).astype(float), _language(votes)
            kept = [batch.column(c) for c in keep]
            if cuts is None:
                yield pa.RecordBatch.from_arrays([*kept, pa.array(logit), pa.array(lang.astype(np.int32))], names=[*keep, "logit", "language"])
            else:
                score = 1 / (1 + np.exp(-np.clip(logit - cuts[lang], -30, 30)))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=[*keep, "score"])


def _train(net: Net, table: pa.Table, seed: int, batch: int, rate: float) -> Net:
    """One pass over a part's rows in an order of its own; both labels weigh the same as a whole."""
    table = table.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y, units = table.column("y").to_numpy().astype(np.float32), table.column("units")
    weight = np.where(y == 1, 1, max(y.sum(), 1) / max((1 - y).sum(), 1)).astype(np.float32)
    weight /= weight.max() ** 0.5 * weight.min() ** 0.5
    draws = np.random.default_rng([seed, int(table.column("part")[0].as_py())])
    order = draws.permutation(len(y))
    for a in range(0, len(order), batch):
        rows = order[a : a + batch]
        docs = [np.frombuffer(units[int(i)].as_py(), np.uint16).astype(np.int32).reshape(-1, UNITS) for i in rows]
        net.step([d * (draws.random((len(d), 1)) >= _DROPPED) for d in docs], y[rows], rate, weight[rows])
    return net


def _pass(start: Broadcast, seed: int, batch: int, rate: float, pieces: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each part's copy of the net, trained on its rows, in pieces; a part's rows follow each other."""

    def trained(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = held[0].column("part")[0].as_py()
        flat = _train(Net.of(start.value), pa.Table.from_batches(held), seed, batch, rate).flat()
        made = pa.array([x.tobytes() for x in np.array_split(flat, pieces)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(pieces, dtype=np.int32)), pa.array(np.full(pieces, part, np.int32)), made], names=["piece", "part", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            part = whole.column("part").to_numpy()
            at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b > a:
                    if held and held[0].column("part")[0].as_py() != part[a]:
                        yield trained(held)
                        held = []
                    held.append(whole.slice(a, b - a))
        if held:
            yield trained(held)

    return run


def _mean(table: pa.Table) -> pa.Table:
    """The mean of one piece over all copies."""
    table = table.sort_by("part")
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.column("numbers"))
    return pa.table({"piece": table.column("piece").slice(0, 1), "numbers": pa.array([(total / len(table)).astype(np.float32).tobytes()], pa.binary())})


def threshold(logits: np.ndarray, y: np.ndarray, clean_weight: float) -> float:
    """The cut with the least weighted errors; of equally good ones the middle of the widest gap."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y)])
    false = clean_weight * (np.concatenate([[0], np.cumsum(1 - y)])[-1] - np.concatenate([[0], np.cumsum(1 - y)]))
    edges = np.concatenate([[x[0] - 2], x, [x[-1] + 2]])
    gap = np.diff(edges)
    errors = np.where(gap > 0, missed + false, np.inf)
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    k = best[gap[best].argmax()]
    return float((edges[k] + edges[k + 1]) / 2)


def thresholds(seen: DataFrame, clean_weight: float, least: int) -> dict[int, float]:
    """threshold() of all rows (-1), and of each language with at least `least` rows of either label.

    seen has y, logit and language.  Equal logits are one row; the running counts
    are windows within bins of logits, and each bin's row carries what lies below it.
    """
    owner = F.explode(F.when(F.col("language") < 0, F.array(F.lit(-1))).otherwise(F.array(F.lit(-1), F.col("language")))).alias("k")
    spots = seen.select(owner, "logit", "y").groupBy("k", "logit").agg(F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros"))
    spots = spots.withColumn("bin", F.floor(F.greatest(F.least(F.col("logit"), F.lit(32.0)), F.lit(-32.0)) * 64))
    bins = spots.groupBy("k", "bin").agg(F.sum("ones").alias("own_ones"), F.sum("zeros").alias("own_zeros"), F.min("logit").alias("first"))  # 4,097 of each k at most
    over, every = Window.partitionBy("k").orderBy("bin"), Window.partitionBy("k")
    bins = bins.select(
        "k", "bin", "first", F.lead("first").over(over).alias("next"), (F.sum("own_ones").over(over) - F.col("own_ones")).alias("ones_below"), (F.sum("own_zeros").over(over) - F.col("own_zeros")).alias("zeros_below"),
        F.sum("own_ones").over(every).alias("all_ones"), F.sum("own_zeros").over(every).alias("all_zeros"),
    )
    within = Window.partitionBy("k", "bin").orderBy("logit")
    missed, spared = F.col("ones_below") + F.sum("ones").over(within), F.col("zeros_below") + F.sum("zeros").over(within)
    high = F.coalesce(F.lead("logit").over(within), F.col("next"), F.col("logit") + 2)
    above = spots.join(bins.hint("merge"), ["k", "bin"]).select("k", F.col("logit").alias("low"), high.alias("high"), (missed + clean_weight * (F.col("all_zeros") - spared)).alias("errors"), "all_ones", "all_zeros")
    lowest = bins.where("ones_below + zeros_below = 0").select("k", (F.col("first") - 2).alias("low"), F.col("first").alias("high"), (clean_weight * F.col("all_zeros")).alias("errors"), "all_ones", "all_zeros")
    best = F.min(F.struct(F.round("errors", 6), F.col("low") - F.col("high"), "low", "high")).alias("best")
    found = above.unionByName(lowest).groupBy("k", "all_ones", "all_zeros").agg(best).where((F.col("k") == -1) | (F.least("all_ones", "all_zeros") >= least))
    return {r["k"]: (r["best"]["low"] + r["best"]["high"]) / 2 for r in found.collect()}


@dataclass(frozen=True)
class Classifier:
    """The trained net and the logits that divide the labels, by language and for texts of none."""

    net: Net
    cuts: tuple[float, ...]

    def score(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score, predicted) of each row, from its whole text alone; null texts count as empty."""
        docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        net, cuts = Net(self.net.embed, self.net.filters, self.net.bias, self.net.out, self.net.shift), np.array(self.cuts)
        out = docs.mapInArrow(lambda it: _scored(it, ["doc_id"], net, cuts), "doc_id long, score double")
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int | None = None, rounds: int = 8, parts: int = 4, batch: int = 16, rate: float = 0.1, least: int = 20,
    part_rows: int = 5_000,
) -> Classifier:
    """Fit on all labelled rows, or with `sample` on at most about so many, half of them of each label where there are as many, drawn by a hash of the identifier.

    The rows are dealt into parts of about `part_rows`, `parts` of them at least.
    A fifth of all is held back for the thresholds; a language with fewer than
    `least` held-back rows of either label takes the threshold of all.  Of rows
    with the same id and label one text is taken, the smallest.  Rows with a null
    label or identifier are left out; with only one label, or none, every score is
    0.5.  Further columns are not read.
    """
    spark = documents.sparkSession
    work = Scratch(spark)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").distinct()
    count = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        net = Net.new(1)
        net.out[:] = 0
        return Classifier(net, (0.0,) * (len(STOP_WORDS) + 1))
    taken = {y: n if sample is None else min(n, sample / 2) for y, n in count.items()}
    parts = max(parts, math.ceil(0.8 * sum(taken.values()) / part_rows))
    part = F.when(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0, -1).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(parts))).cast("int")
    if sample is not None:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.when(F.col("y") == 1, F.lit(count[1])).otherwise(F.lit(count[0]))) < sample // 2)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chosen = docs.join(marks.hint("merge"), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    chosen = work.keep(chosen.withColumn("part", part))
    # A part's rows lie in one file and follow each other there, so that no round shuffles rows.
    rows = chosen.where("part >= 0").repartitionByRange(parts, "part").sortWithinPartitions("part")
    rows = work.keep(rows.mapInArrow(_tokens, "doc_id long, y int, part int, units binary"))
    flat, pieces = Net.new(1).flat(), min(parts, 256)
    for r in range(rounds):
        start = spark.sparkContext.broadcast(flat)
        copies = rows.mapInArrow(_pass(start, r, batch, rate, pieces), "piece int, part int, numbers binary")
        made = work.keep(copies.groupBy("piece").applyInArrow(_mean, "piece int, numbers binary"))
        if got := sorted(map(tuple, made.collect())):  # one net
            flat = np.concatenate([np.frombuffer(x, np.float32) for _, x in got])
        work.drop(made)
        start.unpersist()
    net = Net.of(flat)
    seen = work.keep(chosen.where("part = -1").mapInArrow(lambda it: _scored(it, ["y"], net, None), "y int, logit double, language int"))
    cuts = thresholds(seen, count[0] / taken[0] / (count[1] / taken[1]), least)
    overall = cuts.get(-1, 0.0)
    work.drop(chosen, rows, seen)
    return Classifier(net, (*(cuts.get(k, overall) for k in range(len(STOP_WORDS))), overall))
