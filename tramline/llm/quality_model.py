"""Quality classifier: Bradley-Terry ranking learnt from preference pairs.

Each pair says that a document of label 1 beats one of label 0.  The logistic
loss on the difference of their features gives the weights of a score; the
share of label 0 among the training scores is the quantile at which the score
is cut, and the logistic function of what lies above it is the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import kernel as K
from tramline.llm.graph import Scratch

BUCKETS = 64
_KINDS = 10


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 9, np.uint8)  # beyond ASCII
    kind[:128] = 8  # controls and other marks
    for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:?'\"-()", "!", "#*$%&|<>@^~_=+[]{}\\/")):
        kind[np.frombuffer(chars.encode(), np.uint8)] = i
    return kind


_KIND = _byte_kinds()


def feature_names() -> list[str]:
    shares = ("lower", "upper", "digit", "blank", "line", "point", "cry", "symbol", "control", "wide")
    return [*(f"share_{s}" for s in shares), "log_words", "word_length", "word_spread", "long_words", "marked_words", "distinct", "top_word", "words_a_line", *(f"words_{i}" for i in range(BUCKETS))]


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of features for each text: shares of byte kinds, word shapes, repetition, hashed short words."""
    n = len(offs) - 1
    out = np.zeros((n, _KINDS + 8 + BUCKETS))
    size = np.maximum(np.diff(offs), 1)
    owner = np.repeat(np.arange(n), np.diff(offs))
    kind = _KIND[data]
    counts = np.bincount(owner * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS)
    out[:, :_KINDS] = np.sqrt(counts / size[:, None])
    starts, ends, rows = K.word_spans(data, offs)
    number = np.diff(rows)
    some = np.maximum(number, 1)
    row = np.repeat(np.arange(n), number)
    length = (ends - starts).astype(float)
    mean = np.bincount(row, length, n) / some
    marked = np.concatenate([[0], np.cumsum((kind == 6) | (kind == 7))])
    hashes = K.span_hashes(K.lower_ascii(data), starts, ends)
    extra = [
        np.log1p(number), mean, np.sqrt(np.maximum(np.bincount(row, length**2, n) / some - mean**2, 0)), np.bincount(row, length > 20, n) / some,
        np.bincount(row, marked[ends] > marked[starts], n) / some,
    ]
    distinct, top = np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        if b > a:
            c = np.unique(hashes[a:b], return_counts=True)[1]
            distinct[i], top[i] = len(c) / (b - a), c.max() / (b - a)
    extra += [distinct, top, np.log1p(number / (1 + counts[:, 4]))]
    out[:, _KINDS : _KINDS + 8] = np.stack(extra, axis=1)
    short = length <= 4
    bags = np.bincount(row[short] * BUCKETS + (hashes[short] % K.U64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, _KINDS + 8 :] = np.sqrt(bags / some[:, None])
    return out


def _batches(batches: Iterator[pa.RecordBatch], keep: list[str], weights: np.ndarray | None, cut_at: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.slices(whole):
            x = features(*K.text_bytes(batch.column("text")))
            kept = [batch.column(c) for c in keep]
            if weights is None:
                values = pa.array(x.ravel(), pa.float64())
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(ends, values)], names=[*keep, "x"])
            else:
                score = 1 / (1 + np.exp(-np.clip(x @ weights - cut_at, -30, 30)))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=[*keep, "score"])


@dataclass(frozen=True)
class Ranker:
    """Weights of the features, and the score that divides the labels."""

    weights: tuple[float, ...]
    cut_at: float

    def score(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score, predicted) of each row; null texts count as empty."""
        docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        w, c = np.array(self.weights), self.cut_at
        out = docs.mapInArrow(lambda it: _batches(it, ["doc_id"], w, c), "doc_id long, score double")
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int | None = None, rounds: int = 4) -> Ranker:
    """Fit on all labelled rows, or with `sample` on at most about so many, drawn by a hash of the identifier.

    Each of `rounds` rounds deals both labels into buckets by another hash, with
    two rows of the rarer label on average, and pairs each bucket's rows.
    Rows with a null label or identifier are left out.  With only one label, or
    none, there are no pairs and every score is 0.5.
    """
    work = Scratch(documents.sparkSession)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").distinct()
    if sample is not None:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(marks.count(), sample))) < sample)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Features are shuffled to their labels, never texts, by the same join at any size.
    made = docs.mapInArrow(lambda it: _batches(it, ["doc_id"], None, 0.0), "doc_id long, x array<double>")
    rows = work.keep(made.join(marks.hint("merge"), "doc_id").select("doc_id", "y", "x"))
    ones, zeros = rows.where("y = 1"), rows.where("y = 0")
    least = min(ones.count(), zeros.count())
    if not least:
        return Ranker((0.0,) * len(feature_names()), 0.0)
    pairs = None
    for r in range(rounds):
        bucket = F.pmod(F.xxhash64("doc_id", F.lit(r)), F.lit(max(1, least // 2)))
        a = ones.select(F.col("x").alias("a"), bucket.alias("b"), "doc_id")
        b = zeros.select(F.col("x").alias("z"), bucket.alias("b"), F.col("doc_id").alias("other"))
        made = a.join(b.hint("merge"), "b").select("doc_id", "other", F.zip_with("a", "z", lambda p, q: p - q).alias("d"))
        pairs = made if pairs is None else pairs.unionByName(made)
    turned = F.pmod(F.xxhash64("doc_id", "other"), F.lit(2))
    train = work.keep(pairs.select(turned.cast("double").alias("label"), array_to_vector(F.transform("d", lambda v: v * (2 * turned - 1))).alias("features")))
    model = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=40).fit(train)
    w = model.coefficients.toArray()
    score = F.aggregate(F.zip_with("x", F.array(*(F.lit(float(v)) for v in w)), lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    share, count = rows.agg(F.avg(1 - F.col("y")), F.count("*")).first()
    cut_at = _quantile(rows.select(score.alias("s")), share, count)
    work.drop(rows, train)
    return Ranker(tuple(float(v) for v in w), cut_at)


def _quantile(scores: DataFrame, share: float, count: int) -> float:
    """The exact quantile of s in all rows: bounds around it first, then the few rows between them."""
    wide = max(1e-3, 4 / count)
    low, high = scores.agg(F.percentile_approx("s", [max(share - wide, 0.0), min(share + wide, 1.0)], 10_000)).first()[0]
    below, inner = scores.agg(F.count_if(F.col("s") < low), F.count_if(F.col("s").between(low, high))).first()
    at = min(max((share * (count - 1) - below) / max(inner - 1, 1), 0.0), 1.0)
    return float(scores.where(F.col("s").between(low, high)).agg(F.percentile("s", F.lit(at))).first()[0])
