"""Toxicity, centroid clustering and the source divergence audit against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tramline.llm import balls, divergence, toxicity
from tramline.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


# Source divergence audit


def audited(rows: list[tuple], least: int, top: int = 10) -> Counter:
    """(text, lang, source) rows judged term by term and pair by pair."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out: Counter = Counter()
    for lang in {x[1] for x in rows}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {s: [c[t] for t in kept] for (x, s), c in counts.items() if x == lang}
        share = lambda ns: [1 + 10**9 * (n + 2) // (sum(ns) + 2 * len(kept)) for n in ns]
        p = {s: share(ns) for s, ns in groups.items()}
        q = share([sum(ns[i] for ns in groups.values()) for i in range(len(kept))])
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted(((-sum(map(apart, p[s], p[o])), o.encode(), o) for o in groups if o != s))
            terms = sorted((-apart(p[s][i], q[i]), t.encode(), t) for i, t in enumerate(kept) if groups[s][i] > 0 and p[s][i] > q[i])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out.update((lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1))
    return out


def _said(df) -> Counter:
    return Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("sources", "block", "chunk"), [(1, 2, 4), (2, 2, 4), (7, 2, 5), (8, 3, 1000), (9, 1, 7), (5, 8, 32_768)])
def test_audit(spark, sources, block, chunk):
    r = random.Random(sources)
    words = ["aB", "ß", "éé", "Z", "z", "x9y", "you", "YOU", "Ärger", "ärger", "日本", "the"] + ["".join(r.choice("abcde") for _ in range(r.randrange(1, 4))) for _ in range(30)]
    rows = [(" -1 ".join(r.choice(words) for _ in range(r.randrange(0, 30))), r.choice(["en", "de", None]), f"s{r.randrange(sources)}") for _ in range(120)]
    rows += [(None, "en", "s0"), ("", "fr", "only"), ("!! 12", "en", "bare"), ("rare words here", "xx", "a"), ("other", "xx", None), ("the " * 3000, "en", "s0")] + rows[:9]
    df = spark.createDataFrame([(*x, "mine", 7) for x in rows], "text string, lang string, source string, term string, rank int").repartition(3)
    assert _said(divergence.audit(df, least_docs=3, block=block, chunk=chunk)) == audited(rows, 3)


def test_audit_of_nothing_and_of_other_columns(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    rows = [(f"w{i % 3} the", "en", f"s{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "body string, tongue string, host string")
    assert _said(divergence.audit(df, text_col="body", lang_col="tongue", source_col="host")) == audited(rows, 10)


def test_shares_beyond_64_bits():
    n = np.array([0, 5, 10**12, 7 * 10**14], np.int64)
    total = int(n.sum())
    assert divergence._shares(n, total, 4).tolist() == [1 + 10**9 * (int(x) + 2) // (total + 8) for x in n]


def test_rounds_let_every_pair_meet_once(spark):
    from pyspark.sql import functions as F

    for m in (1, 2, 3, 4, 7, 8):
        n, met = m + m % 2, Counter()
        for r in range(n - 1):
            host = divergence.opponent(F.col("id"), F.lit(n).cast("long"), r)
            found = [(x.id, x.o) for x in spark.range(m).select("id", host.alias("o")).collect()]
            assert all((b, a) in found for a, b in found if b < m)
            met.update((b, a) for a, b in found if b < a)
        assert met == Counter((a, b) for a in range(m) for b in range(a + 1, m))


# Centroid clustering


def clustered(rows: list[tuple], k: int, rounds: int, dim: int, scale: float) -> tuple[list[tuple], list]:
    kept = [(i, [max(-balls.LARGEST, min(balls.LARGEST, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centers = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(centers)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centers


@pytest.mark.parametrize("most", [7, 2048])
def test_cluster(spark, most):
    r = random.Random(4)
    spots = [[r.uniform(-3, 3) for _ in range(5)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(spots)]) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, -0.5, 1.0, 0.0]) for i in range(200)]  # one very common vector
    rows += [(5, [0.0] * 5), (5, [1.0] * 5), (None, [1.0] * 5), (None, None), (2000, None), (2001, []), (2002, [1.0] * 4), (2003, [1.0] * 6), (2004, [1.0, None, 1.0, 1.0, 1.0]), (2005, [float("nan")] * 5), (2006, [float("inf")] * 5), (2007, [1e300] * 5), (2008, [-1e300] * 5)]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "vec_id long, embedding array<double>, cluster int, members string").repartition(3)
    got, centers = balls.cluster(df, k=7, rounds=3, dim=5, most=most)
    want, want_centers = clustered(rows, 7, 3, 5, 64.0)
    assert centers == want_centers
    assert Counter(map(tuple, got.collect())) == Counter(want)
    full = balls.summary(got, centers).collect()
    each = Counter()
    for _, c, d in want:
        each[c] += d
    assert all(x.cluster_inertia == each[x.cluster] and x.inertia == sum(each.values()) for x in full)
    assert all(x.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[x.cluster])).encode()).hexdigest() for x in full)


def test_cluster_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    out, centers = balls.cluster(spark.createDataFrame([], schema))
    assert out.collect() == [] and centers == []
    assert balls.summary(out, centers).collect() == []
    rows = [(i, [float(i)] * 64) for i in range(3)]
    out, centers = balls.cluster(spark.createDataFrame(rows, schema))
    want, want_centers = clustered(rows, 16, 3, 64, 64.0)
    assert Counter(map(tuple, out.collect())) == Counter(want) and centers == want_centers


def test_balls_taken_as_a_whole_are_right():
    """Ties and near ties of whole numbers, on trees of all shapes; and clustered data are not passed vector by vector."""
    r = np.random.default_rng(3)
    for span in (1, 2, 5, 1000):
        for n in (1, 2, 33, 500):
            v = r.integers(-span, span + 1, (n, 3))
            batch = pa.RecordBatch.from_pydict({"vec_id": list(range(n)), "embedding": [list(map(float, x)) for x in v]})
            centers = r.integers(-span, span + 1, (5, 3))
            seen = np.zeros(n, int)
            for row in balls._rows(balls._trees(iter([batch]), 3, 1.0, 200)):
                ids, members = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["members"], np.int32).reshape(-1, 3)
                for a, b, c, ball in balls.assigned(row, centers):
                    want = ((v[ids[a:b]][:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
                    assert (want == c).all() and (ball is None or (members[a:b].sum(axis=0) == ball).all())
                    seen[ids[a:b]] += 1
            assert (seen == 1).all()
    spots = r.integers(-2000, 2000, (6, 8))
    v = spots[r.integers(0, 6, 1000)] + r.integers(-3, 4, (1000, 8))
    batch = pa.RecordBatch.from_pydict({"vec_id": list(range(1000)), "embedding": [list(map(float, x)) for x in v]})
    (row,) = balls._rows(balls._trees(iter([batch]), 8, 1.0, 2048))
    whole = [b - a for a, b, _, ball in balls.assigned(row, spots) if ball is not None]
    assert sum(whole) == 1000 and len(whole) < 20


# Toxicity


def naive(text: str, net: toxicity.Net) -> np.ndarray:
    """Each filter's largest response, place by place."""
    words = toxicity.Words(pa.array([text]))
    units, _ = words.units(0, len(words.starts))
    e = [net.embed[u].sum(axis=0) for u in units] + [np.zeros(toxicity.DIM)] * toxicity.PAD
    out = []
    for w, c in zip(toxicity.WIDTHS, net.filters, strict=True):
        out.append(np.max([sum(e[i + j] @ c[j] for j in range(w)) for i in range(len(units) + 1)], axis=0))
    return np.concatenate(out)


def test_responses_of_texts_of_any_length(monkeypatch):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefé") for _ in range(r.randrange(1, 12)))
    texts = ["", "!!", "one", "a b", *(" ".join(word() for _ in range(n)) for n in (3, 5, 40, 0, 171, 1, 2, 64)), ""]
    net = toxicity.Net.new(3)
    for chunk in (4, 7, 64, 1 << 15):
        monkeypatch.setattr(toxicity, "_CHUNK", chunk)
        best, votes = toxicity._pooled(toxicity.Words(pa.array([*texts, None])), net)
        assert np.allclose(best, np.stack([naive(t, net) for t in [*texts, ""]]), atol=1e-5)
        assert not votes.any()
    monkeypatch.setattr(toxicity, "_CHUNK", 4)
    _, votes = toxicity._pooled(toxicity.Words(pa.array(["Der Hund, und DIE Katze", "the cat and the dog", "la la la", "zzz"])), net)
    assert toxicity._language(votes).tolist() == [1, 0, 2, -1]
    assert votes.sum() == 3 + 3 + 3 * sum("la" in w for w in toxicity.STOP_WORDS.values())


def test_step_follows_the_slope():
    """The slopes that a step takes are those of the loss."""
    r = np.random.default_rng(2)
    net = toxicity.Net.new(5)
    net.embed = r.normal(0, 0.5, net.embed.shape)
    net.embed[0] = 0
    docs = [r.integers(1, toxicity.BUCKETS, (n, toxicity.UNITS)).astype(np.int32) for n in (1, 4, 9)] + [np.zeros((0, toxicity.UNITS), np.int32)]
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss(n: toxicity.Net) -> float:
        total = 0.0
        for d, t in zip(docs, y, strict=True):
            _, resp = n.responses(np.concatenate([d, np.zeros((toxicity.PAD, toxicity.UNITS), np.int32)]))
            z = float(n.logits(resp.max(axis=0)[None].astype(float))[0])
            total += math.log1p(math.exp(-z)) if t else math.log1p(math.exp(z))
        return total / len(docs)

    def copy() -> toxicity.Net:
        return toxicity.Net(net.embed.astype(np.float64), [f.astype(np.float64) for f in net.filters], *(x.astype(np.float64) for x in (net.bias, net.out, net.shift)), seen=[np.full(s.shape, 1.0) for s in net.seen])

    moved = copy()
    for s in moved.seen:
        s[:] = 1e12  # so that a step is the slope, scaled
    moved.step(docs, y, 1e6)
    for k, (a, b) in enumerate(zip(copy().arrays(), moved.arrays(), strict=True)):
        slope = a - b
        places = np.argwhere(np.abs(slope) > 1e-4)
        for at in places[:: max(1, len(places) // 12)]:
            up, down = copy(), copy()
            up.arrays()[k][tuple(at)] += 1e-3
            down.arrays()[k][tuple(at)] -= 1e-3
            assert abs((loss(up) - loss(down)) / 2e-3 - slope[tuple(at)]) < 0.02 * abs(slope[tuple(at)]) + 1e-3


def test_threshold():
    assert toxicity.threshold(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1]), 1.0) == 3.0
    assert toxicity.threshold(np.array([0.0, 1.0, 2.0, 3.0, 9.0]), np.array([0, 0, 1, 0, 1]), 10.0) == 6.0
    assert toxicity.threshold(np.array([2.0, 2.0]), np.array([1, 0]), 5.0) == 3.0


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "bad bad worse", None), (None, "bad", "de"), (3, "bad", "x")], "doc_id long, text string, score string")
    labels = "doc_id long, toxic int, part int"
    for rows in ([], [(1, 0, 1)], [(None, 1, 1), (3, None, 2)]):
        got = toxicity.fit(docs, spark.createDataFrame(rows, labels)).score(docs).collect()
        assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    both = toxicity.fit(docs, spark.createDataFrame([(1, 0, 1), (3, 1, 2), (3, 1, 2), (3, 0, 5)], labels), rounds=1)
    assert len(both.score(docs).collect()) == 5
    assert both.score(docs.limit(0)).collect() == []


def test_op11_query(spark):
    """Held-out labels, and scores that come from the text alone."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    rows = QUERIES["op11_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    caught = np.mean([p for p, y in held if y])
    alone = np.mean([1 - p for p, y in held if not y])
    print(f"op11 held out: {len(held)} rows, toxic caught {caught:.4f}, clean left alone {alone:.4f}")
    assert caught > 0.85 and alone > 0.99
