"""Odd rows of every operator, and the registered queries against brute force on a given table."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import entropy_spans, shingles
from tramline.llm import bpe, chat, secrets, sst
from tramline.llm.decontaminate import contamination
from tramline.llm.near_dedup import near_duplicates
from tramline.llm.quality import judged
from tramline.llm.quality_model import fit
from tramline.llm.queries import QUERIES
from tramline.llm.substring_dedup import remove_repeats
from tramline.llm.url_filter import Rule, judge

SF = "/root/testdata/sf0.001"
#: Names that operators use for themselves.
NAMES = "row_ n c0 s_text s_assign q_id q_key q_at q_host q_words m_n m_list m_parts h_host a_key u_key u_rule u_alias u_link rest row component lead member key near text_a bands words at h part run runs anchor source start kind x".split()


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def odd(spark):
    """Null, empty and very long texts, repeated and null ids, and columns of all kinds of names."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    data = [(1, None), (2, ""), (3, " \t\n "), (4, long), (4, long), (None, long[:3000]), (None, None), (5, "x" * 300_000), (6, "a b c"), (6, "a b c d"), (7, f"password=hunter2hunter2 {long[:500]} secret: abcdefgh1")]
    df = spark.createDataFrame([(i, t) for i, t in data], "doc_id long, text string")
    return df.withColumn("source", F.lit("h")).withColumns({n: F.lit(f"user {n}") for n in NAMES if n != "source"})


def kept(out, df, replaced=()):
    """The user's columns come back as they were."""
    assert [c for c in out.columns if c in df.columns and c not in replaced] == [c for c in df.columns if c not in replaced]
    same = [c for c in df.columns if c not in replaced]
    row = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in same)))
    assert Counter(r[0] for r in out.select(row).collect()) == Counter(r[0] for r in df.select(row).collect())


def test_secret_scan_keeps_columns(spark):
    df = odd(spark).withColumn("spans", F.lit("mine"))
    out = secrets.scan(df)
    kept(out, df, ("spans",))
    for r in out.collect():
        assert [s.kind for s in r.base_spans] == (["assign", "assign"] if r.doc_id == 7 else [])
    assert secrets.scan(df.limit(0)).collect() == []
    assert secrets.scan(df, allowed=()).count() == df.count()
    assert secrets.scan(df, classes=()).count() == df.count()


def test_secrets_in_a_long_text(spark):
    text = ("é lorem ipsum " * 200 + "token: abcdefgh12345 ") * 40
    r = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = [(m.start(), m.end()) for m in re.finditer(r"token: abcdefgh12345", text)]
    assert [(s.start, s.end) for s in r.spans] == want and len(want) == 40


def test_quality_keeps_columns(spark):
    df = odd(spark).withColumns({"kept": F.lit(3), "m_words": F.lit(4)})
    out = judged(df)
    kept(out, df, ("kept", "m_words"))
    assert {r.doc_id for r in out.where("base_failed").collect()} >= {1, 2, 3, 5, 6}
    assert judged(df.limit(0)).collect() == []


def test_url_filter_keeps_columns_and_follows_all_links(spark):
    two = '<link rel=canonical href="http://fine.net/a"><link rel="canonical" href="http://bad.net/b">'
    df = spark.createDataFrame([(1, "http://one.net/", two), (None, "http://two.net/", None), (3, None, ""), (4, "", "x" * 200_000), (1, "http://one.net/", two)], "page_id long, url string, html string")
    df = df.withColumns({n: F.lit(f"user {n}") for n in NAMES}).withColumn("verdict", F.lit("mine"))
    out = judge(df, (Rule("block", "bad.net", ""),))
    kept(out, df, ("verdict",))
    assert Counter((r.page_id, r.verdict) for r in out.collect()) == Counter({(1, "block"): 2, (None, "allow"): 1, (3, "allow"): 1, (4, "allow"): 1})


def test_other_operators_take_odd_rows(spark):
    df, n = odd(spark), 11
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (None, "a b"), (2, None), (3, "y" * 5000), (3, "y" * 5000)], "item_id long, text string").withColumn("size", F.lit(1))
    assert near_duplicates(df).count() == n
    assert remove_repeats(df).count() == n
    hits = {r.doc_id: r.n_hit for r in contamination(df, bench).collect()}
    assert hits[4] == 12 * 10 and hits[5] == 0
    assert bpe.encode(df, path).count() == n
    read = sst.read_shards(sst.write_shards(df, path, end_id=2)).collect()
    assert Counter(r.doc_id for r in read) == Counter(r.doc_id for r in df.collect())
    assert sorted(r.start for r in read) == [0, *np.cumsum([r.n_tokens for r in sorted(read, key=lambda r: r.start)]).tolist()][:-1]
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 1), (None, 0), (2, None)], "doc_id long, quality int")
    scores = fit(df, labels).score(df).collect()
    assert len(scores) == n and all(0 <= r.score <= 1 for r in scores)
    assert fit(df.limit(0), labels).score(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(df.withColumn("ids", F.lit(1)), path, keep=("ids",))


def test_long_benchmark_windows_are_compared_whole(spark):
    word = "z" * 400
    docs = spark.createDataFrame([(1, f"{word} tail"), (2, f"{word}z tail"), (3, f"a {word} b")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in contamination(docs, spark.createDataFrame([(9, word)], "item_id long, text string")).collect()}
    assert got == {1: (1, ["9"]), 2: (0, []), 3: (1, ["9"])}


def test_chat_takes_long_and_odd_events(spark):
    log = [(1, i, 0, "delta", "assistant", "<|im_end|>\\ " * 500) for i in range(300)] + [(None, 0, 0, "message", "user", None), (2, 1, 0, "edit", None, "never begun"), (3, None, 0, "message", "user", "x")]
    df = spark.createDataFrame(log, "conv_id long, seq long, msg long, op string, role string, text string")
    out = chat.render(chat.reconstruct(df)).select("conv_id", chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r.loss for r in out.collect()}
    assert got[1] == "<|im_end|>\\ " * 500 * 300


def test_pipeline_stages_judge_rows_without_ids(spark, tmp_path):
    """Contaminated and repeated rows go whatever their ids; clean ones and further columns stay."""
    say = lambda k, n=80: " ".join(f"{k}word{i}" for i in range(n))
    passage = say("item", 12)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    data = [(None, f"{say('a')} {passage}"), (None, say("b")), (None, say("b")), (1, say("c")), (1, say("d")), (1, say("d")), (2, f"{say('d')} more"), (3, None), (None, None), (4, f"{say('e')} {passage} {say('e')}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine") for i, t in data], "doc_id long, text string, lang string, source string, n_chars long, row string")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["decontaminate"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(x for x in data if passage not in (x[1] or ""))
    single = stages["near_dedup"](spark, docs, str(tmp_path))
    assert single.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in single.collect()) == Counter([data[0], data[1], data[3], data[4], (3, None), (None, None), data[9]])
    for name in ("quality_rules", "secret_scan"):
        assert stages[name](spark, docs, str(tmp_path)).columns == docs.columns
    assert stages["secret_scan"](spark, docs, str(tmp_path)).count() == len(data)
    assert set(stages["bpe"](spark, docs, str(tmp_path)).columns) == {"doc_id", "lang", "source", "n_chars", "row", "n_tokens", "ids", "decoded"}


def test_op1_query(spark, texts):
    for r in QUERIES["op1_secret_scan"](spark, SF).collect():
        t, base = texts[r.doc_id], []
        for k, p in enumerate(secrets.PATTERNS):
            base += [(m.start(), k, m.end(), p.kind) for m in re.finditer(p.regex, t, re.ASCII) if len(m[p.group]) >= p.least]
        base.sort()
        n = Counter(x[3] for x in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in base))
        high = [(a, 9, b, k) for k, a, b in set(entropy_spans(t)) if not any(x <= a and b <= y for x, _, y, _ in base)]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted([*base, *high]))


def test_op6_query(spark, texts):
    sets, root = {i: shingles(t, 4) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in index[x]).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
        for x in s:
            index[x].append(i)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op6_minhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def test_op8_query(spark):
    """Held-out labels: how often a document of label 1 is above one of label 0, and how often the prediction is right."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    rows = QUERIES["op8_quality_classifier"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    auc = np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad))
    right = np.mean([(s >= 0.5) == bool(y) for s, y in held])
    print(f"op8 held out: {len(held)} rows, AUC {auc:.4f}, accuracy {right:.4f}")
    assert auc > 0.9 and right > 0.85


def test_op8_fit_against_plain_loops(spark, texts):
    """The same pairs, their loss brought to its minimum step by step, the quantile and the scores."""
    import pyarrow as pa

    from tramline.llm import kernel, quality_model

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL")
    fitted = quality_model.fit(docs, labels)
    y = {r.doc_id: r.quality for r in labels.collect()}
    ids = sorted(i for i in y if i in texts)
    x = dict(zip(ids, quality_model.features(*kernel.text_bytes(pa.array([texts[i] for i in ids]))), strict=True))
    least = min(sum(y[i] for i in ids), sum(1 - y[i] for i in ids))
    deals = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(max(1, least // 2))).alias(f"b{k}") for k in range(4)]
    dealt = {r.doc_id: r for r in labels.select(F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", *deals).collect()}
    pairs = np.array([x[a] - x[b] for k in range(4) for a in ids if y[a] == 1 for b in ids if y[b] == 0 and dealt[a][f"b{k}"] == dealt[b][f"b{k}"]])
    spread = pairs.std(axis=0, ddof=1)
    used = spread > 0

    def loss(w):
        return np.mean(np.log1p(np.exp(-np.clip(pairs @ w, -500, 500)))) + 0.5e-3 * np.sum((w * 1.0)[used] ** 2 * _scale[used])

    # Weights are regularised as if every feature had the same spread over the turned pairs.
    turned = np.concatenate([pairs, -pairs])
    _scale = turned.std(axis=0) ** 2
    w = np.array(fitted.weights)
    gradient = -(pairs * (1 / (1 + np.exp(np.clip(pairs @ w, -500, 500))))[:, None]).mean(axis=0) + 1e-3 * w * _scale
    assert np.abs(gradient[used] / np.sqrt(_scale[used])).max() < 0.02  # at its minimum, but for the last steps
    r = np.random.default_rng(1)
    assert all(loss(w) <= loss(w + r.normal(0, 0.3, len(w)) * used / np.sqrt(np.maximum(_scale, 1e-12))) for _ in range(20))
    raw = np.array([x[i] @ w for i in ids])
    cut = np.percentile(raw, 100 * np.mean([1 - y[i] for i in ids]))
    assert fitted.cut_at == pytest.approx(cut, abs=1e-6)
    got = {r.doc_id: r.score for r in fitted.score(docs).collect()}
    assert all(got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(x[i] @ w - cut, -30, 30))), abs=1e-6) for i in ids)


def test_op9_query(spark, texts):
    lib = bpe.vocabulary(str(public_tokenizers.path("byte_bpe_50k.json"))).library()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_shards"](spark, SF).collect()}
    at = 0
    for i, t in sorted(texts.items()):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(texts)
