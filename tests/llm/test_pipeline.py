"""The corpus pipeline against brute force, and the operators' SQL on the smallest tables."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.oracle import same
from tramline.llm import bpe, secrets
from tramline.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    same(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name])


def rows() -> tuple[list[tuple], list[tuple]]:
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(3, 9))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = text(200), text(40)
    docs: list[str | None] = [None, "", "short text", "la " * 200, base, base]
    for _ in range(4):
        w = base.split()
        w[r.randrange(len(w))] = "changed"
        docs.append(" ".join(w))
    docs += [f"{text(60)} {' '.join(passage.split()[5:20])} {text(30)}", f"{text(100)} password=hunter2hunter2 {text(20)}", text(5000)]
    docs += [f"{text(80)}\nshared footer line of the host\n{text(20)}" for _ in range(25)]
    docs += [f"{text(90)}, {text(20).upper()}" for _ in range(20)]
    return [(i * 2, t, "en", "h" if i < 60 else "g", len(t or "")) for i, t in enumerate(docs)], [(1, passage), (2, None), (3, "")]


def sim(a: str, b: str) -> bool:
    def grams(t: str) -> set:
        w = WORD.findall(t.translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    x, y = grams(a), grams(b)
    return 100 * len(x & y) >= 80 * len(x | y)


def test_pipeline(spark, tmp_path):
    docs, items = rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept: dict[int, str] = {}
    for i, t, *_ in docs:
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 3)} if len(w) < 4000 else set()
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w):
            kept[i] = "\n".join(x for x in t.split("\n") if x != "shared footer line of the host")
    first: dict[int, str] = {}
    for i, t in sorted(kept.items()):
        if not any(sim(t, u) for u in first.values()):
            first[i] = t
    bench = [ITEM.findall((t or "").translate(LOWER)) for _, t in items]
    windows = {tuple(w[k : k + 10]) for w in bench for k in range(len(w) - 9)}
    clean = {i: t for i, t in first.items() if not any(tuple(w[k : k + 10]) in windows for w in [ITEM.findall(t.translate(LOWER))] for k in range(len(w) - 9))}
    assert 5 < len(clean) < len(first) < len(kept)
    path = str(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    lib = bpe.vocabulary(path).library()
    assert set(got) == set(clean)
    marked = 0
    for i, t in clean.items():
        red = re.sub(secrets.PATTERNS[0].regex, lambda m: "[REDACTED]" if len(m[2]) >= 8 else m[0], t)
        marked += red != t
        ids = lib.encode(red, add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert (got[i].n_tokens, got[i].n_chars, got[i].source) == (len(ids), len(red), "h" if i < 120 else "g")
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)
    assert marked == 1


def test_pipeline_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []
