"""Equality of words, shingles and windows where hashes are weak or texts are crafted, and recall on the given tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tramline.llm import bpe, near_dedup, sst
from tramline.llm import kernel as K
from tramline.llm.near_dedup import deduplicated, near_duplicates
from tramline.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARIES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that many polynomial hashes modulo a power of two don't tell apart."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


T, S = thue_morse(2048)


@pytest.fixture
def weak(monkeypatch):
    """Word and shingle hashes of four bits."""
    strong = K._scrambled
    monkeypatch.setattr(K, "_scrambled", lambda h, seed: strong(h, seed) & K.U64(15))


def path(name: str) -> str:
    return str(public_tokenizers.path(name))


@pytest.mark.parametrize("name", VOCABULARIES)
def test_crafted_words_are_encoded_apart(spark, name):
    lib = bpe.vocabulary(path(name)).library()
    texts = [f"{T} {S}", f"{T}\n{S}", f"{S[:60]} {T[:60]} {S[:1024]}{T}"]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path(name), decoded=True).collect()
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)
    shards = sst.read_shards(sst.write_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path(name))).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in shards} == {i: lib.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_crafted_words_are_no_near_duplicates(spark):
    df = spark.createDataFrame([(1, f"{T} a b c"), (2, f"{S} a b c"), (3, f"{T} a b c d"), (4, f"{T.upper()} a b c")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, words=4).collect()}
    assert got == {1: (1, 1, True), 2: (1, 2, True), 3: (2, 3, True), 4: (1, 1, False)}


def test_crafted_words_begin_no_passage(spark):
    rest = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{T} {rest}"), (2, f"{S} {rest}"), (3, f"x {T} {rest} y"), (4, " ".join(T[:1500])), (5, " ".join(S[:1500]))], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in remove_repeats(df).collect()}
    first: dict[tuple, int] = {}
    for r in sorted(df.collect()):
        w = r.text.split()
        gone = {q for j in range(len(w) - 12) if first.setdefault(tuple(w[j : j + 13]), r.doc_id) < r.doc_id for q in range(j, j + 13)}
        assert got[r.doc_id] == len(gone)
    assert (got[2], got[3]) == (0, 13)


def texts_of(seed: int, n: int = 80) -> list[str]:
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcd"), r.integers(1, 5))) for _ in range(60)] + [T, S, "x" * 65, "x" * 66]
    out = [" ".join(r.choice(words, r.integers(0, 60))) for _ in range(n)]
    return out + [out[3] + " more", out[3], "", "one two", "two one", "one two"]


def test_weak_hashes_number_words(weak):
    data, offs = K.text_bytes(pa.array(texts_of(1)))
    starts, ends, _ = K.word_spans(data, offs)
    hashes = K.span_hashes(data, starts, ends)
    assert len(np.unique(hashes)) <= 16
    where, which = K.numbered(data, starts, ends, hashes)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert [words[i] for i in where[which]] == words
    assert len(where) == len(set(words))


@pytest.mark.parametrize("k", [1, 3, 5])
def test_weak_hashes_number_shingles(weak, k):
    texts = texts_of(2)
    data, offs = K.text_bytes(pa.array(texts))
    owner, _, which = K.shingle_numbers(data, offs, k)
    want = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()} for w in map(str.split, texts)]
    assert np.bincount(owner, minlength=len(texts)).tolist() == list(map(len, want))
    for i in range(len(texts)):
        for j in range(i, len(texts)):
            both = len(set(which[owner == i].tolist()) & set(which[owner == j].tolist()))
            assert both == len(want[i] & want[j])


@pytest.mark.parametrize("name", VOCABULARIES)
def test_weak_hashes_encode(weak, name):
    v = bpe.vocabulary(path(name))
    texts = texts_of(3)
    for got, t in zip(bpe.encode_texts(v, texts), texts, strict=True):
        assert got.tolist() == v.library().encode(t, add_special_tokens=False).ids


def test_weak_hashes_confirm(weak):
    """Links are confirmed on words; rows of one lead come in several batches."""
    texts = texts_of(4)
    rows = [(i, lead, int(i != lead), texts[i]) for lead in (3, 7, 60, 82) for i in [lead, *(j for j in range(len(texts)) if j != lead)]]
    table = pa.table(dict(zip(("member", "lead", "rank", "text"), zip(*rows, strict=True), strict=True)))
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []) for w in map(str.split, texts)]
    want = Counter()
    for i, lead, rank, _ in rows:
        if rank:
            both, union = len(sets[i] & sets[lead]), len(sets[i] | sets[lead])
            want[i, lead, union - both, both > 0 and 100 * both >= 80 * union] += 1
    for size in (1, 7, 50, 1000):
        got = Counter(tuple(r.values()) for b in near_dedup._confirm(iter(table.to_batches(size)), 4, 80) for r in b.to_pylist())
        assert got == want


@pytest.mark.parametrize("name", VOCABULARIES)
def test_all_code_points(name):
    """Every code point, also those that are newer than Python's Unicode tables, is encoded as the library does."""
    v = bpe.vocabulary(path(name))
    codes = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c} x{c}1" for c in codes[i : i + 500]) for i in range(0, 0x33480, 500)] + ["".join(codes[i : i + 4000]) for i in range(0x33480, len(codes), 4000)]
    lib = v.library()
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        for got, want, t in zip(bpe.encode_texts(v, part), lib.encode_batch(part, add_special_tokens=False), part, strict=True):
            assert got.tolist() == want.ids, hex(ord(t[0]))


@pytest.mark.parametrize("name", VOCABULARIES)
def test_special_tokens_in_texts(name):
    v = bpe.vocabulary(path(name))
    texts = ["<|endoftext|>", "a<|endoftext|>b", " it<|endoftext|><|endoftext|>'s <|startoftext|> É", "<|ENDOFTEXT|> <|endoftext", f"{T} <|endoftext|> {S}"]
    for got, t in zip(bpe.encode_texts(v, texts), texts, strict=True):
        assert got.tolist() == v.library().encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_near_duplicate_recall(spark, sf):
    """Every row with an id divisible by 50 against all rows: pairs at 0.8 or more that are in one component."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    comp = {r.doc_id: r.component_id for r in near_duplicates(docs, words=4).select("doc_id", "component_id").collect()}
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sizes, index = {}, defaultdict(list)
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r.text or "").translate(lower))
        s = {hash(tuple(w[i : i + 4])) for i in range(len(w) - 3)} if len(w) >= 4 else {hash(tuple(w))} if w else set()
        sizes[r.doc_id] = len(s)
        sets[r.doc_id] = s
        for x in s if r.doc_id % 50 == 0 else ():
            index[x].append(r.doc_id)
    found = pairs = 0
    for d, s in sets.items():
        for q, both in Counter(q for x in s for q in index.get(x, ())).items():
            if q != d and 100 * both >= 80 * (sizes[q] + sizes[d] - both):
                pairs += 1
                found += comp[q] == comp[d]
    assert pairs > 0
    assert found == pairs


def test_deduplicated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    data = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (None, None, "c"), (2, text + " more", "d"), (None, "z " * 50, "e"), (None, "z " * 50, "e"), (7, "other words stand here for now", "f"), (5, "", None), (5, text + " less", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, `c.1` string").selectExpr("doc_id", "text", "`c.1` AS row", "1 AS component", "2 AS lead")
    out = deduplicated(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text, r.row, r.component, r.lead) for r in out.collect())
    assert got == Counter((i, t, c, 1, 2) for i, t, c in [(1, text, "a"), (None, None, "c"), (None, "z " * 50, "e"), (7, "other words stand here for now", "f"), (5, "", None)])
    assert deduplicated(df.limit(0)).collect() == []
