"""Byte-pair encoding and decoding with the vocabulary files of public tokenizers.

Texts are cut into words by character class, equal words of a slice are encoded
once, and the merges run on contiguous rank arrays: a word is a row of parts and
of the ranks of its adjacent pairs; the smallest rank is found by a scan, its
boundary is deleted, and the ranks of both neighbours are refreshed.  All words
of about one length take their steps together.  The method is one for short words:
words of more than 64 bytes, where repeated scans would be quadratic, are merged
by the tokenizers library.  Texts are cut at the strings of special tokens, which
have ids of their own.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tramline.llm import kernel as K

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
_NONE = np.int32((1 << 24) - 1)
_LENGTHS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64)
#: The characters that Unicode's White_Space property holds.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point; UNKNOWN for those that Python's Unicode tables don't have."""
    kinds = {"L": LETTER, "N": NUMBER}
    names = (unicodedata.category(chr(c)) for c in range(0x110000))
    out = np.fromiter((UNKNOWN if x == "Cn" else kinds.get(x[0], OTHER) for x in names), np.uint8, 0x110000)
    out[_WHITE] = SPACE
    return out


@functools.cache
def _asked(code: int) -> int:
    """The class of a code point by the tokenizers library, whose Unicode tables may be newer."""
    from tokenizers import Regex, pre_tokenizers

    for pattern, kind in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        if not pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(chr(code)):
            return kind
    return OTHER


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, extra = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in names:
            names[b] = chr(extra)
            extra += 1
    return [names[b] for b in range(256)]


@dataclass
class Vocabulary:
    """What encoding and decoding need of a vocabulary file."""

    path: str
    lower: bool  # normalise to NFC and lower case
    attach: bool  # a blank belongs to the word that follows; other white space is kept
    inner: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    factor: np.uint64
    names: list[bytes]
    special: dict[str, int]
    cuts: re.Pattern | None  # the special tokens' strings
    plain: list[bytes]  # the bytes that each token stands for
    joined: bool  # decoding joins the tokens' names by blanks instead of mapping bytes back

    def library(self):  # noqa: ANN201
        return _library(self.path)


@functools.cache
def _library(path: str):  # noqa: ANN202
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    model, vocab = j["model"], j["model"]["vocab"]
    end = model.get("end_of_word_suffix") or ""
    names = _byte_names()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=K.U64)
    made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
    special = {t["content"]: t["id"] for t in j["added_tokens"]}
    size = 1 + max([*vocab.values(), *special.values()])
    strings = [b""] * size
    for token, i in [*vocab.items(), *special.items()]:
        strings[i] = token.encode()
    back = {c: b for b, c in enumerate(names)}
    plain = [x if x.decode() in special else bytes(back.get(c, 0) for c in x.decode()) for x in strings]
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    keys, ranks, factor = _hashed(pairs)
    kind = j["pre_tokenizer"]["type"]
    return Vocabulary(
        path, bool(j["normalizer"]), kind == "ByteLevel",
        np.array([vocab[c] for c in names], np.int32), np.array([vocab[c + end] for c in names], np.int32),
        keys, ranks, np.append(made, -1), factor, strings, special, cuts, plain, j["decoder"] is None,
    )


def _hashed(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """A table of four places per slot for rank by pair; a factor is sought for which no slot overflows."""
    bits = max(4, int(len(pairs)).bit_length() + 1)
    for trial in range(1000):
        factor = K.mix(np.array([trial], K.U64))[0] | K.U64(1)
        slot = ((pairs * factor) >> K.U64(64 - bits)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        first = np.searchsorted(slot[order], slot[order])
        place = np.arange(len(pairs)) - first
        if not len(place) or place.max() < 4:
            keys = np.full((4, 1 << bits), 2**64 - 1, dtype=K.U64)
            ranks = np.full((4, 1 << bits), _NONE, dtype=np.int32)
            keys[place, slot[order]] = pairs[order]
            ranks[place, slot[order]] = order
            return keys, ranks, factor
    raise ValueError("no factor found")


def _ranks(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of each pair of parts, _NONE where they don't merge."""
    key = (a.astype(K.U64) << K.U64(32)) | b.astype(np.uint32).astype(K.U64)
    slot = ((key * v.factor) >> K.U64(64 - int(v.keys.shape[1]).bit_length() + 1)).astype(np.int64)
    out = np.full(len(key), _NONE, np.int32)
    for place in range(4):
        hit = v.keys[place][slot] == key
        out = np.where(hit, v.ranks[place][slot], out)
    return out


def _merge(v: Vocabulary, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts (a column per word, -1 after its end) and their number, of words of up to `width` bytes."""
    n = len(starts)
    cols = np.arange(width)[:, None]
    raw = data[np.minimum(starts + cols, len(data) - 1)]
    parts = v.inner[raw]
    parts[sizes - 1, np.arange(n)] = v.last[raw[sizes - 1, np.arange(n)]]
    parts[cols >= sizes] = -1
    if width == 1:
        return parts, sizes.copy()
    flat = _ranks(v, parts[:-1].ravel(), parts[1:].ravel()).reshape(width - 1, n)
    flat[parts[1:] < 0] = _NONE
    out, left = np.full((width, n), -1, np.int32), sizes.copy()
    who, ranks = np.arange(n), flat
    place = np.arange(width - 1, dtype=np.int32)[:, None]
    while len(who):
        best = ((ranks << 7) | place[: len(ranks)]).min(axis=0)
        rank, at = best >> 7, best & 127
        done = rank >= _NONE
        if done.any():
            out[: len(parts), who[done]] = parts[:, done]
            go = ~done
            who, parts, ranks, rank, at = who[go], parts[:, go], ranks[:, go], rank[go], at[go]
            if not len(who):
                break
        m, top = np.arange(len(who)), len(parts)
        parts[at, m] = v.made[rank]
        for c in range(int(at.min()), top - 1):  # delete the boundary after the merged part
            np.copyto(parts[c], parts[c + 1], where=at < c)
            if c < top - 2:
                np.copyto(ranks[c], ranks[c + 1], where=at <= c)
        parts[top - 1] = -1
        ranks[top - 2] = _NONE
        left[who] -= 1
        if top == 2:
            out[0, who] = parts[0]
            break
        parts, ranks, top = parts[:-1], ranks[:-1], top - 1
        here, inside = parts[at, m], at < top - 1
        after = parts[at[inside] + 1, m[inside]]
        fresh = _ranks(v, here[inside], after)
        fresh[after < 0] = _NONE
        ranks[at[inside], m[inside]] = fresh
        back = at > 0
        ranks[at[back] - 1, m[back]] = _ranks(v, parts[at[back] - 1, m[back]], here[back])
    return out, left


def encode_words(v: Vocabulary, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the words one after another, and the number of each word's tokens."""
    pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0
    for width in (1, *_LENGTHS):
        who = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        for a in range(0, len(who), 1 << 15):
            part = who[a : a + (1 << 15)]
            parts, count = _merge(v, data, starts[part], sizes[part], width)
            pieces.append((part, count, parts.T[parts.T >= 0]))
    counts = np.zeros(len(starts), np.int64)
    who = np.flatnonzero(sizes > low)
    for i in who.tolist():
        ids = np.array(_long(v, data[starts[i] : starts[i] + sizes[i]].tobytes()), np.int32)
        pieces.append((np.array([i]), np.array([len(ids)]), ids))
    for part, count, _ in pieces:
        counts[part] = count
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    for part, count, ids in pieces:
        out[np.repeat(begin[part] - (np.cumsum(count) - count), count) + np.arange(len(ids))] = ids
    return out, counts


def _long(v: Vocabulary, word: bytes) -> list[int]:
    """One word by the library's own merges; its pre-tokenizer leaves a word whole."""
    return v.library().encode(word.decode(), add_special_tokens=False).ids


class _Seen:
    """Words that this worker has encoded lately; it starts anew when it is full."""

    def __init__(self, words: int = 150_000, ids: int = 1_500_000) -> None:
        self.most = words, ids
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.first, self.count, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)
        self.words = self.used = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        for name, used, more in (("first", self.words, len(counts)), ("count", self.words, len(counts)), ("ids", self.used, len(ids))):
            old = getattr(self, name)
            if used + more > len(old):
                grown = np.zeros(2 * (used + more), old.dtype)
                grown[:used] = old[:used]
                setattr(self, name, grown)
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[self.words : self.words + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[self.words : self.words + len(counts)] = counts
        self.words, self.used = self.words + len(counts), self.used + len(ids)


@functools.cache
def _seen(path: str) -> _Seen:
    return _Seen()


def _numbered(v: Vocabulary, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[_Seen, np.ndarray]:
    """Where the words stand among those seen; new ones are encoded."""
    seen = _seen(v.path)
    if seen.words > seen.most[0] or seen.used > seen.most[1]:
        seen.clear()
    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    at = np.fromiter((seen.index.get(w, -1) for w in words), np.int64, len(words))
    new = np.flatnonzero(at < 0)
    at[new] = np.arange(seen.words, seen.words + len(new))
    seen.index.update((words[i], j) for i, j in zip(new.tolist(), at[new].tolist(), strict=True))
    seen.add(*encode_words(v, data, starts[new], ends[new] - starts[new]))
    return seen, at


def word_starts(v: Vocabulary, points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in code points, of the words that the vocabulary's pattern finds."""
    n = len(points)
    kind = _classes()[points]
    if (kind == UNKNOWN).any():
        newer = np.flatnonzero(kind == UNKNOWN)
        kind[newer] = [_asked(c) for c in points[newer].tolist()]
    start = np.ones(n + 1, dtype=bool)
    start[1:n] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    start |= edge
    if not v.attach:
        start[:n] |= kind == NUMBER
    blank = np.zeros(n + 1, dtype=bool)
    blank[1:] = points == 0x20
    # 's 't 're 've 'm 'll 'd: an apostrophe of its own, not after a blank that would belong to it
    quote = np.flatnonzero((points == 0x27) & start[:n] & start[1:] & ~edge[1:])
    if v.attach:
        quote = quote[~blank[quote] | edge[quote]]
    if len(quote):
        text = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = text[quote + 1], text[quote + 2]
        pair = ~edge[np.minimum(quote + 2, n)]
        size = np.zeros(len(quote), np.int64)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b)) & pair] = 2
        for a in "stmd":
            size[one == ord(a)] = 1
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + 1 + size] = True
    if v.attach:
        first = np.flatnonzero(start[:n] & (kind != SPACE))
        first = first[(first > 0) & ~edge[first]]
        first = first[kind[first - 1] == SPACE]
        start[first - 1] = True
        start[first[points[first - 1] == 0x20]] = False
    at = np.flatnonzero(start)
    begin, end = at[:-1], at[1:]
    if not v.attach:
        word = kind[begin] != SPACE
        begin, end = begin[word], end[word]
    return begin, end


def _prepared(v: Vocabulary, text: str) -> str:
    if v.lower and not text.isascii():
        if (_classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == UNKNOWN).any():
            return v.library().normalizer.normalize_str(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter, whatever its place in the word
    return text.lower() if v.lower else text


def encode_texts(v: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    """Token ids of each text."""
    if not (v.cuts and any(s in t for t in texts for s in v.special)):
        return _encoded(v, texts)
    parts = [v.cuts.split(t) for t in texts]  # texts between special tokens and these by turns
    found = iter(_encoded(v, [t for p in parts for t in p[::2]]))
    return [np.concatenate([next(found) if i % 2 == 0 else np.array([v.special[t]], np.int32) for i, t in enumerate(p)]) for p in parts]


def _encoded(v: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    texts = [_prepared(v, t) for t in texts]
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    offs = np.cumsum([0, *map(len, texts)])
    begin, end = word_starts(v, points, offs)
    size = np.ones(len(points), np.int64)
    for limit in (0x80, 0x800, 0x10000):
        size += points >= limit
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    del size, points
    raw = whole.encode()
    data = np.frombuffer(raw, np.uint8)
    del whole
    word = np.searchsorted(begin, offs)
    begin, end = at[begin], at[end]
    where, which = K.numbered(data, begin, end, K.span_hashes(data, begin, end))
    seen, at = _numbered(v, raw, data, begin[where], end[where])
    first, number = seen.first[at][which], seen.count[at][which]
    total = np.cumsum(number)
    flat = seen.ids[np.repeat(first - (total - number), number) + np.arange(total[-1] if len(total) else 0)]
    cuts = np.concatenate([[0], total])[word]
    return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    if v.joined:
        return b" ".join(map(v.names.__getitem__, ids.tolist())).decode()
    return b"".join(map(v.plain.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _encode(batches: Iterator[pa.RecordBatch], path: str, decoded: bool) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for whole in batches:
        for batch in K.slices(whole, most=1 << 19):
            ids = encode_texts(v, [t or "" for t in batch.column("text").to_pylist()])
            kept = [i for i, c in enumerate(batch.schema.names) if c != "text"]
            out = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            if decoded:
                out.append(pa.array([decode_ids(v, x) for x in ids], pa.string()))
            names = ["n_tokens", "ids", "decoded"][: len(out)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *out], names=[*(batch.schema.names[i] for i in kept), *names])
    # The worker may serve other operators next, which need the memory.
    _seen(path).clear()
    pa.default_memory_pool().release_unused()


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for whole in batches:
        for batch in K.slices(whole, "ids", most=1 << 20):
            texts = [decode_ids(v, np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])


def encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """(doc_id, the columns to keep, n_tokens, ids) of each row, and decoded, what the ids decode to, if that is asked for.

    ids are little-endian unsigned 32-bit integers; no special tokens are added,
    but their strings in a text are encoded as such.  Null texts count as empty and
    have no tokens.  Ids may be null or repeated: rows are encoded one by one, and
    so equal rows alike, whole whatever their length.  Other columns are left out;
    of those kept none may be called doc_id, text, n_tokens, ids or decoded, which
    raises a ValueError.
    """
    if clash := {"doc_id", "text", "n_tokens", "ids", "decoded"} & set(keep):
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("text"))
    fields = [*(f for f in docs.schema.fields if f.name != "text"), StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    if decoded:
        fields.append(StructField("decoded", StringType()))
    return docs.mapInArrow(lambda it: _encode(it, path, decoded), StructType(fields))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of a table with ids, and decoded; null ids decode to the empty text.  A column decoded raises a ValueError."""
    if "decoded" in encoded.columns:
        raise ValueError("the table has a column decoded")
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(lambda it: _decode(it, path), schema)
