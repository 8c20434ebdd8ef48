"""Vectorised text kernels shared by the operators that run Arrow batches.

A batch of texts is one byte array with document offsets.  Words are found by
byte class and hashed eight bytes at a time, each step through a bijective
64-bit finaliser; long words are hashed by BLAKE2b.  Hashes only sort and group:
where two words or shingles are taken as equal, numbered() and shingle_numbers()
have compared their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_PAD = U64(0xD6E8FEB86659FD93)
_LONG = 64  # bytes; longer words are hashed and compared one by one

_SPACE = np.ones(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The low n bytes of a long.
_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offs = offs.astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, so that memory stays bounded."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    if not len(sizes):
        return
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without space and 9-13), and each row's range in them."""
    n = len(data)
    inside = _SPACE[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    first = offs[:-1]
    before[first[first < n]] = False
    last = offs[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _longs(data: np.ndarray) -> np.ndarray:
    """At each byte the eight that begin there, as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def _scrambled(h: np.ndarray, seed: int) -> np.ndarray:
    """The last step of every hash of words and shingles."""
    return mix(h, seed)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    sizes = ends - starts
    out = mix(sizes.astype(U64), seed)
    longs, who, at = _longs(data), np.flatnonzero(sizes > 0), 0
    far = who[sizes[who] > _LONG]
    who = who[sizes[who] <= _LONG]
    while len(who):
        left = sizes[who] - at
        x = longs[starts[who] + at] & _BYTES[np.minimum(left, 8)]
        out[who] = mix((out[who] ^ x) * _STEP, at + 1)
        at += 8
        who = who[left > 8]
    for i in far.tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].data, digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return _scrambled(out, seed)


def _equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span holds the same bytes as the span of the same list that `other` names."""
    sizes = ends - starts
    good = sizes == sizes[other]
    longs, at = _longs(data), 0
    who = np.flatnonzero(good & (other != np.arange(len(other))))
    far = who[sizes[who] > _LONG]
    who = who[sizes[who] <= _LONG]
    while len(who):
        left = sizes[who] - at
        mask = _BYTES[np.minimum(left, 8)]
        same = ((longs[starts[who] + at] ^ longs[starts[other[who]] + at]) & mask) == 0
        good[who[~same]] = False
        at += 8
        who = who[same & (left > 8)]
    for i in far.tolist():
        j = other[i]
        good[i] = np.array_equal(data[starts[i] : ends[i]], data[starts[j] : ends[j]])
    return good


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers the distinct spans from 0: one place of each, and each span's number.

    Spans of equal hash are compared; where two differ all are told apart by their bytes.
    """
    _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
    if not _equal(data, starts, ends, where[which]).all():
        known: dict[bytes, int] = {}
        raw = data.tobytes()
        which = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        _, where = np.unique(which, return_index=True)
    return where, which


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes; row boundaries are the caller's business."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = words[:n].copy()
    for i in range(1, k):
        out = mix(out * _STEP ^ words[i : i + n], i)
    return _scrambled(out, k)


def shingle_numbers(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of k words of each row: row, hash, and a number that only equal shingles of the call share.

    A row of fewer words has one shingle of all of them, a row without words none.
    Rows come in order.
    """
    starts, ends, rows = word_spans(data, offs)
    words = span_hashes(data, starts, ends)
    number = numbered(data, starts, ends, words)[1].astype(np.int32)
    count = np.diff(rows)
    owner = np.repeat(np.arange(len(count), dtype=np.int32), count)
    at = np.arange(len(words))
    room = np.repeat(rows[1:], count) - at  # words up to the row's end
    at = at[(room >= k) | ((count[owner] < k) & (at == rows[:-1][owner]))]
    owner, room = owner[at], room[at]
    words, number = np.append(words, _PAD), np.append(number, -1)
    h, places = words[at], [at]
    for j in range(1, k):  # where a row has fewer words, the rest is padding
        places.append(np.where(room > j, at + j, len(words) - 1))
        h = mix(h * _STEP ^ words[places[j]], j)
    h = _scrambled(h, k)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    which = np.empty(len(h), np.int64)
    for p in places:
        sorted_ = number[p[order]]
        if not (new[1:] | (sorted_[1:] == sorted_[:-1])).all():  # different words, equal hashes
            _, which = np.unique(np.stack([number[p] for p in places], axis=1), axis=0, return_inverse=True)
            order = np.argsort(which, kind="stable")
            new[1:] = which[order[1:]] != which[order[:-1]]
            break
    which[order] = np.cumsum(new) - 1
    new[1:] |= owner[order[1:]] != owner[order[:-1]]
    first = np.sort(order[new])
    return owner[first], h[first], which[first]


def run_digests(words: list[np.ndarray], starts: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each list of word hashes a 64-bit hash of each run of words; lists of different seeds make a digest of 64 bits each."""
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    longest = int(counts[0]) if len(counts) else 0
    live = [int(np.searchsorted(-counts, -j, side="left")) for j in range(longest)]  # runs of more than j words come first
    out = []
    for lane, hashes in enumerate(words):
        h = mix(counts.astype(U64), lane)
        for j, n in enumerate(live):
            h[:n] = mix((h[:n] ^ hashes[starts[:n] + j]) * _STEP, 2 * j + lane)
        back = np.empty_like(h)
        back[order] = h
        out.append(back)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)
