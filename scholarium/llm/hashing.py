"""Fingerprints of words, shingles and byte strings, computed over whole Arrow buffers with numpy.

A string is read in words of eight bytes, each mixed into the fingerprint by a step that is one-to-one in either argument:
strings of one length up to eight bytes never collide, longer ones only by chance, whatever they hold. Words of over
LONG bytes, which are rare, are hashed one by one with BLAKE2b. Where a result must not rest on fingerprints,
`exact_words` replaces them by numbers that are equal only for equal bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SEEDS = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _SEEDS.integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z, and all of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of the words `[^\x20\x09-\x0D]+`.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False
#: Texts are hashed in runs of whole documents of about so many bytes, longer documents in pieces: it bounds working arrays.
RUN_BYTES = 1 << 19
LONG = 128
#: What is left of eight bytes if only the first 0..8 count.
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def runs(at: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of documents with at most RUN_BYTES (or so many) each; a longer document is a run of its own."""
    first = 0
    while first < len(at) - 1:
        end = max(first + 1, int(np.searchsorted(at, at[first] + (most or RUN_BYTES), "right")) - 1)
        yield first, end
        first = end


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number; data must have seven bytes more than places are asked for."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,))


def _padded(data: np.ndarray, spare: int) -> np.ndarray:
    out = np.zeros(len(data) + spare, np.uint8)
    out[: len(data)] = data
    return out


def hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fingerprints of slices of the data."""
    lanes = eights(_padded(data, 8))
    h = mix((size.astype(np.uint64) * FACTORS[63]) ^ (lanes[first] & _FIRST[np.minimum(size, 8)]))
    for at in range(8, LONG, 8):
        rows = np.flatnonzero(size > at)
        if not len(rows):
            break
        h[rows] = mix(h[rows] ^ (lanes[first[rows] + at] & _FIRST[np.minimum(size[rows] - at, 8)]))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[first[i] : first[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def byte_grams(data: np.ndarray, q: int) -> np.ndarray:
    """The fingerprint of every q bytes in a row (q of eight at least)."""
    n = max(0, len(data) - q + 1)
    lanes, out = eights(data), np.zeros(n, np.uint64)
    for i, at in enumerate([*range(0, q - 8, 8), q - 8]):
        out += lanes[at : at + n] * FACTORS[i]
    return mix(out)


def _pieces(low: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about RUN_BYTES that cut no word."""
    at = 0
    while at < len(low):
        end = min(len(low), at + RUN_BYTES)
        if end < len(low):
            gaps = np.flatnonzero(~inside[at:end])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(~inside[end:])
                end = end + int(later[0]) + 1 if len(later) else len(low)
        yield at, end
        at = end


def words(data: np.ndarray, at: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of documents: each word's fingerprint, first byte, end, and number of its document within the run."""
    if at[-1] - at[0] > 2 * RUN_BYTES:
        parts = []
        for a, b in runs(at):
            if b > a + 1:
                parts.append((*words(data, at[a : b + 1], alphabet), a, at[a] - at[0]))
                continue
            inside = alphabet[LOWER[data[at[a] : at[b]]]]
            for low, high in _pieces(data[at[a] : at[b]], inside):
                parts.append((*_words(data, np.array([at[a] + low, at[a] + high]), alphabet), a, at[a] + low - at[0]))
        h, first, end, doc = (np.concatenate([p[i] + (p[5] if i in (1, 2) else p[4] if i == 3 else U(0)) for p in parts]) for i in range(4))
        return h, first, end, doc
    return _words(data, at, alphabet)


def _words(data: np.ndarray, at: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    origin, n = at[0], int(at[-1] - at[0])
    low = LOWER[data[origin : at[-1]]]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = alphabet[low]
    begins = inside[1:] & ~inside[:-1]
    cut = (at - origin)[1:-1]
    cut = cut[cut < n]
    begins[cut] = inside[1:][cut]
    ends = inside[1:-1] & ~inside[2:]
    cut = cut[cut > 0]
    ends[cut - 1] = inside[1:-1][cut - 1]
    first, end = np.flatnonzero(begins[:n]), np.flatnonzero(ends) + 1
    doc = np.searchsorted(at - origin, first, "right") - 1
    return hashes(low, first, end - first), first, end, doc


def exact_slices(data: np.ndarray, h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each slice that only equal slices share: fingerprints are compared with the bytes that they stand for."""
    _, index, number = np.unique(h, return_index=True, return_inverse=True)
    same = index[number]  # a slice of the same fingerprint
    equal, lanes = size == size[same], eights(_padded(data, 8))
    for place in range(0, LONG, 8):
        rows = np.flatnonzero(equal & (size > place) & (size <= LONG))
        if not len(rows):
            break
        part = _FIRST[np.minimum(size[rows] - place, 8)]
        equal[rows] = (lanes[first[rows] + place] & part) == (lanes[first[same[rows]] + place] & part)
    for i in np.flatnonzero(equal & (size > LONG)).tolist():
        equal[i] = np.array_equal(data[first[i] : first[i] + size[i]], data[first[same[i]] : first[same[i]] + size[i]])
    if equal.all():
        return number
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[a : a + n].tobytes(), len(known)) for a, n in zip(first.tolist(), size.tolist(), strict=True)], np.int64)


def exact_words(data: np.ndarray, at: np.ndarray, h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word that only equal words share."""
    return exact_slices(LOWER[data[at[0] : at[-1]]], h, first, end - first)


def slices(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of up to len(FACTORS) - 4 values in a row from each of `first`, n of them."""
    out = np.zeros(len(first), np.uint64)
    for j in range(int(n.max(initial=0))):
        rows = np.flatnonzero(n > j)
        out[rows] += h[first[rows] + j] * FACTORS[j]
    return mix(out + n.astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of every k words in a row (documents are not told apart here)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * FACTORS[j % 60]
        if j % 60 == 59:
            out = mix(out)
    return mix(out + U(k))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        done += step
    return h
