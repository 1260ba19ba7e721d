"""Word and shingle hashes of whole texts, vectorised over batches.

Words are runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text; A-Z count as a-z. Hashes are 64 bits:
two different words or shingles fall together with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_OF_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_OF_BYTE[SPACE] = 0
_LONGEST = 4096
_OF_PLACE = _rng.integers(1, 2**63, _LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OF_SLOT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20
#: A word's mark: its first MARK_BYTES bytes as a polynomial in MARK_BASE modulo MARK_PRIME, which SQL can compute, too.
MARK_BYTES, MARK_BASE, MARK_PRIME = 32, 1_103_515_245, (1 << 31) - 1
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] = _LOWER[97:123]
_LOWER[SPACE] = 0
_OF_MARK = np.zeros(_LONGEST, dtype=np.uint64)
_OF_MARK[:MARK_BYTES] = [pow(MARK_BASE, i, MARK_PRIME) for i in range(MARK_BYTES)]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes together."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or b"") + 1
        if held >= CHUNK:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, words before each text and in all, start and end byte of each word in its text)."""
    return marked_words(texts, False)[:4]


def marked_words(texts: list[bytes | None], marks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """As words, and the words' marks."""
    blob = b"\n".join([t or b"" for t in texts]) + b"\n"
    buf = np.frombuffer(blob, dtype=np.uint8)
    sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    text_at = np.concatenate([[0], np.cumsum(sizes)])
    inside = ~SPACE[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(buf) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), start, end, np.zeros(0, np.int64)
    place = np.arange(len(buf), dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(buf)]])))
    with np.errstate(over="ignore"):
        place &= _LONGEST - 1  # a power of two
        weight = _OF_BYTE.take(buf)
        weight *= _OF_PLACE.take(place)
        h = mix(np.add.reduceat(weight, start))
    for k in np.flatnonzero(end - start > _LONGEST):
        h[k] = int.from_bytes(hashlib.blake2b(bytes(blob[start[k] : end[k]]).lower(), digest_size=8).digest(), "little")
    before = np.searchsorted(start, text_at)
    own = np.repeat(text_at[:-1], np.diff(before))
    mark = None
    if marks:
        weight = _LOWER.take(buf)
        weight *= _OF_MARK.take(place)
        mark = (np.add.reduceat(weight, start) % np.uint64(MARK_PRIME)).astype(np.int64)
        for k in np.flatnonzero(end - start > _LONGEST):  # where places begin anew
            first = buf[start[k] : start[k] + MARK_BYTES]
            mark[k] = int((_LOWER[first] * _OF_MARK[:MARK_BYTES]).sum()) % MARK_PRIME
    return h, before, start - own, end - own, mark


def windows(h: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, runs before each text and in all). A text of 1 to k-1 words has one run: all of it."""
    n = np.diff(before)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(at[-1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            full = np.zeros(len(h) - k + 1, dtype=np.uint64)
            for j in range(k):
                full += h[j : j + len(full)] * _OF_SLOT[j]
            long = n >= k
            first = np.repeat(before[:-1][long] - at[:-1][long], count[long])
            where = np.flatnonzero(np.repeat(long, count))
            out[where] = full[where + first]
        for i in np.flatnonzero((n > 0) & (n < k)):
            own = h[before[i] : before[i + 1]]
            out[at[i]] = (own * _OF_SLOT[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own)) * _OF_SLOT[63]
        return mix(out), at


def shingle_sets(texts: list[bytes | None], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for lo, hi in chunks(texts):
        h, before, _, _ = words(texts[lo:hi])
        s, at = windows(h, before, k)
        for i in range(hi - lo):
            yield np.unique(s[at[i] : at[i + 1]])
