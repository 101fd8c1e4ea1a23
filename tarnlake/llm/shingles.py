"""Word and shingle hashes of whole texts, in numpy.

Words are what stands between ASCII white space in the lower-cased text. A word's hash is a polynomial of
its bytes modulo 2**64, taken from prefix sums of the text, and then mixed; a shingle's hash combines the
hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CHUNK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 14)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, dtype=np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers


def _hash_chunk(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word."""
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _tables(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start]), start


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word. Long texts go in chunks cut at white space, so memory follows the chunk."""
    raw = np.frombuffer(_bytes(text), dtype=np.uint8)
    if len(raw) <= _CHUNK:
        return _hash_chunk(raw)[0]
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _CHUNK)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        out.append(_hash_chunk(raw[at:end])[0])
        at = end
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the runs of ``size`` words, in order; a shorter text is one run of all its words."""
    n = len(words)
    k = min(size, n)
    if not n:
        return words
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * _BASE + words[i : n - k + 1 + i]
    return mix(out)


def text_key(words: np.ndarray) -> bytes:
    """16 bytes that are equal for texts with the same words in the same order."""
    return xxhash.xxh3_128_digest(words.tobytes())


def of_texts(texts: Iterable[str | None], size: int = 5, together: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, shingle hashes) of each text, in order. Short texts are cut together: numpy's calls are what costs."""
    held: list[bytes] = []
    n = 0
    for text in texts:
        if len(text or "") > together:
            yield from _together(held, size)
            held, n = [], 0
            words = word_hashes(text or "")
            yield words, shingle_hashes(words, size)
            continue
        held.append(_bytes(text))
        n += len(held[-1])
        if n > together:
            yield from _together(held, size)
            held, n = [], 0
    yield from _together(held, size)


def _together(held: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if not held:
        return
    words, start = _hash_chunk(np.frombuffer(b"\n".join(held), dtype=np.uint8))
    ends = np.cumsum([len(x) + 1 for x in held])
    upto = np.searchsorted(start, ends).tolist()
    runs = shingle_hashes(words, size) if len(words) >= size else words
    at = 0
    for end in upto:
        yield words[at:end], runs[at : end - size + 1] if end - at >= size else shingle_hashes(words[at:end], size)
        at = end
