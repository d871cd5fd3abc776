"""Word shingles, MinHash values and groups of sorted rows, shared by the operators on near-duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_BY_WORD = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3)]


def words(text: str) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of everything from U+0080 on."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; a shorter text is one run; none without words."""
    found = words(text or "")
    if not found:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in found], dtype=np.uint64)
    n = min(WORDS, len(h))
    total = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        total += h[k:len(h) - n + 1 + k] * _BY_WORD[k]
    total ^= total >> np.uint64(31)
    total *= _MIX
    total ^= total >> np.uint64(29)
    total *= _MIX2
    total ^= total >> np.uint64(32)
    return np.unique(total)


def set_key(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


class MinHash:
    """`size` 32-bit minima of a shingle set under multiply-shift hashes."""

    def __init__(self, size: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, size, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        best = np.full(len(self.odd), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 2048):
            h = shingles[at:at + 2048, None] * self.odd
            h += self.add
            best = np.minimum(best, h.min(axis=0))
        return (best >> np.uint64(32)).astype("<u4")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first `keys` columns of sorted batches, whole across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k) for k in range(keys)]
        change = np.zeros(n, dtype=bool)
        for c in columns:
            codes = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        first = tuple(c[0].as_py() for c in columns)
        cuts = np.flatnonzero(change).tolist()
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for cut in cuts:
            held.append(batch.slice(start, cut - start))
            yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
        last = tuple(c[n - 1].as_py() for c in columns)
    if held:
        yield pa.Table.from_batches(held)
