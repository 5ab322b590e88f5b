"""Vectorised text kernels: words, hashes and shingles of whole Arrow string batches.

Texts are looked at as one UTF-8 byte buffer with offsets, as Arrow holds them, and every step is a
numpy pass over that buffer, so no Python code runs per document or per word.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes; a character of U+3000 to
U+DFFF (kana, Han, Hangul) is a word by itself, as those scripts put no spaces between words. ASCII
case is folded. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass takes; a longer text is a pass by itself, whole.
SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240517)
_BYTE = np.arange(256)
ALNUM = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
LETTER = ALNUM | (_BYTE >= 128)
WIDE = (_BYTE >= 0xE3) & (_BYTE <= 0xED)
_FOLD = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_FOLD]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 4 * SLICE_BYTES:  # those of a single very long text are not kept
            _powers[base] = have
    return have


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off.astype(np.int64) - int(off[0])


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most `limit` bytes and 30,000 rows, or of one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 30_000)
        yield lo, hi
        lo = hi


class Words:
    """Words of a slice of texts: byte ranges, hashes and the row of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        letter = LETTER[raw]
        before, after = np.zeros(len(raw), dtype=bool), np.zeros(len(raw), dtype=bool)
        if len(raw):
            before[1:], after[:-1] = letter[:-1], letter[1:]
            edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
            before[edges] = False
            after[edges - 1] = False
            wide = WIDE[raw]
            if wide.any():
                at = np.flatnonzero(wide)
                before[at] = False
                after[at[at > 0] - 1] = False
                tail = at + 3  # what follows a wide character starts anew
                tail = tail[tail < len(raw)]
                before[tail] = False
                after[tail - 1] = False
        self.starts = np.flatnonzero(letter & ~before)
        self.ends = np.flatnonzero(letter & ~after) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.count = np.bincount(self.row, minlength=len(offsets) - 1)

    def hashes(self) -> np.ndarray:
        n = len(self.raw)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[self.raw] * _power(_BASE, n)[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * _power(_BASE_INV, n + 1)[self.starts])


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct n-word shingles of each row, ordered by row.

    Hashes have 48 bits. A text of fewer than n words has one shingle, of all its words; one without
    words has none.
    """
    h = words.hashes()
    m = len(h)
    if not m:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total, ok = h.copy(), np.ones(m, dtype=bool)
    first = np.cumsum(words.count) - words.count
    short = words.count[words.row] < n
    for i in range(1, n):
        same = np.zeros(m, dtype=bool)
        same[: m - i] = words.row[i:] == words.row[: m - i]
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
        total[: m - i] += np.where(same[: m - i], h[i:], np.uint64(0))
        ok &= same
    ok |= short & (np.arange(m) == first[words.row])
    keys = (words.row[ok].astype(np.uint64) << np.uint64(48)) | (mix(total[ok]) >> np.uint64(16))
    keys.sort()
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.concatenate((at, [len(keys)])))
    keys = keys[at]
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1), counts
