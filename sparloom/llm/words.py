"""Words of UTF-8 texts and their 64-bit hashes, computed with numpy for many texts at once.

A hash depends on a word's bytes alone. Hashes only propose; operators that need
certainty compare the words themselves afterwards.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers, so that they have inverses modulo 2**64.
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SEGMENT = 1 << 19
_MASK = (1 << 64) - 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of words: digits, ASCII letters (lower-cased), and all bytes of non-ASCII characters; others become 0.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, _SEGMENT + (1 << 14))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        have = _tables[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of several texts.

    buf: the translated bytes, texts separated by a 0 byte; starts, ends: of each
    word in buf; doc: the index of its text; hashes: of its bytes; prefixes: for
    each asked length, hashes of the word's first bytes (0 where it is no longer).
    """

    def __init__(self, texts: list[bytes], table: bytes = WORD_BYTES, prefix_bytes: tuple[int, ...] = ()):
        self.n_texts = len(texts)
        self.bytes = b"\0".join(texts).translate(table)
        self.buf = np.frombuffer(self.bytes, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(texts) else np.zeros(0, np.int64)
        parts = [self._segment(lo, hi, prefix_bytes) for lo, hi in self._cuts()]
        self.starts, self.ends, self.hashes = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.uint64)))
        self.prefixes = [np.concatenate([p[3][k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in range(len(prefix_bytes))]
        self.doc = np.searchsorted(self.text_starts, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))

    def _cuts(self):
        lo, n = 0, len(self.buf)
        while lo < n:
            hi = lo + _SEGMENT
            if hi < n:
                hi = self.bytes.find(b"\0", hi)
                hi = n if hi < 0 else hi
            else:
                hi = n
            yield lo, hi
            lo = hi

    def _segment(self, lo: int, hi: int, prefix_bytes: tuple[int, ...]):
        part = self.buf[lo:hi]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = part != 0
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        power, inverse = _powers(_P, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:], dtype=np.uint64)
        head = sums[starts]
        hashes = mix((sums[ends] - head) * inverse[starts])
        prefixes = []
        for k in prefix_bytes:
            h = mix((sums[np.minimum(starts + k, len(part))] - head) * inverse[starts]) + np.uint64(k)
            h[ends - starts <= k] = 0
            prefixes.append(h)
        return starts + lo, ends + lo, hashes, prefixes

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]]

    def join(self, i: int, j: int) -> bytes:
        """Words i to j, single spaces between."""
        return b" ".join(self.bytes[s:e] for s, e in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist()))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first words of all k consecutive words of one text, and a hash of each."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[k - 1 :] == self.doc[: n - k + 1])
        return at, window_hashes(self.hashes, k)[at]


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive hashes."""
    n = len(hashes)
    out = np.empty(max(0, n - k + 1), np.uint64)
    for lo in range(0, len(out), _SEGMENT):
        part = hashes[lo : lo + _SEGMENT + k - 1]
        power, inverse = _powers(_Q, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:], dtype=np.uint64)
        m = len(part) - k + 1
        out[lo : lo + m] = mix((sums[k:] - sums[:m]) * inverse[:m])
    return out
