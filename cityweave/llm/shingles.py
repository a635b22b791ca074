"""Distinct word shingles of whole texts as 64-bit hashes, many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of text that one round of array operations takes (plus one text).
PIECE = 1 << 20
# Lower-case A-Z; every white-space byte becomes a blank.
_TABLE = bytes(32 if b in (9, 10, 11, 12, 13, 32) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of raw (which ends in a blank)."""
    a = np.frombuffer(raw, np.uint8)
    blank = a == 32
    before = np.empty(len(a), bool)
    before[0], before[1:] = True, blank[:-1]
    starts, ends = np.flatnonzero(before & ~blank), np.flatnonzero(blank & ~before)
    power, inverse = _power(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_VALUES[a] * power, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _combined(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(h)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of k words; the whole
    sequence where a text has fewer words; nothing where it has none."""
    out: list[np.ndarray] = []
    at = 0
    raws = [(t or "").encode("utf-8", "replace").translate(_TABLE) + b" " for t in texts]
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) <= PIECE):
            size += len(raws[end])
            end += 1
        part = raws[at:end]
        if end == at + 1 and size > 4 * PIECE:
            out.append(_long(part[0], k))
        else:
            words, starts = _words(b"".join(part))
            cut = np.searchsorted(starts, np.cumsum([0, *map(len, part)]))
            whole = _combined(words, k) if len(words) >= k else np.empty(0, np.uint64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a >= k:
                    out.append(_distinct(whole[a : b - k + 1]))
                else:
                    out.append(_combined(words[a:b], b - a) if b > a else np.empty(0, np.uint64))
        at = end
    return out


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def _long(raw: bytes, k: int) -> np.ndarray:
    """One very long text, in windows cut at blanks; word hashes are joined before shingling."""
    parts, at = [], 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end + 1
        parts.append(_words(raw[at:end])[0])
        at = end
    words = np.concatenate(parts)
    if len(words) < k:
        return _combined(words, len(words)) if len(words) else words
    return _distinct(_combined(words, k))


def fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
