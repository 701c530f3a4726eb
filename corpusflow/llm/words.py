"""Words of whole texts as 64-bit hashes, found with array operations on UTF-8 bytes.

A word is a longest run of word bytes; every byte of a character beyond ASCII is a word byte, so runs never
cut a character. A-Z count as a-z. The hash of a word depends on its bytes alone, not on where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK = 1 << 17  # bytes handled at once, for the processor's cache; a longer text is cut at a byte outside words
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64

#: Letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
ALNUM[128:] = True
#: Everything but the blank and the controls from tab to carriage return.
VISIBLE = np.ones(256, bool)
VISIBLE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += _U(32)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, _U(base))
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def spans(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] + _U(1)) * power[:-1], out=total[1:])
    return mix((total[end] - total[first]) * inverse[first])


def _cuts(data: bytes, kind: np.ndarray) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        end = min(len(data), start + CHUNK)
        if end < len(data):
            block = np.frombuffer(data, np.uint8, end - start, start)
            outside = np.flatnonzero(~kind[block])
            if len(outside):
                end = start + int(outside[-1]) + 1
            else:
                while end < len(data) and kind[data[end]]:
                    end += 1
        yield data[start:end]
        start = end


def word_hashes(texts: Sequence[str | None], kind: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in order, and how many words each text has. A null text has none."""
    counts = np.zeros(len(texts), np.int64)
    found: list[np.ndarray] = []
    held: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            data = np.frombuffer(b" ".join(held), np.uint8)
            first, end = spans(data, kind)
            found.append(hashes(data, first, end))
            bounds = np.cumsum([len(x) + 1 for x in held])
            owner = np.asarray(owners)[np.searchsorted(bounds, first, side="right")]
            np.add.at(counts, owner, 1)
        held.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "replace")
        for part in [raw] if len(raw) <= CHUNK else _cuts(raw, kind):
            if size + len(part) > CHUNK:
                flush()
            held.append(part)
            owners.append(i)
            size += len(part) + 1
    flush()
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def runs(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of so many consecutive words; runs that cross texts are for the caller to leave out."""
    n = max(0, len(hashed) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _U(0xD6E8FEB86659FD93) + hashed[k : k + n]
    return mix(out)


def blocks(texts: Sequence[str | None], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with some so many characters together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
