"""Vectorised word hashes, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
SEGMENT = 1 << 20
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True
#: Bytes of words between white space.
SPACED_BYTE = np.ones(256, bool)
SPACED_BYTE[0x09:0x0E] = SPACED_BYTE[0x20] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _to_power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


def prefix_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte, the hash of the bytes before it since the last start (starts[i] is its part's first byte)."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _to_power("up", _P, n), out=sums[1:])
    return mixed((sums[:-1] - sums[starts]) * _to_power("down", _P_INVERSE, n)[starts])


def word_hashes(data: bytes, word_byte: np.ndarray = _WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word (plain ones, if no other bytes are named; lower-cased A-Z) of UTF-8 bytes."""
    raw = np.frombuffer(data.lower(), np.uint8)
    inside = np.concatenate([[False], word_byte[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    if not len(first):
        return np.empty(0, np.uint64), first
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _to_power("up", _P, len(raw)), out=sums[1:])
    return mixed((sums[last] - sums[first]) * _to_power("down", _P_INVERSE, len(raw))[first]), first


def text_word_hashes(texts: list[str], word_byte: np.ndarray = _WORD_BYTE) -> Iterator[np.ndarray]:
    """Word hashes of each text. Short texts are hashed together, long ones in parts that end between words."""
    batch: list[bytes] = []

    def flush() -> Iterator[np.ndarray]:
        hashes, first = word_hashes(b" ".join(batch), word_byte)
        ends = np.cumsum([len(x) + 1 for x in batch])
        yield from np.split(hashes, np.searchsorted(first, ends[:-1]))
        batch.clear()

    held = 0
    for text in texts:
        data = text.encode()
        if len(data) > SEGMENT:
            if batch:
                yield from flush()
                held = 0
            parts, at = [], 0
            while at < len(data):
                end = min(len(data), at + SEGMENT)
                while end < len(data) and word_byte[data[end : end + 1].lower()[0]]:
                    end += 1
                parts.append(word_hashes(data[at:end], word_byte)[0])
                at = end
            yield np.concatenate(parts)
            continue
        batch.append(data)
        held += len(data)
        if held > SEGMENT:
            yield from flush()
            held = 0
    if batch:
        yield from flush()
