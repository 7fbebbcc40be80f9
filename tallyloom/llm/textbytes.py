"""Vectorised work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes and texts worked on at once; a longer text is worked on alone.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 20, 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, digits and all bytes of characters past ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_PRIME_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))


def blocks(texts: Sequence[str | None], gap: int, zero: bytes = b" ") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first, last + 1, lower-cased bytes, where each text starts).

    A text is followed by gap zero bytes; A-Z are lower-cased, null counts as empty. A
    zero byte inside a text becomes the given one.
    """
    held, size, first = [], 0, 0
    space = b"\0" * gap

    def joined(last: int):
        data = np.frombuffer(space.join(held) + space, np.uint8)
        starts = np.cumsum([0, *(len(h) + gap for h in held)])[:-1]
        return first, last, _LOWER[data], starts

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "replace") if text else b""
        if b"\0" in data:
            data = data.replace(b"\0", zero)
        if held and (size + len(data) > BLOCK_BYTES or len(held) == BLOCK_TEXTS):
            yield joined(i)
            held, size, first = [], 0, i
        held.append(data)
        size += len(data)
    if held:
        yield joined(len(texts))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _grow(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        steps = np.full(n, _PRIME, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = _PRIME_INVERSE
        _INVERSES = np.cumprod(steps, dtype=np.uint64)


def spans(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever the range stands."""
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _INVERSES[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, text_starts: np.ndarray, is_word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash and text number of every word of a block whose texts are one byte apart."""
    inside = is_word[data]
    inside[text_starts[1:] - 1] = False  # the byte between two texts ends a word, whatever its kind
    inside[-1:] = False
    starts, ends = spans(inside)
    return starts, ends, hashes(data, starts, ends), np.searchsorted(text_starts, starts, side="right") - 1


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Every run of n bytes (n <= 8) packed into an unsigned integer, exactly."""
    kind = np.uint32 if n <= 4 else np.uint64
    if len(data) < n:
        return np.zeros(0, kind)
    out = data[: len(data) - n + 1].astype(kind)
    for j in range(1, n):
        out = (out << kind(8)) | data[j : len(data) - n + 1 + j]
    return out
