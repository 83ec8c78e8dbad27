"""64-bit hashes of the words and shingles of a text, worked out on whole arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_rng = np.random.default_rng(20_240_607)
#: A random odd multiplier's powers and a random number for each byte; the multiplier's inverse takes a word's place in the text out of its hash.
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = _rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, base, np.uint64), dtype=np.uint64)])
    return _powers


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, in bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers_to(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[15])


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Of each run of `width` words; of fewer words the whole as one, of none nothing."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(width) * _MIX[14])
        for k in range(width):
            out = out * _MIX[13] + h[k : k + n]
        return mix(out)


def run_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run h[lo:hi] of words, by running sums of powers of the multiplier."""
    up, down = _powers_to(len(h) + 1)
    with np.errstate(over="ignore"):
        out = []
        for salt in (0, 1):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + _MIX[salt]) * up[: len(h)], dtype=np.uint64)])
            out.append(mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _MIX[2] + np.uint64(kind) * _MIX[3]))
    return out[0], out[1]


#: Bytes of texts that are hashed at once; a longer text goes alone.
AT_ONCE = 1 << 20


def group_texts(bodies: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in bodies:
        if held and size + len(x) > AT_ONCE:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x) + 1
    if held:
        yield held


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles, A-Z lower-cased: the whole word sequence as one if it has fewer words, none without words."""
    bodies = [(x or "").encode("utf-8", "surrogatepass").lower() for x in texts]  # bytes.lower() changes A-Z alone
    for group in group_texts(bodies):
        data = np.frombuffer(b"\n".join(group), np.uint8)
        starts, ends = word_bounds(data)
        h = word_hashes(data, starts, ends)
        shingles = window_hashes(h, width) if len(h) >= width else h[:0]
        at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in group])])
        first = np.searchsorted(starts, at)
        for i in range(len(group)):
            n = first[i + 1] - first[i]
            own = shingles[first[i] : first[i + 1] - width + 1] if n >= width else window_hashes(h[first[i] : first[i + 1]], width)
            own = np.sort(own)
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    return next(shingle_sets([text], width))
