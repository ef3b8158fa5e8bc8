"""Word shingles of texts as sorted 64-bit hashes, computed a block of texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BLOCK = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _power(sign: int, n: int) -> np.ndarray:
    if len(_powers[sign]) < n:
        step = np.full(max(n, _BLOCK + 2), _ODD if sign > 0 else _ODD_INVERSE, dtype=np.uint64)
        step[0] = 1
        _powers[sign] = np.cumprod(step, dtype=np.uint64)
    return _powers[sign][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the start of each word of one block (words: runs without ASCII white space)."""
    b = np.frombuffer(block, dtype=np.uint8)
    space = np.ones(len(b) + 2, dtype=bool)
    space[1:-1] = _SPACE[b]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * _power(1, len(b)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(-1, len(b) + 1)[starts]), starts


def _blocks(texts: list[bytes]) -> Iterator[tuple[list[int], bytes, list[int]]]:
    """(text numbers, joined bytes, their starts); a long text comes as several blocks cut at white space."""
    held: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) > _BLOCK:
            at = 0
            while at < len(t):
                end = min(len(t), at + _BLOCK)
                if end < len(t):
                    cut = max(t.rfind(s, at, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                    if cut <= at:
                        cuts = [c for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (c := t.find(s, end)) >= 0]
                        cut = min(cuts, default=len(t))
                    end = cut
                yield [i], t[at:end], [0]
                at = end
            continue
        if held and size + len(t) > _BLOCK:
            yield _joined(texts, held)
            held, size = [], 0
        held.append(i)
        size += len(t) + 1
    if held:
        yield _joined(texts, held)


def _joined(texts: list[bytes], held: list[int]) -> tuple[list[int], bytes, list[int]]:
    starts = np.cumsum([0] + [len(texts[i]) + 1 for i in held[:-1]])
    return held, b" ".join(texts[i] for i in held), starts.tolist()


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each lower-cased text the sorted distinct hashes of its k-word shingles.

    Fewer than k words count as one shingle; no words give an empty set.
    """
    words: list[list[np.ndarray]] = [[] for _ in texts]
    for numbers, block, starts in _blocks(texts):
        h, at = word_hashes(block)
        cuts = np.searchsorted(at, starts[1:])
        for i, part in zip(numbers, np.split(h, cuts), strict=True):
            words[i].append(part)
    out = []
    for parts in words:
        h = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if not len(h):
            out.append(h)
            continue
        n = max(1, len(h) - k + 1)
        s = h[:n].copy()
        for j in range(1, min(k, len(h))):
            s = mix(s * _ODD + h[j : j + n])
        s.sort()
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
    return out
