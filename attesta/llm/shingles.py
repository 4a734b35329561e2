"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once in numpy."""

from __future__ import annotations

import numpy as np

N = 5
#: Bytes hashed at a time; longer texts are taken alone.
BATCH_BYTES = 1 << 20

_r = np.random.default_rng(20240229)
_BYTE = _r.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z are lower-cased
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = _r.integers(1, 1 << 63, N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words in order, their bytes, number of words of each text)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    edge = np.diff(np.concatenate([[True], _SPACE[data]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    word = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return word, end - start, np.bincount(np.searchsorted(np.cumsum(sizes), start, side="right"), minlength=len(texts))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a whole text in order, A-Z lower-cased."""
    with np.errstate(over="ignore"):
        return _words([text.encode("utf-8", "surrogatepass")])[0]


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    with np.errstate(over="ignore"):
        return mixed(words[:-1] * _STEP[0] + words[1:] * _STEP[1])


def _batch(texts: list[bytes], measure: bool) -> list:
    word, size, counts = _words(texts)
    grams, total = np.zeros(len(word), np.uint64), np.zeros(len(word), np.int64)
    if len(word) >= N:
        grams = sum((word[i : len(word) - N + 1 + i] * _STEP[i] for i in range(N)), np.uint64(0))
        grams = mixed(grams)
        if measure:
            total = sum(size[i : len(word) - N + 1 + i] for i in range(N))
    out, at = [], 0
    for n in counts:
        if n >= N and measure:
            tokens, first = np.unique(grams[at : at + n - N + 1], return_index=True)
            out.append((tokens, total[at + first]))
        elif n >= N:
            out.append(np.unique(grams[at : at + n - N + 1]))
        else:
            tokens = mixed((word[at : at + n] * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else np.zeros(0, np.uint64)
            out.append((tokens, size[at : at + n].sum(keepdims=True)[: len(tokens)]) if measure else tokens)
        at += n
    return out


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: five words each, the whole sequence if there are fewer, none without words."""
    return _sets(texts, False)


def measured_sets(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ``shingle_sets``, each with the bytes of its shingles' words, which depend on the shingle alone."""
    return _sets(texts, True)


def _sets(texts: list[str | None], measure: bool) -> list:
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out, part, size = [], [], 0
    with np.errstate(over="ignore"):
        for d in data:
            if part and size + len(d) > BATCH_BYTES:
                out += _batch(part, measure)
                part, size = [], 0
            part.append(d)
            size += len(d) + 1
        if part:
            out += _batch(part, measure)
    return out
