"""Numpy kernels over the bytes of a batch of texts.

Every kernel works on one joined buffer per batch, so that the cost of Python is paid per batch and not per word.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
MASK = (1 << 64) - 1
#: A-Z to a-z and nothing else: other letters keep their case.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = np.ones(1, U64)
_inverse = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = 1 << (n - 1).bit_length()
        for name, factor in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, factor, U64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=U64)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = hash of data[i:j] times the base's i-th power (modulo 2**64)."""
    _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _powers[: len(data)], dtype=U64, out=out[1:])
    return out


def range_value(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers that agree where ranges of one length agree."""
    return (sums[ends] - sums[starts]) * _inverse[starts]


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that depend on the bytes alone, not on where they stand."""
    return mix(range_value(sums, starts, ends) + (ends - starts).astype(U64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


class Words:
    """The words of a batch of texts: hashes in order of place, and bounds[i]:bounds[i + 1] of text i."""

    def __init__(self, texts: list[bytes], stops: np.ndarray = SPACES):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.at = at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.starts, self.ends = runs(~stops[data])
        self.sums = prefix_sums(data)
        self.hashes = range_hash(self.sums, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, at)


def encode(text: str | None) -> bytes:
    """UTF-8; null is empty; lone surrogates, which UTF-8 has not, become question marks."""
    return b"" if text is None else text.encode("utf-8", "replace")


def combine(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` consecutive values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out += hashes[k : k + n] * U64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
        out ^= out >> U64(29)
    return mix(out)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its `size`-word shingles; with fewer words one for all of them; none without words."""
    words = Words([t.translate(LOWER) for t in texts])
    joint, out = combine(words.hashes, size), []
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        if b - a >= size:
            s = np.sort(joint[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            h = combine(words.hashes[a:b], int(b - a))
            out.append(mix(h ^ U64(b - a)))
        else:
            out.append(np.empty(0, U64))
    return out
