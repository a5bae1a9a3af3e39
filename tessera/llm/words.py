"""Words of many texts as NumPy arrays, with 64-bit hashes of words and of windows of words.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
Hashes are polynomials modulo 2^64 of mixed values, mixed again; they depend on nothing but the words.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
_R, _S = U(0x9E3779B97F4A7C15 | 1), U(0xD1342543DE82EF95)
_SLICE = 1 << 20


def _inverse(x: np.uint64) -> np.uint64:
    return U(pow(int(x), -1, 1 << 64))


class _Powers:
    """1, r, r^2 and so on, and those of r's inverse; made as far as they are needed."""

    def __init__(self, r: np.uint64):
        self.bases, self.made = (r, _inverse(r)), [np.ones(1, U), np.ones(1, U)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.made[0]) < n:
            self.made = [np.cumprod(np.concatenate((np.ones(1, U), np.full(n + n // 4, b, U)))) for b in self.bases]
        return self.made


_BYTES, _WORDS = _Powers(_R), _Powers(_S)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_hashes(texts: list[bytes], variable: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one place more than texts).

    variable: if given, the hash of every word that holds a digit.
    """
    whole = b"\n".join(texts)
    ends_of = np.cumsum([0] + [len(t) + 1 for t in texts])
    data, out, at, lo = np.frombuffer(whole, np.uint8), [], [], 0
    while lo < len(data):
        hi = lo + _SLICE
        if hi < len(data):  # a slice ends at white space
            step = _SLICE
            while hi < len(data):
                stop = np.flatnonzero(_spaces(data[hi : hi + step]))
                if len(stop):
                    hi += int(stop[0])
                    break
                hi += step
        part = data[lo : min(hi, len(data))]
        gap = np.concatenate(([True], _spaces(part), [True]))
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        power, back = _BYTES.upto(len(part) + 1)
        sums = np.concatenate((np.zeros(1, U), np.cumsum((part.astype(U) + U(1)) * power[: len(part)])))
        out.append(mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407)))
        if variable is not None:
            digits = np.concatenate(([0], np.cumsum((part >= 48) & (part <= 57))))
            out[-1][digits[ends] > digits[starts]] = variable
        at.append(starts + lo)
        lo = min(hi, len(data))
    hashes = np.concatenate(out) if out else np.empty(0, U)
    return hashes, np.searchsorted(np.concatenate(at) if at else np.empty(0, np.int64), ends_of)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of words[i : i + size] for each i; windows across texts are for the caller to leave out."""
    if len(words) < size:
        return np.empty(0, U)
    power, back = _WORDS.upto(len(words) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(words * power[: len(words)])))
    n = len(words) - size + 1
    return mix((sums[size:] - sums[:n]) * back[:n] + U(size))


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of words[start:end] for each span, without its length."""
    power, back = _WORDS.upto(len(words) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(words * power[: len(words)])))
    return mix((sums[ends] - sums[starts]) * back[starts])


def inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """Which windows (by their start) lie within one text."""
    total = int(bounds[-1])
    n = max(0, total - size + 1)
    room = np.repeat(bounds[1:], np.diff(bounds))  # end of each word's text
    return np.arange(n) + size <= room[:n]


def batches(arrow_batches, most_bytes: int):
    """Rows of Arrow batches (last column: text) in groups of bounded size: lists of the other columns, and bytes."""
    rows, texts, held = [], [], 0
    for batch in arrow_batches:
        others = [c.to_pylist() for c in batch.columns[:-1]]
        for i, text in enumerate(batch.columns[-1]):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if texts and held + len(data) > most_bytes:
                yield rows, texts
                rows, texts, held = [], [], 0
            rows.append(tuple(c[i] for c in others))
            texts.append(data)
            held += len(data) + 1
    if texts:
        yield rows, texts
    give_back()


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: idle workers would keep it, beside those that run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
