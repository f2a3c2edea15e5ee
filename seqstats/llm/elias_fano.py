"""Elias-Fano coded monotone sequences in numpy: random access and successor search on memory-mapped words.

A sequence of n numbers up to u keeps the low bits of each number packed and the high parts in unary, about
2 + log2(u / n) bits a number. A count of zeros before every 64-bit word makes selection a binary search.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def packed_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of each number one after the other in 64-bit words, with a spare word at the end."""
    total = (len(values) * bits + 63) // 64 + 1
    out = np.zeros(total * 8, np.uint8)
    shifts = np.arange(bits, dtype=U)
    for at in range(0, len(values), 1 << 16):  # 65,536 numbers fill whole bytes
        part = ((values[at : at + (1 << 16), None] >> shifts) & U(1)).astype(np.uint8)
        data = np.packbits(part.ravel(), bitorder="little")
        out[at * bits // 8 : at * bits // 8 + len(data)] = data
    return out.view(U)


def chosen_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each word."""
    word, k = word.copy(), k.copy()
    place = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
        over = k >= ones
        k -= np.where(over, ones, 0)
        word = np.where(over, word >> U(width), word)
        place += np.where(over, width, 0)
    return place


class EliasFano:
    """A nondecreasing sequence; ``arrays()`` are its parts, which may be memory-mapped."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, U)
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // n).bit_length() - 1) if n else 0
        tops = (values >> U(bits)).astype(np.int64)
        size = n + (int(tops[-1]) if n else 0) + 1
        unary = np.zeros((size + 63) // 64 * 64, np.uint8)
        unary[tops + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view(U)
        empty = 64 - np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, packed_bits(values, bits), high, (np.cumsum(empty) - empty).astype(U))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], U), self.low, self.high, self.zeros]

    @classmethod
    def from_arrays(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high, zeros)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.low_bits)
        word, off = (at >> U(6)).astype(np.int64), at & U(63)
        spill = np.where(off > 0, self.low[word + 1] << ((U(64) - off) & U(63)), U(0))
        return ((self.low[word] >> off) | spill) & U((1 << self.low_bits) - 1)

    def up_to(self, top: np.ndarray) -> np.ndarray:
        """How many numbers have a high part of at most ``top``: the place of its zero less the zeros before it."""
        word = np.searchsorted(self.zeros, top.astype(U), side="right") - 1
        inside = top - self.zeros[word].astype(np.int64)
        return word * 64 + chosen_in_word(~self.high[word], inside) - top

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, U)
        # the ones before a word are its bits less its zeros: find the last word with at most i of them
        least, most = np.zeros(len(i), np.int64), np.full(len(i), len(self.high))
        while (gap := most - least > 1).any():
            middle = (least + most) >> 1
            before = middle * 64 - self.zeros[np.minimum(middle, len(self.zeros) - 1)].astype(np.int64)
            ok = gap & (before <= i)
            least, most = np.where(ok, middle, least), np.where(gap & ~ok, middle, most)
        rank = i - (least * 64 - self.zeros[least].astype(np.int64))
        top = least * 64 + chosen_in_word(self.high[least], rank) - i
        return (top.astype(U) << U(self.low_bits)) | self.lows(i)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each x's successor (the first number not below it), and whether it equals x."""
        x = np.asarray(x, U)
        if not self.n or not len(x):
            return np.full(len(x), self.n), np.zeros(len(x), bool)
        top = (x >> U(self.low_bits)).astype(np.int64)
        last = len(self.high) * 64 - self.n - 1  # the padding only adds zeros after the last high part
        inside = top <= last
        top = np.minimum(top, last)
        end = np.minimum(self.up_to(top), self.n)
        start = np.where(top > 0, np.minimum(self.up_to(np.maximum(top - 1, 0)), self.n), 0)
        low = x & U((1 << self.low_bits) - 1)
        most = end.copy()
        while (gap := start < most).any():
            middle = (start + most) >> 1
            below = gap & (self.lows(np.minimum(middle, self.n - 1)) < low)
            start = np.where(below, middle + 1, start)
            most = np.where(gap & ~below, middle, most)
        start = np.where(inside, start, self.n)
        found = inside & (start < end)
        found[found] = self.lows(start[found]) == low[found]
        return start, found
