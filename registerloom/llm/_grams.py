"""Byte n-grams as 64-bit numbers: counting over all documents, and scoring documents from a table of n-grams.

The predicted byte is in the lowest eight bits, the byte before it in the next eight, and so on. A text ends with byte
0xFF, which UTF-8 never has, and starts after n-1 such bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

END = 255
_CHUNK = 1 << 20
_SORTED = 1_000_000


def pieces(texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, lengths, owners): texts (each with END appended) in buffers of bounded size, every piece after the n-1 bytes
    before it; lengths of the predicted parts, owners: index of the text of each piece. A long text is several pieces."""
    pad = bytes([END]) * (n - 1)
    held, lengths, owners, size = [], [], [], 0
    for i, text in enumerate(texts):
        whole = pad + text + bytes([END])
        for at in range(0, len(text) + 1, _CHUNK):
            part = whole[at : at + _CHUNK + n - 1]
            held.append(part)
            lengths.append(len(part) - n + 1)
            owners.append(i)
            size += len(part)
            if size >= _CHUNK:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(lengths), np.array(owners)
                held, lengths, owners, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(lengths), np.array(owners)


def codes(buf: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each predicted byte of pieces()."""
    wide = buf.astype(np.int64)
    out = wide[n - 1 :].copy()
    for j in range(1, n):
        out |= wide[n - 1 - j : len(wide) - j] << (8 * j)
    if len(lengths) > 1:  # between pieces lie the bytes before the next piece
        inside = np.ones(len(out), bool)
        ends = np.cumsum(lengths + n - 1)[:-1] - (n - 1)
        for j in range(n - 1):
            inside[ends + j] = False
        out = out[inside]
    return out


class Counts:
    """Counts by 64-bit key, by sorting: as many keys at a time as make a sort worth it. merged: distinct keys held."""

    def __init__(self):
        self.waiting, self.size, self.parts, self.merged = [], 0, [], 0

    def add(self, keys: np.ndarray, weight: int = 1) -> None:
        self.waiting.append((keys, weight))
        self.size += len(keys)
        if self.size > _SORTED:
            self.sort()
            if sum(len(k) for k, _ in self.parts) > self.merged + _SORTED:
                self.merge()

    def sort(self) -> None:
        for weight in {w for _, w in self.waiting}:
            keys = np.sort(np.concatenate([k for k, w in self.waiting if w == weight]))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            self.parts.append((keys[first], np.diff(np.append(first, len(keys))) * weight))
        self.waiting, self.size = [], 0

    def merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([x for _, x in self.parts])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.parts = [(keys[first], np.add.reduceat(n, first) if len(first) else n)]
        self.merged = len(first)

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys in order, counts), once each; nothing is held any more."""
        self.sort()
        if len(self.parts) != 1:
            self.parts.append((np.empty(0, np.int64), np.empty(0, np.int64)))
            self.merge()
        out = self.parts[0]
        self.parts, self.merged = [], 0
        return out


def _group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and each key's index among them."""
    return np.unique(keys, return_inverse=True)


class Table:
    """Values by sorted 64-bit key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.values = values[np.argsort(keys)]
        self.keys = np.sort(keys)

    def look(self, keys: np.ndarray, default: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default)
        distinct, at = _group(keys)
        found = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
        return np.where(self.keys[found] == distinct, self.values[found], default)[at]
