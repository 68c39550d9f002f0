"""Hashed words of whole Arrow string columns, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MIX = np.uint64(0x9E3779B97F4A7C15)
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser over ``x`` (uint64), different for each salt."""
    x = x ^ np.uint64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the column, the code of every word in order, and each row's bounds.

    Words are maximal runs without white space; null texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if lower:
        texts = pc.utf8_lower(texts)
    lists = pc.utf8_split_whitespace(texts)
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    vocabulary = coded.dictionary
    if len(vocabulary) and (blank := pc.equal(pc.binary_length(vocabulary), 0).to_numpy(False)).any():
        real = ~blank[codes]  # the split leaves '' before and after white space at the ends
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    return vocabulary, codes, bounds.astype(np.int64)


def cuts(texts: pa.Array, most_bytes: int = 2 << 20, most_rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of parts of the column with about so many bytes and rows, a longer text by itself: what is worked out of a part
    takes many times its bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(size, (size[i - 1] if i else 0) + most_bytes, side="right"))
        j = max(i + 1, min(j, i + most_rows))
        yield i, j
        i = j


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash for each string, the same in every process."""
    names = np.asarray(strings.to_pandas(), dtype=object)
    return pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for every word in order, and each row's bounds."""
    vocabulary, codes, bounds = split_words(texts, lower)
    return hash_strings(vocabulary)[codes], bounds


def bigrams(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words; a row of one word has that word alone."""
    n = np.diff(bounds)
    out = np.maximum(n - 1, np.minimum(n, 1))
    where = np.concatenate([[0], np.cumsum(out)])
    first = np.repeat(bounds[:-1] - where[:-1], out) + np.arange(where[-1])
    alone = np.repeat(n == 1, out)
    second = np.where(alone, first, first + 1)
    a, b = hashes[first], hashes[second] if len(hashes) else hashes
    return mix(a * MIX + np.where(alone, np.uint64(0), b)), where


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values without repeats, and the new bounds."""
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    if values.dtype == np.uint64:  # too wide to sort beside the row: sort by places in the sorted whole
        every, place = np.unique(values, return_inverse=True)
    else:
        every, place = None, values
    keys = np.sort((row << np.uint64(32)) | place.astype(np.uint64))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    kept = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(bounds) - 1)
    return (kept if every is None else every[kept]), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def rows_reduce(op: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """``op`` over each row's values; ``empty`` for rows without any."""
    n = np.diff(bounds)
    out = np.full((len(n), *values.shape[1:]), empty, values.dtype)
    if (some := n > 0).any():
        out[some] = op.reduceat(values, bounds[:-1][some], axis=0)
    return out


def simhash(hashes: np.ndarray, bounds: np.ndarray, salts: tuple[int, ...] = (1, 2)) -> np.ndarray:
    """64 sign bits for each salt, every hash of a row voting with weight 1: uint64 [rows, salts].

    Votes are added eight byte lanes at a time in pieces of at most 255 hashes."""
    n = np.diff(bounds)
    out = np.zeros((len(n), len(salts)), np.uint64)
    pieces = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(pieces)])
    starts = np.repeat(bounds[:-1], pieces) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], pieces))
    if not len(starts):
        return out
    step = max(1, (1 << 21) // 255)
    ends = np.append(starts[1:], bounds[-1])
    for k, salt in enumerate(salts):
        votes = np.empty((len(starts), 64), np.uint8)
        for i in range(0, len(starts), step):
            lo, hi = starts[i], ends[min(i + step, len(starts)) - 1]
            lanes = _LANES[mix(hashes[lo:hi], salt).view(np.uint8).reshape(-1, 8)]
            votes[i : i + step] = np.add.reduceat(lanes, starts[i : i + step] - lo, axis=0).view(np.uint8).reshape(-1, 64)
        total = rows_reduce(np.add, votes.astype(np.int64), first, 0)
        bits = 2 * total > n[:, None]
        out[:, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out
