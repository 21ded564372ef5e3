"""Hashed character n-grams of many words at once, for the trained text models."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def word_ngrams(words: list[str], low: int, high: int, bits: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all ``low``..``high``-grams of ``<word>`` (ends marked), word after word,
    and where each word's begin (one more entry than words). ``whole`` adds a bucket for the word itself."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    text = "".join([f"\x02{w}\x03" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(codes))  # characters from here to the word's end
    start = end - size
    word_of = np.repeat(np.arange(len(words)), size)
    keys, owner = [], []
    state = np.full(len(codes), np.uint64(0))
    for n in range(1, high + 1):
        if n > len(codes):
            break
        m = len(codes) - n + 1
        state = (state[:m] ^ codes[n - 1:]) * _MIX
        state ^= state >> np.uint64(29)
        if n >= low:
            ok = left[:m] >= n
            keys.append(_bucket(state[ok] + np.uint64(n), bits))
            owner.append(word_of[:m][ok])
    if whole:
        full = np.zeros(len(words), np.uint64)
        np.add.at(full, word_of, (codes + _MIX) * _powers(np.arange(len(codes)) - start[word_of]))
        keys.append(_bucket(full * _MUL, bits))
        owner.append(np.arange(len(words)))
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return keys[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def _powers(n: np.ndarray) -> np.ndarray:
    table = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(n.max(initial=0)), _MUL)]).astype(np.uint64), dtype=np.uint64)
    return table[n]


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def sums_by_word(table: np.ndarray, keys: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of ``table[key]`` over each word's keys; a word without keys gets zero."""
    rows = np.concatenate([table[keys], np.zeros((1, *table.shape[1:]), table.dtype)])
    out = np.add.reduceat(rows, begin[:-1], axis=0)
    out[begin[:-1] == begin[1:]] = 0
    return out
