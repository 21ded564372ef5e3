"""A minimal perfect hash over 128-bit keys, in shards of bounded size.

A key is two 64-bit lanes. The low lane names its shard. Within a shard of ``n`` keys, a key falls into one of about
``n / 4`` buckets and has two numbers f and g below ``n``; its slot is ``(f + d0 * g + d1) mod n`` where the bucket's pilot
``d0 * n + d1`` was chosen so that no two keys meet. A shard that can't be solved under one seed is tried under the next.
Each slot holds the key's high lane as fingerprint, and its count. A key that was never indexed lands on some slot too,
where its fingerprint differs but for one case in 2^64.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
PER_BUCKET, MOVES = 4, 64


def mixed(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """64-bit finalizer: every bit of ``x`` and ``salt`` reaches every bit of the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (np.asarray(salt).astype(_U) * _U(0x9E3779B97F4A7C15))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))


def shard_of(low: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(low, 1) % _U(shards)).astype(np.int64)


def _places(low, high, seed, n):
    """Bucket, f and g of keys in shards of ``n`` keys under ``seed``; both may be arrays."""
    salt = np.asarray(seed).astype(_U) * _U(4)
    n = np.asarray(n).astype(_U)
    both = low ^ mixed(high, 2)
    buckets = (n + _U(PER_BUCKET - 1)) // _U(PER_BUCKET)
    return mixed(both, salt + _U(3)) % buckets, mixed(both, salt + _U(4)) % n, mixed(both, salt + _U(5)) % n


def _pilots(bucket: np.ndarray, f: np.ndarray, g: np.ndarray, n: int) -> np.ndarray | None:
    """A pilot for each bucket, the fullest first, or None where one can't be placed."""
    size = np.bincount(bucket, minlength=-(-n // PER_BUCKET))
    order = np.argsort(bucket, kind="stable")
    start = np.concatenate([[0], np.cumsum(size)])
    pilots = np.zeros(len(size), dtype=np.int64)
    taken = np.zeros(2 * n, dtype=bool)  # twice over, so that a shift by d1 is a slice
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        at = order[start[b]:start[b + 1]]
        for d0 in range(MOVES):
            base = (f[at] + d0 * g[at]) % n
            if len(set(base.tolist())) < len(base):
                continue
            shut = taken[base[0]:base[0] + n].copy()
            for x in base[1:]:
                shut |= taken[x:x + n]
            d1 = int(np.argmin(shut))
            if not shut[d1]:
                slots = (base + d1) % n
                taken[slots] = taken[slots + n] = True
                pilots[b] = d0 * n + d1
                break
        else:
            return None
    alone = order[start[:-1][size == 1]]
    pilots[bucket[alone]] = (np.flatnonzero(~taken[:n])[:len(alone)] - f[alone]) % n
    return pilots


def build(low: np.ndarray, high: np.ndarray, count: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, pilots (int64), fingerprints (uint64) and counts (int64) of one shard with distinct keys, at least one."""
    n, seed = len(low), 0
    while True:
        bucket, f, g = (x.astype(np.int64) for x in _places(low, high, seed, n))
        pilots = _pilots(bucket, f, g, n)
        if pilots is not None:
            break
        seed += 1
    slot = _slots(f, g, pilots[bucket], n)
    prints, counts = np.zeros(n, dtype=_U), np.zeros(n, dtype=np.int64)
    prints[slot], counts[slot] = high, count
    return seed, pilots, prints, counts


def _slots(f, g, pilot, n):
    return (f + pilot // n * g + pilot % n) % n


class Index:
    """Some or all shards, laid end to end: counts of many keys are looked up without a loop."""

    def __init__(self, shards: int, parts: list[tuple[int, int, bytes, bytes, bytes]]):
        """``parts``: shard, seed, and the bytes of pilots (int64), fingerprints and counts."""
        self.shards = shards
        self.n, self.seed, self.first_bucket, self.first_slot = (np.zeros(shards, dtype=np.int64) for _ in range(4))
        pilots, prints, counts, b, s = [], [], [], 0, 0
        for shard, seed, p, h, c in parts:
            p, h, c = np.frombuffer(p, np.int64), np.frombuffer(h, _U), np.frombuffer(c, np.int64)
            self.n[shard], self.seed[shard], self.first_bucket[shard], self.first_slot[shard] = len(h), seed, b, s
            pilots.append(p)
            prints.append(h)
            counts.append(c)
            b, s = b + len(p), s + len(h)
        none = np.zeros(0, dtype=np.int64)
        self.pilots, self.counts = np.concatenate([none, *pilots]), np.concatenate([none, *counts])
        self.prints = np.concatenate([none.astype(_U), *prints])

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Count of each key, 0 for keys that are not indexed."""
        out = np.zeros(len(low), dtype=np.int64)
        shard = shard_of(low, self.shards)
        known = np.flatnonzero(self.n[shard] > 0)
        if len(known):
            low, high, shard = low[known], high[known], shard[known]
            n = self.n[shard]
            bucket, f, g = (x.astype(np.int64) for x in _places(low, high, self.seed[shard], n))
            slot = self.first_slot[shard] + _slots(f, g, self.pilots[self.first_bucket[shard] + bucket], n)
            out[known] = np.where(self.prints[slot] == high, self.counts[slot], 0)
        return out
