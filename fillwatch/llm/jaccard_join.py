"""N-gram Jaccard join by PartEnum signatures.

Sets of similar size differ in few elements if they are similar, so the feature domain is cut into partitions by a
hash and subsets of the partitions are enumerated such that two similar sets of a size band agree on at least one
of them entirely; the hash of that content is a signature that both have.

For an instance with largest size R two similar sets differ in at most k = 2 R (1 - g) / (1 + g) elements. Of
n1 = k // 2 + 1 + spare first-level partitions (the spare ones by expected cost) at least 1 + spare hold at most one difference, and of the n2 = ``PARTS`` parts of
such a partition all but one (the subsets of size n2 - k2 with k2 = 1) hold none together. A subset that is empty says nothing;
a set with an empty subset in more than ``spare`` partitions is "bare" and is cut again by another hash. Two bare sets meet
there; if one of two similar sets is not bare, they agree on a subset with content. No signature of an empty subset is needed,
except at the last of ``FAMILIES`` hashes, where bare sets give them all.

``PARTS`` trades signatures against chance: with three parts a signature stands for two thirds of some twelve shingles, and texts that
share a passage of half their shingles agree on one in 300 of them; with two parts it is one in 70, for two thirds of the signatures.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.llm.common import map_rows, stored
from fillwatch.llm.components import components, extended
from fillwatch.session import scalar_row
from fillwatch.session import width as tasks

WORDS = 4
FAMILIES = 8
PARTS = 3
PASSES = 4  # over the signatures
SLICE_BYTES = 1 << 20  # of texts whose words are held at once
SMALL = 8  # buckets of so many members are paired by a join, larger ones in blocks
BLOCK = 1024
GROUP_ROWS = 2048  # members of large buckets that a task compares in one call, about
PIVOTS = 3  # members of each bucket that all others are compared with first
_find = re.compile(rb"[^ \t-\r]+").findall
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return _find((text or "").encode("utf-8", "surrogatepass").lower())


def shingle_set(text: str | None, width: int = WORDS) -> set:
    """Distinct shingles; the whole sequence if there are fewer words than ``width``."""
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(width)]))


def _spare(size: int, differing: int) -> int:
    """Spare partitions for which a set of a band costs the fewest signatures: more of them are more signatures and smaller
    partitions, fewer leave more sets bare. Judged by Poisson counts at sizes that the sets of a band and of the one before have."""
    def cost(spare: int) -> float:
        n1, total = differing + 1 + spare, 0.0
        for part in (0.57, 0.63, 0.75, 0.9):
            empty = n1 * min(1.0, PARTS * math.exp(-part * size / n1 * (PARTS - 1) / PARTS))  # expected partitions with an empty subset
            bare = 0.5 * math.erfc((spare + 0.5 - empty) / math.sqrt(2 * empty + 1e-9))
            total += n1 * min(1 / (1 - bare + 1e-9), FAMILIES)
        return total

    return min({differing * k // 24 + j for k in range(37) for j in (0, 1, 2)}, key=cost)


@lru_cache(maxsize=4)
def bands(percent: int) -> list[tuple[int, int, int]]:
    """(largest size, first-level partitions, spare) of each instance; sizes grow by half."""
    out, size = [], 1
    while size < 1 << 40:
        k = 2 * size * (100 - percent) // (100 + percent)
        spare = _spare(size, k // 2)
        out.append((size, k // 2 + 1 + spare, spare) if k else (size, 0, 0))
        size = max(size + 1, size * 3 // 2)
    return out


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set of 64-bit elements. Bands in which similar sets are equal need none."""
    n, sigs = len(s), []
    limits = bands(percent)
    j = next(i for i, b in enumerate(limits) if n <= b[0])
    for i in [j] + [j + 1] * (100 * n >= percent * (limits[j][0] + 1)):
        _, n1, spare = limits[i]
        if not n1:
            continue
        for family in range(FAMILIES):
            salt = np.uint64((i * FAMILIES + family + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h = _mix(s ^ salt)
            part = (h % np.uint64(PARTS * n1)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, h = part[order], _mix(h[order] + _A)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            content = np.zeros(PARTS * n1, np.uint64)
            content[part[first]] = np.add.reduceat(h, first)
            content = content.reshape(n1, PARTS)
            count = np.bincount(part, minlength=PARTS * n1).reshape(n1, PARTS)
            # a subset is all parts of a partition but one
            rest = (content.sum(1, dtype=np.uint64)[:, None] - content).ravel()
            full = (count.sum(1)[:, None] > count).ravel()
            name = np.arange(PARTS * n1, dtype=np.uint64) * _A
            sigs.append(_mix((rest[full] ^ salt) + name[full]))
            if int((~full.reshape(n1, PARTS)).any(1).sum()) <= spare:
                break
            if family == FAMILIES - 1:
                sigs.append(_mix(salt + name[~full]))
    return np.unique(np.concatenate(sigs)) if sigs else np.zeros(0, np.uint64)


def batch_sets(texts: list[str | None], width: int, salt: int) -> list[np.ndarray]:
    """Distinct 64-bit hashes of the shingles of each text, sorted."""
    words = [words_of(t) for t in texts]
    size = [len(w) for w in words]
    code, distinct = pd.factorize(np.array([w for own in words for w in own], object))
    key = f"shingles-{salt:07d}"[:16]
    hashes = pd.util.hash_array(np.asarray(distinct, object), hash_key=key, categorize=False)[code] if len(code) else np.zeros(0, np.uint64)
    out, at = [], 0
    for n in size:
        x = hashes[at:at + n]
        at += n
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        m = min(n, width)
        h = np.full(n - m + 1, np.uint64(m))
        for k in range(m):
            h = h * _A + x[k:n - m + 1 + k]
        out.append(np.unique(_mix(h)))
    return out


def fingerprint(sets: list[np.ndarray]) -> np.ndarray:
    return _mix(np.array([_mix(s).sum(dtype=np.uint64) for s in sets], np.uint64))


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the elements that fall on each of 2 to 4 bits per element. Two sets differ in at least as many elements as
    their sketches in bits, so a larger distance rules a pair out; folding halves onto each other keeps that."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    at = (_mix(s ^ _B) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").view("<i8")


def signed_sets(docs: DataFrame, *, percent: int, width: int, salt: int = 0) -> DataFrame:
    """``doc_id, n_shingles, h, h2, sigs, text_hash, sketch``: size, two fingerprints, signatures and sketch of each row's set."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = batch_sets(batch.column(1).to_pylist(), width, salt)
        h = fingerprint(sets)
        h2 = np.array([_mix(s ^ _A).sum(dtype=np.uint64) for s in sets], np.uint64)
        sigs = [signatures(s, percent).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
        return pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h.view(np.int64)),
                                pa.array(h2.view(np.int64)), pa.array(sigs, pa.list_(pa.int64())), batch.column(2),
                                pa.array([odd_sketch(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "h", "h2", "sigs", "text_hash", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return map_rows(rows, run, "doc_id long, n_shingles long, h long, h2 long, sigs array<long>, text_hash long, sketch array<long>", SLICE_BYTES)


def _of_set(rows: DataFrame, width: int, salt: int) -> DataFrame:
    """Rows of ``h, text`` whose text has the set ``h``: a repeated id may belong to several texts."""
    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = fingerprint(batch_sets(batch.column(1).to_pylist(), width, salt)).view(np.int64)
        return batch.filter(pa.array(own == batch.column(0).to_numpy()))

    return map_rows(rows, check, "h long, text string", SLICE_BYTES)


def _near(na, nb, percent: int):
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _short(name: str) -> list:
    """A sketch folded to two words, and whether it had just one."""
    odd = lambda k: F.aggregate(F.filter(name, lambda x, i: i % 2 == k), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    return [odd(0).alias("s0"), odd(1).alias("s1"), (F.size(name) == 1).alias("one")]


def _may_link(percent: int, other: str = "p"):
    """Whether sizes and folded sketches of a member and of its partner (columns of the struct ``other``) leave a pair possible."""
    o = lambda c: F.col(f"{other}.{c}")
    x0, x1 = F.col("s0").bitwiseXOR(o("s0")), F.col("s1").bitwiseXOR(o("s1"))
    differ = F.when(F.col("one") | o("one"), F.bit_count(x0.bitwiseXOR(x1))).otherwise(F.bit_count(x0) + F.bit_count(x1))
    return _near(F.col("n"), o("n"), percent) & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + o("n")))


def _possible(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that their whole sketches don't rule out either."""
    one = vertices.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = vertices.select(F.col("h").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def folded(own: str, other: str):
        half = (F.size(own) / 2).cast("int")
        return F.when(F.size(own) > F.size(other), F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(own))

    differ = F.aggregate(F.zip_with(folded("sa", "sb"), folded("sb", "sa"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = pairs.join(one, "a").join(two, "b").where(_near(F.col("na"), F.col("nb"), percent))
    return near.where((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def _blocks(members: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within large buckets that sizes and sketches allow. The members of a bucket are cut
    into blocks of ``BLOCK``; a task compares the sketches of two blocks at a time, for many buckets in one call, and returns what is left."""
    def met(sketches, n, c, h, block, i, j) -> np.ndarray:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = [np.zeros((0, 2), np.int64)]
        if not len(left) or not len(right) or (c == c[0]).all():
            return out[0]
        size = min(map(len, sketches))
        sketch = np.stack([x if len(x) == size else np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in sketches])
        for k in range(0, len(left), 32):
            p = left[k:k + 32]
            differ = np.bitwise_count(sketch[p][:, None, :] ^ sketch[right][None, :, :]).sum(-1, dtype=np.int64)
            total = n[p][:, None] + n[right][None, :]
            small, big = np.minimum(n[p][:, None], n[right]), np.maximum(n[p][:, None], n[right])
            ok = ((100 + percent) * differ <= (100 - percent) * total) & (100 * small >= percent * big) & (c[p][:, None] != c[right])
            if i == j:
                ok &= h[p][:, None] < h[right]
            x, y = np.nonzero(ok)
            out.append(np.stack([h[p][x], h[right][y]], axis=1))
        return np.concatenate(out)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sig", "i", "j"])
        sig, i, j, n, c, h, block = (rows[k].to_numpy() for k in ("sig", "i", "j", "n", "c", "h", "block"))
        sketch = rows["sketch"].tolist()
        first = np.flatnonzero((np.diff(sig, prepend=0) != 0) | (np.diff(i, prepend=-1) != 0) | (np.diff(j, prepend=-1) != 0)).tolist()
        out = [np.zeros((0, 2), np.int64)]
        for a, b in zip(first, [*first[1:], len(sig)]):
            out.append(met(sketch[a:b], n[a:b], c[a:b], h[a:b], block[a:b], i[a], j[a]))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    rows = members.withColumn("last", F.floor((F.col("m") - 1) / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h", "sig"), F.col("last") + 1).cast("int"))
    rows = rows.select("sig", "h", "c", "block", "last").join(vertices.select("h", "n", "sketch"), "h").select("*", F.explode(F.sequence(F.lit(0), "last")).alias("k"))
    rows = rows.select("sig", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "h", "c", "n", "sketch")
    # a call costs more than a small bucket's pairs, so one call gets the block pairs of many buckets
    fed = scalar_row(members.agg(F.coalesce(F.sum(F.floor((F.col("m") - 1) / BLOCK) + 1), F.lit(0)).alias("n")))["n"]
    calls = fed // GROUP_ROWS + tasks(members)
    found = rows.groupBy(F.pmod(F.xxhash64("sig", "i", "j"), F.lit(calls)).alias("call")).applyInPandas(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs ``a, b`` whose sets, made anew from the texts, are similar enough."""
    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, keep, last, known = batch.column(0), batch.column(1), [], None, set()
        for key, x, y in zip(a.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if key != last:
                last, known = key, shingle_set(x, width)
            other = shingle_set(y, width)
            both = len(known & other)
            keep.append(100 * both >= percent * (len(known) + len(other) - both))
        keep = pa.array(keep, pa.bool_())
        return pa.record_batch([a.filter(keep), b.filter(keep)], ["a", "b"])

    left = texts.select(F.col("h").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("h").alias("b"), F.col("text").alias("y"))
    return map_rows(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y"), check, "a long, b long", SLICE_BYTES)


def jaccard_components(docs: DataFrame, *, percent: int = 85, width: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash`` of each row: the size of its set of word shingles and the smallest ``doc_id``
    that links reach from it. Two rows link when 100 * |intersection| >= percent * |union|.

    Rows with equal sets are one vertex, so copies are never paired. The vertices that share a signature are first compared
    with a few of them each, drawn anew for every signature; in buckets whose members are still in different components after that, all pairs of different
    components are compared, by size and sketch first. Links are judged on the texts. Null, empty and word-less texts have an empty
    set, size 0, and are linked with nothing: ``component_id`` is their own id. Rows with a null id have sizes but take no part
    in links and get a null component. Repeated rows have one component. Other columns are not read.
    """
    salt = 0
    while True:
        rows = stored(signed_sets(docs, percent=percent, width=width, salt=salt), "jaccard-sets")
        live = rows.where("n_shingles > 0 and doc_id is not null")
        # Two sets of one fingerprint h are told apart by h2; then everything is hashed anew with another salt.
        heads = stored(live.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.min("h2").alias("lo"), F.max("h2").alias("hi")), "jaccard-heads")
        if heads.where("lo <> hi").isEmpty():
            break
        salt += 1
    # Each pass exchanges its share of the signatures, so that they are never all on disk at once; a window streams through
    # them, and what is not shared goes before anything is written.
    whole = Window.partitionBy("sig")
    members = None
    for k in range(PASSES):
        own = live.select("h", F.explode("sigs").alias("sig")).where(F.pmod("sig", F.lit(PASSES)) == k).repartition("sig").groupBy("sig", "h").agg(F.lit(1).alias("one"))
        own = stored(own.select("sig", "h", F.min("h").over(whole).alias("lo"), F.max("h").over(whole).alias("hi")).where("lo < hi").select("sig", "h"), "jaccard-members")
        members = own if members is None else members.unionByName(own)
    label = None
    if not members.isEmpty():
        shared = stored(members.select("h").distinct(), "jaccard-shared")
        wanted = heads.select("h", "doc_id").join(shared, "h")
        vertices = stored(live.select("h", "doc_id", F.col("n_shingles").alias("n"), "sketch").join(wanted, ["h", "doc_id"])
                          .groupBy("h").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "jaccard-vertices")
        members = stored(members.join(vertices.select("h", "n", *_short("sketch")), "h"), "jaccard-sized-members")
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").select("h", "text")
        texts = stored(_of_set(found, width, salt), "jaccard-texts")
        known = members.withColumn("c", F.col("h"))
        facts = ("h", "n", "s0", "s1", "one")
        for k in range(PIVOTS):
            pivots = known.groupBy("sig").agg(F.min(F.struct(F.xxhash64("h", "sig", F.lit(k)).alias("u"), "c", *facts)).alias("p"))
            stars = known.join(pivots, "sig").where((F.col("c") != F.col("p.c")) & _may_link(percent)).select(
                F.least("h", "p.h").alias("a"), F.greatest("h", "p.h").alias("b")).distinct()
            new = stored(_linked(stored(_possible(stars, vertices, percent), "jaccard-pairs"), texts, percent, width), "jaccard-links")
            label = components(new) if label is None else extended(label, new)
            known = stored(members.join(label.withColumnRenamed("v", "h"), "h", "left").withColumn("c", F.coalesce("c", "h")), "jaccard-known")
        spread = known.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi and m > 2")
        still = stored(known.join(spread.select("sig", "m"), "sig"), "jaccard-open")
        small = still.where(F.col("m") <= SMALL)
        other = small.select("sig", F.struct("c", *facts).alias("p"))
        few = small.join(other, "sig").where((F.col("h") > F.col("p.h")) & (F.col("c") != F.col("p.c")) & _may_link(percent)).select(
            F.col("p.h").alias("a"), F.col("h").alias("b")).distinct()
        many = _blocks(still.where(F.col("m") > SMALL), vertices, percent)
        pairs = stored(_possible(few, vertices, percent).unionByName(many).distinct(), "jaccard-pairs")
        label = extended(label, stored(_linked(pairs, texts, percent, width), "jaccard-links"))
    base = rows.select("doc_id", "n_shingles", "text_hash", F.when(F.col("n_shingles") > 0, F.col("h")).alias("h"))
    if label is not None:
        base = base.join(label.withColumnRenamed("v", "h"), "h", "left").select("doc_id", "n_shingles", "text_hash", F.coalesce("c", "h").alias("h"))
    least = stored(base.where("doc_id is not null and h is not null").groupBy("h").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("m"))
                   .where("m > 1").select("h", "component_id"), "jaccard-least")
    return base.join(least, "h", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "text_hash")
