"""Centroid clustering, hard negatives and line dedup against plain versions, on rows with every odd case."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillwatch.llm import centroids, hard_negatives, line_dedup, perfect_hash
from fillwatch.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, cluster int, v string, apex string, pos long, block long, id long, score long"
DOCS = "doc_id long, text string, kept_text string, n_lines long, shard long, t string, salt string, hits string, n long"


def vector_rows(n=160, dims=64):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 0.3, (5, dims))
    rows = [(k, [float(np.float32(x)) for x in middle[k % 5] + rng.normal(0, 0.08, dims)], k % 5) for k in range(n)]
    same = rows[10][1]
    rows += [(1000 + k, same, 0) for k in range(40)]  # equal vectors
    rows += [(50, rows[3][1], 3), (50, same, 0), (50, same, 0)]  # an anchor's id again
    rows += [(2000, None, 1), (2050, [0.5] * dims, None), (2100, [None] + [0.1] * (dims - 1), 2), (2150, [float("nan")] + [0.1] * (dims - 1), 2),
             (2200, [float("inf")] + [0.1] * (dims - 1), 2), (2250, [], 1), (2300, [0.1] * (dims - 1), 1), (2350, [0.0] * dims, 2),
             (None, [0.2] * dims, 3), (2450, [9000.0] * dims, 4), (-50, [0.3] * dims, 1)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "v", "a", 1, 2, 3, 4) for r in rows], VECTORS)


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = [v for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))[::-1]

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        now = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(now)]
    out = [(i, *nearest(v)) for i, v in kept]
    own = Counter()
    for _, c, d in out:
        own[c] += d
    return sorted(((i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, c, d in out), key=repr)


def test_clusters(spark):
    rows = vector_rows()
    found = centroids.cluster(vector_frame(spark, rows).repartition(5))
    assert sorted((tuple(r) for r in centroids.described(found).collect()), key=repr) == plain_clusters(rows)
    assert 0 < found.compared[-1] < 8 * found.n  # bounds spare exact distances


@pytest.mark.parametrize("rows", [vector_rows()[:3], [(k, [0.25] * 64, 1) for k in range(9)], [(k, [float(k % 2)] * 64, 1) for k in range(30)]])
def test_clusters_of_few_or_equal_vectors(spark, rows):
    got = centroids.described(centroids.cluster(vector_frame(spark, rows)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows)


def test_clusters_of_nothing(spark):
    got = centroids.described(centroids.cluster(vector_frame(spark, vector_rows()[:1]).where("vec_id < 0")))
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_the_range_are_set_to_its_end(spark):
    rows = [(k, [3e38 if k == 3 else k / 10] + [0.0] * 63, 1) for k in range(6)]
    got = {r["vec_id"]: r for r in centroids.cluster(vector_frame(spark, rows)).assigned.collect()}
    assert len(got) == 6 and got[3]["distance"] == 0


@pytest.mark.parametrize("dims", [3, 64])
def test_bounds_enclose_distances(dims):
    rng = np.random.default_rng(dims)
    rows, others = (np.floor(rng.normal(0, 300, (n, dims))).astype(np.int64) for n in (400, 12))
    rows[:20] = rows[20]
    simplex = centroids.Simplex.over(rows[:100], 12)
    assert len(simplex.pivots) <= min(12, dims + 1)
    low, high = centroids.bounds(simplex.apexes(rows), simplex.apexes(others))
    exact = ((rows[:, None] - others[None]) ** 2).sum(2)
    assert (low <= exact).all() and (exact <= high).all()
    assert (low > exact.min(1)[:, None]).mean() > 0.05


def plain_negatives(rows, anchors, positives=5, negatives=3, scale=256):
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, lab, v) in enumerate(kept):
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == lab) for n, (j, other, w) in enumerate(kept) if n != k)
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            fit = [(t, u) for t, u, mine in scored if not mine and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, j, r + 1, u, -s, -t) for r, (t, u) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"anchor_block": 3, "row_block": 16}])
def test_negatives(spark, sizes):
    rows = vector_rows()
    got = hard_negatives.mine(vector_frame(spark, rows).repartition(5), anchors=F.col("vec_id") % 50 == 0, **sizes)
    want = plain_negatives(rows, lambda i: i % 50 == 0)
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_negatives_at_score_zero(spark):
    """A positive of score 0 opens a window that holds only 0, and comes before negatives with smaller ids."""
    rows = [(50, [1.0, 0.0], 1), (60, [0.0, 1.0], 1), (3, [0.0, 2.0], 2), (4, [0.0, 3.0], 2), (5, [-1.0, 0.0], 3)]
    got = hard_negatives.mine(vector_frame(spark, rows), anchors=F.col("vec_id") == 50)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, lambda i: i == 50) == [(50, 60, 1, 3, 0, 0), (50, 60, 2, 4, 0, 0)]


def test_negatives_without_anchors_or_rows(spark):
    rows = vector_frame(spark, vector_rows()[:20])
    assert hard_negatives.mine(rows, anchors=F.col("vec_id") == 777).count() == 0
    assert hard_negatives.mine(rows.where("vec_id < 0")).count() == 0
    assert hard_negatives.mine(rows.where("vec_id = 0")).count() == 0


def test_products_beyond_the_exact_floats(spark):
    rows = [(k, [float(1 << 19) + k, 1.0 / (k + 1)], k % 2) for k in range(12)]
    got = hard_negatives.mine(vector_frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>")))
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives([(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows], lambda i: True)


def test_keys_sort_as_pairs_do():
    rng = random.Random(2)
    pairs = [(rng.choice([-3, 0, 7, 1 << 40]), rng.randint(-99, 99) << rng.choice([0, 40]), rng.random() < 0.5, rng.randint(-9, 9)) for _ in range(300)]
    assert [hard_negatives.unpack_key(hard_negatives.pack_key(*p)) for p in pairs] == pairs
    assert sorted(pairs, key=lambda p: hard_negatives.pack_key(*p)) == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 300, 20_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    low, high = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    high[: n // 2] = high[0] + np.arange(n // 2, dtype=np.uint64)
    if n > 4:
        low[1] = low[0]  # one lane in common
    count = rng.integers(1, 99, n)
    seed, pilots, prints, counts = perfect_hash.build(low, high, count)
    assert sorted(prints.tolist()) == sorted(high.tolist()) and len(counts) == n
    index = perfect_hash.Index(1, [(0, seed, pilots.tobytes(), prints.tobytes(), counts.tobytes())])
    assert (index.count(low, high) == count).all()
    assert not index.count(low, high ^ np.uint64(1 << 62)).any()
    assert len(index.count(low[:0], high[:0])) == 0


def doc_rows():
    shared = ["All rights reserved.", "  ALL rights reserved.\t", "\x0ball RIGHTS reserved.\r", "É voilà", "é voilà", "-", "漢字"]
    rng = random.Random(6)
    rows = [(k, "\n".join([f"own line {k}", rng.choice(shared[:3]), *rng.sample(shared, 2), "", " ", f"own {k % 7}"]), ) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, " \n\n\t"), (104, "x" * 200_000 + "\nall rights reserved.\n" + "long\n" * 5000), (105, "-\n-\n-"),
             (106, "a\x1cb\nno\x85break here"), (None, "all rights reserved.\nend"), (None, "all rights reserved.\nother"), (1, "own line 1\n-"), (1, "own line 1\n-")]
    return [r if len(r) == 2 else (r[0], r[1]) for r in rows] + [(200 + k, "the same text\nall over\nall over") for k in range(9)]


def plain_lines(rows, min_docs=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or seen[key(x)] < min_docs]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"shard_keys": 2}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "shard_keys": 3, "salt_rows": 20}])
@pytest.mark.parametrize("min_docs", [2, 9, 10])
def test_lines(spark, how, min_docs):
    rows = doc_rows()
    docs = spark.createDataFrame([(*r, "old", 1, 2, "t", "s", "h", 9) for r in rows], DOCS).repartition(4)
    got = line_dedup.drop_lines(docs, min_docs, **how)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_lines(rows, min_docs)


def test_lines_of_nothing(spark):
    docs = spark.createDataFrame([(*r, "old", 1, 2, "t", "s", "h", 9) for r in doc_rows()[:1]], DOCS)
    assert line_dedup.drop_lines(docs.where("doc_id < 0")).count() == 0
    assert line_dedup.drop_lines(docs.where("doc_id < 0"), broadcast_bytes=-1).count() == 0
    assert [r["n_dropped"] for r in line_dedup.drop_lines(docs).collect()] == [0]
    with pytest.raises(ValueError):
        line_dedup.drop_lines(docs, 1)


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_hard_negatives", "op13_line_dedup"])
def test_queries_take_whole_tables(spark, name):
    table = "documents" if name.startswith("op13") else "embeddings"
    rows = [(r[0], r["text"]) if table == "documents" else (r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{DATA}/{table}.parquet").collect()]
    got = QUERIES[name](spark, DATA)
    if name.startswith("op13"):
        assert sorted(tuple(r) for r in got.collect()) == sorted((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in plain_lines(rows))
    elif name.startswith("op12"):
        moved = [(i, v, (lab + 1) % 10 if lab is not None and i % 7 == 0 else lab) for i, v, lab in rows]
        assert sorted(tuple(r) for r in got.collect()) == plain_negatives(moved, lambda i: i % 50 == 0)
    else:
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows)
