"""Hard negatives against a plain version in Python integers; the residue number system alone."""

import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolesieve.llm import hard_negatives
from rolesieve.llm.hard_negatives import PRIMES, Side, mine, primes_for, scores
from rolesieve.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, g int"


def plain(rows, anchor, positives=5, negatives=5, low=80):
    usable = []
    for at, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((at, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = Counter()

    def order(r):
        return -r[0], r[1] is None, r[1] or 0, r[2]

    for at, i, v, label in usable:
        if i is None or not anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, o, m) for o, j, w, m in usable if o != at and len(w) == len(v)]
        same = sorted((s for s in scored if s[3] == label), key=order)[:positives]
        for p, j, _, _ in same:
            fits = sorted((s for s in scored if s[3] != label and low * p <= 100 * s[0] <= 100 * p), key=order)[:negatives]
            for rank, (s, n, _, _) in enumerate(fits, 1):
                out[(i, j, rank, n, p, s)] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, m, "x", 1) for i, v, m in rows], SCHEMA)


def vectors(n, dims, seed, size=1.0):
    draw = random.Random(seed)
    return [(i, [draw.uniform(-size, size) + (0.4 if i % 3 else 0) for _ in range(dims)], draw.choice([0, 0, 0, 1, 2, 5])) for i in range(n)]


ODD = [
    (0, None, 1), (1, [1.0, 2.0], None), (2, [], 1), (3, [], 1), (4, [], 2), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
    (7, [None, 1.0], 1), (8, [0.0, 0.0], 1), (9, [0.0, 0.0], 1), (10, [0.0, 0.0], 2), (None, [1.0, 0.5], 2), (None, [1.0, 0.5], 2), (11, [1.0, 0.5], 1),
    (11, [1.0, 0.5], 1), (12, [1.0, 0.5], 2), (13, [-1.0, -0.5], 1), (14, [1.0, 0.25], 3), (15, [1.0], 1), (16, [0.9, 0.5], 1),
]
COPIES = [(i, [0.5, 0.25, -0.5], i % 2) for i in range(90)]


@pytest.mark.parametrize("case", ["odd", "copies", "drawn", "wide", "large"])
def test_equals_plain(spark, case, monkeypatch):
    # several blocks, strips and groups
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 32)
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "SLICE", 7)
    rows = {
        "odd": ODD, "copies": COPIES, "drawn": vectors(400, 8, 1), "wide": vectors(60, 2100, 2), "large": vectors(80, 4, 3, 900_000.0),
    }[case]
    every = {"drawn": 10, "copies": 30}.get(case, 1)
    got = mine(frame(spark, rows), F.col("vec_id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = plain(rows, lambda i: i % every == 0)
    assert Counter(map(tuple, got.collect())) == expected
    assert expected or case == "copies"


def test_empty_tables(spark):
    assert mine(frame(spark, []), F.col("vec_id") % 1 == 0).count() == 0
    assert mine(frame(spark, ODD), F.lit(False)).count() == 0
    assert mine(frame(spark, ODD[:1]), F.lit(True)).count() == 0


def test_query_shifts_labels(spark, tmp_path):
    rows = vectors(420, 6, 4)
    frame(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    shifted = [(i, v, (m + 1) % 10 if i % 7 == 0 else m) for i, v, m in rows]
    got = Counter(map(tuple, op13_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == plain(shifted, lambda i: i % 100 == 0) and got


def side(values):
    n = len(values)
    row = SimpleNamespace(
        n=n, dims=values.shape[1], uids=np.arange(n).tobytes(), ids=np.arange(n).tobytes(), named=np.ones(n, bool).tobytes(),
        labels=np.zeros(n, np.int64).tobytes(), values=values.tobytes(), kind=values.dtype.name,
    )
    return Side(row)


@pytest.mark.parametrize("size,dims", [(1, 3), (127, 64), (256, 64), (256, 5000), (2**20, 1500), (2**29, 7), (2**30, 3), (0, 4), (5, 0)])
def test_scores_are_exact(size, dims):
    draw = np.random.default_rng(size + dims)
    a, b = (draw.integers(-size, size + 1, (9, dims)) for _ in range(2))
    if size:
        a[0], b[0], b[1] = size, size, -size
    exact = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    assert scores(side(a), side(b), slice(0, 9)).tolist() == exact


def test_primes_follow_the_bound():
    assert len(primes_for(256 * 256 * 65.0)) == 3 and len(primes_for(10.0)) == 1
    assert math.prod(PRIMES) < 2**63 and all(p % q for p in PRIMES for q in range(2, p))
    assert hard_negatives.DEPTH * (max(PRIMES) // 2) ** 2 < 2**24
    with pytest.raises(OverflowError):
        primes_for(2.0**62)
