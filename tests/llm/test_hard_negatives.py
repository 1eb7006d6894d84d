import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terminus.llm import hard_negatives as hn


def brute(rows, k=5, low=80, high=100):
    ok = [(i, tuple(math.floor(256 * x) for x in v), lab) for i, v, lab in rows
          if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, lab in ok:
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, w, m in ok if i != a and len(w) == len(v))
        for p, p_id, _ in [r for r in scored if r[2] == lab][:k]:
            found = [r for r in scored if r[2] != lab and low * -p <= 100 * -r[0] <= high * -p][:k]
            out += [(a, p_id, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(found)]
    return sorted(out)


def made(n, dim, size, seed):
    rng = random.Random(seed)
    base = [rng.gauss(0, size) for _ in range(dim)]
    rows = [(i, [b + rng.gauss(0, size) for b in base], rng.choice([1, 1, 1, 2, 3])) for i in range(n)]
    rows += [(n + i, rows[5][1], 1 + i % 2) for i in range(12)]  # ties
    return rows


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("dim,size,chunk", [(16, 0.3, 1 << 22), (16, 0.3, 100), (1, 0.3, 1 << 22), (5, 40.0, 64), (3, 1e5, 50), (4, 3e6, 1 << 22)])
def test_against_brute_force(spark, monkeypatch, dim, size, chunk):
    monkeypatch.setattr(hn, "CHUNK_VALUES", chunk)
    rows = made(150, dim, size, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert rows_of(hn.mine(df, F.col("vec_id") % 10 == 0)) == brute(rows)


def test_edges(spark):
    rows = made(60, 4, 0.4, 1)
    rows += [(200, None, 1), (210, [], 1), (220, [0.1, None, 0.2, 0.3], 1), (230, [float("nan")] * 4, 1), (240, [float("inf")] * 4, 2),
             (None, rows[0][1], 1), (250, rows[0][1], None), (260, [0.5, 0.5], 1), (261, [0.5, 0.5], 1), (262, [0.5, 0.45], 2),
             (270, [0.0] * 4, 3), (280, [1e307] * 4, 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, vector string, rank int")
    assert rows_of(hn.mine(df, F.col("vec_id") % 10 == 0)) == brute([r for r in rows if r[0] != 280])
    assert hn.mine(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert hn.mine(df, F.lit(False)).collect() == []
    assert hn.mine(df, F.lit(None).cast("boolean")).collect() == []
    # a repeated vec_id: two rows, neither a positive of the anchor of that id
    twice = rows[:40] + [(10, rows[3][1], 1), (11, rows[3][1], 1), (11, rows[3][1], 1)]
    got = rows_of(hn.mine(spark.createDataFrame(twice, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0))
    assert got and all(r[0] != r[1] for r in got)


@pytest.mark.parametrize("size,dim", [(2, 1), (255, 64), (30_000, 64), (1 << 24, 3), (1 << 26, 8), (1 << 40, 5)])
def test_packed_products_are_exact(size, dim):
    """From many fields a word down to one, and beyond to Python integers."""
    rng = np.random.default_rng(dim)
    c = rng.integers(-size, size, (37, dim), endpoint=True)
    a = rng.integers(-size // 2, size, (11, dim), endpoint=True)
    got = hn.Packed(c.astype(float)).scores(a.astype(float))
    want = a.astype(object).dot(c.astype(object).T)
    assert [[int(x) for x in r] for r in got] == want.tolist()


def test_constant_components():
    p = hn.Packed(np.full((3, 2), -7.0))
    assert p.scores(np.full((2, 2), 5.0)).tolist() == [[-70] * 3] * 2
    assert p.scores(np.zeros((1, 2))).tolist() == [[0] * 3]
