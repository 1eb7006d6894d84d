import numpy as np
import pytest

from terminus.llm import embedding_dedup as ed


def brute(rows, cosine=0.9):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, float)
            ok[k] = x / np.linalg.norm(x)
    links = {k: [m for m in ok if m != k and len(ok[m]) == len(ok[k]) and ok[k] @ ok[m] >= cosine] for k in ok}
    label = {k: rows[k][0] for k in range(len(rows))}
    for _ in rows:
        for k, near in links.items():
            label[k] = min([label[k]] + [label[m] for m in near])
    return sorted((rows[k][0], len(links.get(k, [])), label[k], label[k] == rows[k][0]) for k in range(len(rows)))


def made(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    for i in range(n // 2):
        base[n - 1 - i] = base[i % 9] + spread * rng.standard_normal(dim)
    return [(int(i * 3 + 1), [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize("dim,blocks,chunk,cell_dims,spread", [(64, 4, 20_000, 1, 0.3), (64, 8, 37, 2, 0.34),
                                                             (7, 4, 20, 1, 0.3), (3, 4, 11, 2, 0.1), (1, 4, 20, 1, 0.1)])
def test_against_brute_force(spark, dim, blocks, chunk, cell_dims, spread):
    rows = made(200, dim, dim, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = ed.near_embeddings(df, blocks=blocks, chunk=chunk, cell_dims=cell_dims).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, -0.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-30, 0.0]),
            (13, [1.0, 0.48]), (14, [1.0, 0.49])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rep int, n_links int")
    got = ed.near_embeddings(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute(rows)
    again = ed.near_embeddings(df.union(spark.createDataFrame([(7, [1.0, 0.0], 1, 2), (None, [1.0, 0.0], 1, 2)], df.schema)))
    got = {}
    for r in again.collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[None] == [(0, None, True)] and got[7] == [(5, 7, True)] * 2 and len(got) == 15
    assert ed.near_embeddings(df.limit(0)).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = ed.near_embeddings(df).collect()
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute(rows)
