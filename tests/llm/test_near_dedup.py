import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terminus.llm import near_dedup as nd
from terminus.llm.components import components


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute_groups(ids, texts):
    sets, label = brute_sets(texts), {i: i for i in ids}
    changed = True
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            lo = min(label[ids[a]], label[ids[b]])
            for x in (ids[a], ids[b]):
                if label[x] != lo:
                    label[x], changed = lo, True
    return {i: (len(s), label[i]) for i, s in zip(ids, sets, strict=True)}


def test_whole_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute_groups([r[0] for r in rows], [r[1] for r in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs).collect()}
    assert got == want


def test_edges_nulls_empty_short_repeated_and_extra_columns(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", " ".join(base), " ".join(base[:58] + ["x", "y"]),
             " ".join(base), "ünï Üni", "a" * 50_000]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(6, " ".join(base), "x", "y"), (None, "one", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, rep string")
    got = nd.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    want = brute_groups(list(range(len(texts))), texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in by.items()} == want
    null = [r for r in got if r.doc_id is None][0]
    assert (null.n_shingles, null.component_id, null.kept) == (1, None, True)
    left = nd.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [0, 1, 2, 3, 5, 6, 9, 10]
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_hot_bucket_links_that_miss_the_smallest_member(spark):
    # A chain: each text is close to the next, the ends are far apart.
    base = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(12):
        words = list(base)
        for j in range(i * 3, i * 3 + 3):
            words = words[:j * 5] + [f"z{j}"] + words[j * 5 + 1:]
        base = words
        rows.append((100 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups([r[0] for r in rows], [r[1] for r in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df).collect()} == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=300, unique=True))
def test_super_minhash_equals_the_element_by_element_form(values):
    m = 24
    got = nd.super_minhash(np.array(values, np.uint64), np.zeros(len(values), int), 1, m)[0]
    want = [int(nd.EMPTY_SLOT)] * m
    for v in values:
        perm = list(range(m))
        for rank in range(m):
            rnd = int(nd.mix64(np.array([v + int(nd.GOLDEN) * (rank + 1) & 2**64 - 1], np.uint64))[0])
            pick = rank + (rnd >> 32) % (m - rank)
            perm[rank], perm[pick] = perm[pick], perm[rank]
            want[perm[rank]] = min(want[perm[rank]], rank << 32 | rnd & 0xFFFFFFFF)
    assert got.tolist() == want


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:343], rng.integers(0, 2**63, 57, dtype=np.uint64)])  # 343 / 457
    sig = nd.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 400), 2, 250)
    assert abs((sig[0] == sig[1]).mean() - 343 / 457) < 0.08


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1, 0), (7, 7)], "a long, b long").repartition(3)
    assert {(r.node, r.component) for r in components(edges).collect()} == {(i, 0) for i in range(n + 1)}
    assert components(edges.limit(0)).count() == 0


def test_large_group_of_near_copies_around_the_threshold(spark):
    import random
    rng = random.Random(2)
    base = [f"g{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in rng.sample(range(24), 1 + i % 5):
            words[j * 5] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups([r[0] for r in rows], [r[1] for r in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df).collect()} == want
