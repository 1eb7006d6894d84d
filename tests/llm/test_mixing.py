import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from terminus.llm import mixing


def shares(budget, nodes):
    """Children's parts by repeated redistribution: (weight, capacity) each."""
    got, open_ = [0.0] * len(nodes), set(range(len(nodes)))
    while open_:
        left = budget - sum(got[i] for i in range(len(nodes)) if i not in open_)
        w = sum(nodes[i][0] for i in open_)
        full = {i for i in open_ if nodes[i][1] <= left * nodes[i][0] / w}
        for i in full or open_:
            got[i] = nodes[i][1] if i in full else left * nodes[i][0] / w
        if not full:
            break
        open_ -= full
    return got


def brute(rows, weights, share, max_epochs, seed):
    """rows: (doc_id, a, b, n_tokens) -> {(doc_id, epoch)}"""
    out = set()
    tree = defaultdict(lambda: defaultdict(list))
    for r in rows:
        tree[r[1]][r[2]].append(r)
    cap = lambda docs: max_epochs * sum(d[3] for d in docs)
    tops = sorted(tree)
    budget = int(sum(r[3] for r in rows) * share)
    for top, b in zip(tops, shares(budget, [(weights["a"].get(t, 1.0), sum(map(cap, tree[t].values()))) for t in tops]),
                      strict=True):
        leaves = sorted(tree[top])
        for leaf, t in zip(leaves, shares(b, [(1.0, cap(tree[top][x])) for x in leaves]), strict=True):
            docs = tree[top][leaf]
            tokens, target = sum(d[3] for d in docs), int(t + 1e-6)
            whole = min(max_epochs, target // tokens) if tokens else 0
            out |= {(d[0], e) for d in docs for e in range(whole)}
            run = 0
            if whole < max_epochs:
                for d in sorted(docs, key=lambda d: (hashlib.md5(f"{seed}|{whole}|{d[0]}".encode()).hexdigest(), d[0])):
                    run += d[3]
                    if run > target - whole * tokens:
                        break
                    out.add((d[0], whole))
    return out


def test_against_brute_force_with_shortages(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)  # many buckets per leaf
    rows = [(i, "xyz"[i % 7 % 3], "pq"[i % 5 % 2], 1 + i * 37 % 11) for i in range(400)]
    rows += [(1000 + i, "tiny", "p", 2) for i in range(3)]
    df = spark.createDataFrame([(i, a, b, " ".join(["w"] * n)) for i, a, b, n in rows],
                               "doc_id long, a string, b string, text string")
    for weights, share, epochs in [({"a": {"tiny": 50.0, "x": 3.0}}, 0.7, 3), ({"a": {}}, 1.0, 1), ({"a": {"y": 9.0}}, 0.9, 2)]:
        got = mixing.mix(df, ("a", "b"), weights, share, epochs, 7, {}).collect()
        assert len(got) == len({(r.doc_id, r.epoch) for r in got})
        assert {(r.doc_id, r.epoch) for r in got} == brute(rows, weights, share, epochs, 7)


def test_edges(spark):
    rows = [(1, None, None, None, 9), (2, "", "en", "s", 9), (None, "a b", "en", "s", 9), (3, "w " * 30_000, "en", "s", 9),
            (4, "a b c", None, "t", 9), (4, "a b c", None, "t", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    got = mixing.mix(df, share=1.0, max_epochs=1).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert {r.epoch for r in got} == {0}
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df).columns == ["doc_id", "text", "lang", "source", "n_tokens", "epoch"]


def test_budget_is_met_and_weights_show(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(docs, share=0.5, max_epochs=2)
    total = docs.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORDS)))).first()[0]
    used = out.agg(F.sum("n_tokens")).first()[0]
    assert 0.4 * total < used <= 0.5 * total
