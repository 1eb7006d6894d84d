import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from terminus.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall(text.translate(LOWER)) if text else []


def brute(docs, items, top=20):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in dict.fromkeys(items):
        if item is not None:
            asked.setdefault(item, Counter()).update(words(text))
    out = []
    for item, query in asked.items():
        scored = []
        for doc, tf, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
                    for t, q in query.items() if t in tf)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(scored)[:top])]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß9", "Zebra"]
    docs = []
    for i in range(n):
        k = rng.choice([0, 1, 3, 12, 80])
        docs.append((i * 3, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(63)], k=k))))
    docs += [(7, docs[4][1]), (9, docs[4][1]), (9, "zebra W1"), (None, "zebra zebra"), (None, None), (2, None), (4, ""), (5, "-- !"),
             (1, "w1 " * 30_000 + "w59 zebra")]
    items = [(j, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 30])))) for j in range(25)]
    items += [(3, "w3 zebra"), (3, "w3 zebra"), (90, None), (91, ""), (92, "never heard"), (None, "w1"), (93, "É é ZEBRA")]
    return docs, items


def rows(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("shard_docs,block_terms", [(8192, 200_000), (40, 60)])
def test_against_brute_force(spark, monkeypatch, shard_docs, block_terms):
    monkeypatch.setattr(ls, "SHARD_DOCS", shard_docs)
    docs, items = corpus(shard_docs, 400)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, term string, score int").repartition(3)
    i = spark.createDataFrame([(*r, 5) for r in items], "item_id bigint, text string, doc_id int")
    assert rows(ls.search(d, i, block_terms=block_terms)) == sorted(brute(docs, items))
    assert rows(ls.search(d, i, top=3)) == sorted(brute(docs, items, 3))


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ls.search(d, i).collect() == []
    assert ls.search(i.select(i.item_id.alias("doc_id"), "text"), i.limit(0)).collect() == []
    assert ls.search(d, i).columns == ["item_id", "rank", "doc_id", "score"]


def test_stops_before_the_lists_end_and_loses_no_tie():
    """One rare heavy term and one frequent light one: the frequent list is not
    read to its end, and all documents that tie with the k-th are returned."""
    n = 5000
    term = np.concatenate([np.zeros(50, int), np.ones(n, int)])
    doc = np.concatenate([np.arange(50), np.arange(n)])
    shard = ls.Shard(term, doc, np.full(n, 10), n, 10 * n)
    read = []

    class Spy(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice) and isinstance(self, Spy) and key.start and key.stop:
                read.append(key.start)
            return np.ndarray.__getitem__(self, key)

    shard.doc = shard.doc.view(Spy)
    docs, scores = ls.best_positions(shard, [(0, 9000), (1, 10)], 20, np.empty(0, np.int64))
    assert len(docs) == 50 and len(set(scores.tolist())) == 1
    assert max(read) < n // 2
    floor = np.full(20, int(scores[0]) + 1)  # scores known from elsewhere are higher
    assert len(ls.best_positions(shard, [(0, 9000), (1, 10)], 20, floor)[0]) == 0
