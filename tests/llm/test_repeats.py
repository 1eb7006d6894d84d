import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terminus.llm import repeats


def brute(texts, window=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + window] for d in raw for i in range(len(d) - window + 1))
    out = []
    for d in raw:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        spans, at = [], 0
        while (s := gone.find(1, at)) >= 0:
            e = gone.find(0, s)
            at = e if e >= 0 else len(d)
            spans.append((s, at))
        out.append((spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def stripped(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, digit string, run int").repartition(3)
    got = {r.doc_id: ([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in repeats.strip_repeats(df, **kw).collect()}
    return [got[i] for i in range(len(texts))]


def corpus(seed, n):
    """Prose with shared passages around the threshold, near and exact copies,
    and passages that overlap each other."""
    rng = random.Random(seed)

    def prose(k):
        return " ".join("".join(rng.choices("abcdefghé", k=rng.randint(2, 7))) for _ in range(k))

    passages = [prose(rng.choice([20, 36, 40, 44, 60, 90])) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = [prose(rng.choice([0, 1, 5, 60]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.choice(passages)
            lo = rng.choice([0, 0, rng.randrange(len(p))])
            parts += [p[lo:], prose(rng.choice([0, 1, 30]))]
        out.append(rng.choice(["", " ", "\n"]).join(parts))
    for _ in range(n // 4):  # near copies: one character or one word changed
        t = out[rng.randrange(n)]
        if t:
            k = rng.randrange(len(t))
            out.append(t[:k] + rng.choice(["X", "", " neu "]) + t[k + 1:])
    return out + out[:3]


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 300), (3, 1000)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    texts = corpus(seed, 60)
    want = brute(texts)
    assert sum(len(s) for s, _ in want) > 20
    assert stripped(spark, texts) == want


def test_edges(spark):
    rng = random.Random(5)
    a200 = "".join(rng.choices("abcdef ", k=200))
    texts = [None, None, "", "short", "short", "a" * 199, "a" * 199, "b" * 200, "b" * 201, "c" * 5000, "\n" * 399 + "d",
             a200, a200, "x" + a200 + "y", a200[:-1] + "Q", "日本" * 200, "本" + "日本" * 100, (a200 + "Z") * 3, "ab" * 150]
    assert stripped(spark, texts) == brute(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert repeats.strip_repeats(df.limit(0)).collect() == []
    assert stripped(spark, texts, window=40) == brute(texts, 40)
    assert stripped(spark, texts, window=64, gram=16) == brute(texts, 64)
    with pytest.raises(ValueError):
        repeats.strip_repeats(df, window=35)


def test_repeated_and_missing_doc_ids(spark):
    rng = random.Random(6)
    a, b = ("".join(rng.choices("abcdef ", k=300)) for _ in range(2))
    rows = [(1, a), (1, a), (2, b), (2, a + "!"), (None, b), (None, None), (3, "tail " + a[40:])]
    got = repeats.strip_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), columns={"n": F.length("kept")}).collect()
    assert sorted((r.doc_id or 0, r.n) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (2, 1), (3, 5)]


def test_long_text_and_many_copies(spark):
    rng = np.random.default_rng(7)
    long = bytes(rng.integers(97, 123, 2_500_000, dtype=np.uint8)).decode()
    texts = [long, "#" + long[1_000_000:1_000_300] + "#", long[5:250]] + [long[2_000_000:2_000_400] + str(i) for i in range(300)]
    got = stripped(spark, texts)
    assert got[0][0] == [(5, 250), (1_000_000, 1_000_300), (2_000_000, 2_000_400)]
    assert got[1] == ([(1, 301)], b"##") and got[2][1] == b""
    assert got[3:] == brute(texts[3:])


def test_query_columns(spark):
    from terminus.llm.queries import op13_suffix_repeats
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in rows])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op13_suffix_repeats(spark, sf).collect()}
    for r, (spans, kept) in zip(rows, want, strict=True):
        n = len((r.text or "").encode())
        assert got[r.doc_id] == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
