import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from terminus.llm.packing import combinations, pack, plan, repeat_counts
from terminus.llm.tokens import tokenizer_file


def check(rows, docs, window):
    """Exact round trip: pieces rebuild each document's ids; windows are gapless."""
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = Counter()
    for doc_id, text in docs:
        want[doc_id, (*tok.encode(text or "", add_special_tokens=False).ids, 1)] += 1
    pieces = Counter((r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows)
    ids_of = defaultdict(list)
    for (doc_id, ids), n in want.items():
        ids_of[doc_id] += [ids] * n
    total = defaultdict(int)
    for (doc_id, n, start, length, crc), k in pieces.items():
        fits = [ids for ids in ids_of[doc_id] if len(ids) == n
                and zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()) == crc]
        assert fits and length > 0
        total[doc_id] += k * length
    assert total == {d: sum(map(len, x)) for d, x in ids_of.items()}
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("window", [2048, 64])
def test_whole_documents(spark, window):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert check(pack(docs, window=window).collect(), [tuple(r) for r in docs.collect()], window) == 0


def test_edges(spark):
    docs = [(1, None), (1, ""), (2, "word " * 3000), (2, "word " * 3000), (None, "a<|endoftext|>b"), (3, "x" * 40_000),
            (4, " ".join(["w"] * 2047))] + [(10 + i, "same length text") for i in range(40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rest int")
    assert check(pack(df).collect(), docs, 2048) == 0
    assert check(pack(df, window=8).collect(), docs, 8) == 0
    assert pack(df.limit(0)).count() == 0


def test_plan_uses_each_length_as_often_as_it_occurs():
    rng = np.random.default_rng(0)
    hist = rng.integers(0, 40, 128)
    hist[0] = 0
    table, n_seq, stream = plan(hist)
    used = Counter()
    for r in table.itertuples():
        used[r.rest] += r.hi - r.lo
    assert used == {i: n for i, n in enumerate(hist.tolist()) if n}
    assert n_seq * 128 + stream == (hist * np.arange(128)).sum()
    assert n_seq * 128 > 0.7 * (hist * np.arange(128)).sum()  # most tokens are in exact combinations


def test_repeat_counts_solve_an_exact_histogram():
    hist = np.zeros(64, np.int64)
    hist[[40, 24]] = 10
    hist[[30, 20, 14]] = 5
    combos = combinations(hist)
    assert (repeat_counts(combos, hist) * 1).sum() == 15
