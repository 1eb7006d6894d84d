import random

import pytest
from tokenizers import Tokenizer

from terminus.llm.token_counts import _pruned, count_tokens
from terminus.llm.tokens import Lookup, Pretokens, tokenizer_file

ALPHABET = ["a", "B", "é", "Σ", "ß", "İ", "H̱", "é", "9", "४", "'s", "'LL", " ", "  ", "\n", "\t", "\x1c",
            " ", "　", "!", "…", "🙂", "中", "Ƛ", "\U0001e6c0", "<|endoftext|>", "<|startoftext|>", "‍", "ﬁ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    pre, tok, rng = Pretokens(name), Tokenizer.from_file(tokenizer_file(name)), random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        got = [i for p, s in pre.parts(text) for i in ([s] if s is not None else
                                                       [x for w in pre.split(p) for x in pre.encode(w)])]
        assert got == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_counts_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in count_tokens(docs, frequent=50).collect()}
    for d in docs.collect():
        n = len(tok.encode(d.text, add_special_tokens=False).ids)
        r = rows[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d.text.encode()), n, n > 512)


def test_edges(spark):
    rows = [(1, None, 0), (1, "", 0), (None, "a b", 0), (2, "x" * 100_000, 0), (2, "hi<|endoftext|>there\n\n", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(df).collect()), key=str)
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert count_tokens(df.limit(0)).count() == 0


def test_bounded_tables():
    seen = Lookup(len, {"ab": 2}, bound=3)
    assert [seen[x] for x in ["ab", "c", "dd", "eee", "ffff", "x" * 100]] == [2, 1, 2, 3, 4, 100]
    assert len(seen) <= 4 and seen["ab"] == 2 and seen["c"] == 1
    from collections import Counter
    assert _pruned(Counter("aaaabbbccd"), 2) == Counter(a=2, b=1)
