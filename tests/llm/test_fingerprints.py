import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terminus.llm import fingerprints as fp


def plain(rows):
    """rows (doc_id, text) in descending order -> doc_id -> (n, sha, next text)"""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, nxt = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        lcp = next((i for i, (x, y) in enumerate(zip(text, nxt, strict=False)) if x != y), min(len(text), len(nxt)))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), lcp))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [1 << 25, 20_000, 1])
def test_whole_documents(spark, part_bytes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3)
    got = fp.compare_neighbours(docs, part_bytes).collect()
    rows = sorted((tuple(r) for r in docs.collect()), reverse=True)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.shared_prefix_next) for r in got), key=str) == plain(rows)
    marks = {}
    text = dict(rows)
    for r in got:
        assert marks.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert len(set(marks.values())) == len(marks)
    long = [r for r in got if r.n_chars > 1000]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def test_edges(spark):
    rows = [(5, "abc"), (5, "abc"), (4, None), (3, ""), (2, "🙂é" * 30_000), (1, "x"), (None, "tail")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, near_next double")
    got = fp.compare_neighbours(df, 50).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.shared_prefix_next) for r in got), key=str) == plain(rows)
    by = {r.doc_id: r for r in got}
    assert by[4].near_next == 1 and by[3].near_next == 0 and by[1].near_edited == 1
    assert fp.compare_neighbours(df.limit(0)).count() == 0
    one = fp.compare_neighbours(df.filter("doc_id = 2")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(rows[4][1].encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.data())
def test_spans_and_extensions(x, y, data):
    a, b = fp.Prefixes(x), fp.Prefixes(y)
    i, j = data.draw(st.integers(0, len(x))), data.draw(st.integers(0, len(y)))
    n = 0
    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
        n += 1
    assert fp.longest_common_extension(a, i, b, j) == n
    for length in range(min(len(x) - i, len(y) - j) + 1):
        assert fp.spans_equal(a, i, b, j, length) == (x[i:i + length] == y[j:j + length])


def test_likeness_follows_shared_spans():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(8000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(8000))
    mark = fp.fingerprint
    assert fp.likeness(mark(text), mark(other)) < 0.05
    assert abs(fp.likeness(mark(text), mark(text[:4000] + other[:4000])) - 1 / 3) < 0.2
    assert fp.likeness(mark(text), mark("x" + text)) > 0.9
    assert len(fp.fingerprint("a" * 100_000)) < 60


@settings(max_examples=150, deadline=None)
@given(st.text("abc🙂", max_size=120), st.text("abc🙂", max_size=120))
def test_edited_fingerprint_is_composed_from_the_parts(x, y):
    half = len(x) // 2
    text, mark = fp.Document(x).edited(fp.Document(y))
    assert text == x[:len(x) - half] + y[:half]
    assert mark == fp.fingerprint(text)
