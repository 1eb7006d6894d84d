import zlib

import numpy as np
import pytest

from terminus.llm import language_id as li


@pytest.fixture(scope="module")
def pieces():
    return li.Pieces()


def all_segmentations(pieces, s):
    if not s:
        yield ()
    for k in range(1, len(s) + 1):
        piece = pieces.ids.get(s[:k], 0 if k == 1 else None)
        if piece is not None:
            for rest in all_segmentations(pieces, s[k:]):
                yield (piece, *rest)


@pytest.mark.parametrize("word", ["a", "the", "straße", "ñandú", "ꙮx", "entering"])
def test_forward_sums_all_segmentations(pieces, word):
    rng = np.random.default_rng(3)
    prob = rng.random((pieces.size + 1, 2))
    prob /= prob.sum(axis=0)
    prob[-1] = 0
    segs = list(all_segmentations(pieces, li.START + word))
    want = [np.log(sum(np.prod(prob[list(s), j]) for s in segs)) for j in range(2)]
    assert np.allclose(li.log_word_probs(pieces, prob, [word])[0], want)
    counts = np.zeros(len(prob))
    weights = np.array([np.prod(prob[list(s), 0]) for s in segs])
    for s, w in zip(segs, weights / weights.sum(), strict=True):
        np.add.at(counts, list(s), 3 * w)
    assert np.allclose(li.expected_counts(pieces, prob[:, :1], [word], np.array([3.0])), counts)
    assert np.allclose(li.expected_counts(pieces, prob[:, :1], [word], np.array([3.0]), long=0), counts)


def test_lattice_lists_exactly_the_pieces(pieces):
    words = ["straße", "ентеро", "ñandúx", "ing" * 2, "\U0001d400abcde"]
    got = pieces.lattice(words)
    for w, rows in zip(words, got, strict=True):
        s = li.START + w
        for end in range(1, len(s) + 1):
            for k in range(1, rows.shape[1] + 1):
                want = pieces.ids.get(s[end - k:end], 0 if k == 1 else -1) if k <= end else -1
                assert rows[end - 1, k - 1] == want


def test_long_words_do_not_underflow(pieces):
    prob = np.full((pieces.size + 1, 2), 1e-5)
    prob[-1] = 0
    short = li.log_word_probs(pieces, prob, ["x" * 20])
    long = li.log_word_probs(pieces, prob, ["x" * 3000])
    assert np.isfinite(long).all() and (long < short).all()


def test_long_runs_are_learned_from(pieces):
    """Scripts without spaces: a run of 400 letters counts like any word."""
    prob = np.full((pieces.size + 1, 1), 1 / pieces.size)
    prob[-1] = 0
    got = li.expected_counts(pieces, prob, ["ab" * 200], np.array([2.0]))
    names = {i: p for p, i in pieces.ids.items()} | {0: "?"}
    assert np.isfinite(got).all()
    assert abs(sum(got[i] * len(names[i]) for i in np.flatnonzero(got)) - 2 * 401) < 1e-6  # every letter and the start mark


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = li.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in true if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(1, None, "en", 0.0), (2, "", "en", 0.0), (3, "12 !?", None, 0.0), (None, "the house", "en", 0.0),
            (5, "das haus der", "de", 0.0), (6, "the house of", "en", 0.0), (6, "the house of", "en", 0.0),
            (7, "y" * 50_000, None, 0.0), (9, "der die das", "de", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = li.identify(df).collect()
    assert sorted((str(r.doc_id), r.lang_pred == "und") for r in got) == sorted(
        (str(r[0]), r[0] in (1, 2, 3)) for r in rows)
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert li.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in li.identify(df.withColumn("lang", df.lang.substr(9, 1)).replace("", None)).collect()} == {"und"}
