import math
import re
from collections import Counter

from terminus.llm import licenses as lc


def brute(rows):
    """rows (doc_id, path, text) -> sorted results, all in one place."""
    n, df = len(rows), Counter(t for _, _, text in rows for t in set(lc.terms(text or "")))
    idf = lambda t: math.log((1 + n) / (1 + (df[t] if t in lc.VOCABULARY else 0))) + 1

    def cosine(a, b):
        x, y = ({t: k * idf(t) for t, k in Counter(lc.terms(s)).items()} for s in (a, b))
        dot = sum(v * y.get(t, 0) for t, v in x.items())
        size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return dot / size if size else 0.0

    own = []
    for _, path, text in rows:
        name = (path or "").rpartition("/")[2]
        whole = bool(re.search(lc.LICENCE_FILE, name))
        best = max([(round(cosine(p, t), 9), name) for p in lc.passages(text or "", whole) for name, t in lc.TEMPLATES], default=(0, ""))
        own.append((best[1] if best[0] >= lc.THRESHOLD else None, best[0], whole))
    of_dir = {}
    for (_, path, _), (name, score, whole) in zip(rows, own, strict=True):
        if whole and name:
            d = (path or "").rpartition("/")[0]
            of_dir[d] = min(of_dir.get(d, (1, "", "")), (-score, path, name))
    out = []
    for (doc_id, path, _), (name, score, _) in zip(rows, own, strict=True):
        d, got = (path or "").rpartition("/")[0], (name, None)
        while name is None:
            if d in of_dir:
                got = of_dir[d][2], d
                break
            if not d:
                break
            d = d.rpartition("/")[0]
        out.append((doc_id, path, name, round(score, 5), *got))
    return sorted(out, key=str)


def results(df):
    return sorted(((r.doc_id, r.path, r.own_license, round(r.own_score, 5), r.license, r.license_dir) for r in df.collect()), key=str)


def test_whole_documents_against_brute_force(spark):
    files = lc.document_files(spark, "/root/testdata/sf0.01")
    rows = [tuple(r) for r in files.collect()]
    got = lc.scan(files)
    assert results(got) == brute(rows)
    text = {r[0]: r[2] for r in rows}
    named = {"MIT": "MIT License", "Apache-2.0": "Apache License", "GPL-3.0": "GNU General", "CC-BY-NC-4.0": "CC BY-NC"}
    for r in got.collect():
        assert (r.own_license is not None) == ("icense" in text[r.doc_id])
        assert r.own_license is None or named[r.own_license] in text[r.doc_id]
        assert r.license_dir is None or r.path.startswith(r.license_dir)


def test_inheritance_and_edges(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.py", "no"), (3, "a/b/LICENSE", "words only"), (4, "a/b/copying", gpl),
            (5, "a/y.py", None), (6, "ab/z.py", ""), (7, "top.py", "x"), (None, None, "x"), (8, "a/b/own.py", f"x\n{mit}\ny"),
            (9, "a/d/long.py", "word " * 60_000), (2, "a/b/c/x.py", "no"), (10, "a/b/LICENSE.2", gpl), (11, "/abs/x", "n")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, path string, text string, license string")
    assert results(lc.scan(df)) == brute(rows)
    by = {r.doc_id: (r.license, r.license_dir) for r in lc.scan(df).collect()}
    assert by[2] == ("GPL-3.0", "a/b") and by[9] == ("MIT", "a") and by[8] == ("MIT", None) and by[7] == (None, None)
    root = df.union(spark.createDataFrame([(20, "LICENSE", mit, "q")], df.schema))
    assert {r.doc_id: r.license for r in lc.scan(root).collect()}[6] == "MIT"
    assert lc.scan(df.limit(0)).count() == 0


NOTICES = [(lc.TEMPLATES[k][0], around.format(lc.TEMPLATES[k][1].rstrip("."))) for k in (0, 2, 3, 5, 8, 12)
           for around in ("Jane Roe 2019: our project and its contents are {} since the year 2021, see below.",
                          "Copyright (c) 2024 Example Ltd and others. {}, as every other part of the example project is")]


def test_the_same_notices_at_several_corpus_sizes():
    plain = ["our project and its contents", "the year of the others is below", "every other part since then"]
    for n in (100, 10_000, 300_000):  # template words in a fixed share of the texts, names in none
        df = {t: n // 100 for _, text in lc.TEMPLATES for t in lc.terms(text)} | {t: n // 3 for x in plain for t in lc.terms(x)}
        match = lc.Matcher(n, df)
        for name, notice in NOTICES:
            assert match.best(f"first line\n{notice}\nlast line", False) == (name, 1.0)
        for other in ("All rights reserved, copyright 2020 by the publisher", "You need a licence to drive our project's van"):
            assert match.best(other, False)[0] is None
    near = "Licensed under our usual terms of the Apache License, of course Version 2.0"
    small, large = (lc.Matcher(n, {t: n // 100 for _, text in lc.TEMPLATES for t in lc.terms(text)}).best(near, False)
                    for n in (10_000, 300_000))
    assert small[0] == large[0] == "Apache-2.0" and abs(small[1] - large[1]) < 0.01


def test_all_words_are_counted(spark):
    """A word of no template weighs by its own frequency; n is counted over all partitions."""
    rows = [(i, f"a/{i}", "common words here" + (" and rare" if i == 7 else "")) for i in range(40)]
    rows += [(50, "b/LICENSE", "common MIT here"), (51, "c/LICENSE", "rare MIT words")]
    got = {r.doc_id: r.own_score for r in lc.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(5)).collect()}
    assert got[50] > 1.15 * got[51] > 0
    df = Counter()
    for batch in lc._document_frequency(iter([lc.pa.RecordBatch.from_arrays([lc.pa.array([f"w{i} x", None])], ["t"]) for i in range(9)])):
        for r in batch.to_pylist():
            df[r["term"]] += r["n"]
    assert df == {"": 18, "x": 9, **{f"w{i}": 1 for i in range(9)}}


def test_spdx_identifiers():
    match = lc.Matcher(10, {})
    for text, want in (("# SPDX-License-Identifier: MIT\ncode", "MIT"), ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
                       ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "(MIT OR Apache-2.0)"), ("spdx-license-identifier: bsd-2-Clause", "bsd-2-Clause"),
                       ("SPDX-License-Identifier: NOASSERTION", None)):
        assert match.best(text, False)[0] == want
