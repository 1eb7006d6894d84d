from collections import Counter

import corpus_pipeline as cp
from terminus.llm import language_id
from tests.llm.test_near_dedup import brute_groups
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in language_id.identify(docs).collect() if r.lang_pred != "und" and r.score >= 0.5}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == good and len(rows) == len(good)

    groups = brute_groups([r.doc_id for r in rows], [r.text for r in rows])
    once = cp.near_dedup_stage(spark, kept, SF)
    assert once.columns == docs.columns
    assert sorted(r.doc_id for r in once.collect()) == sorted({g for _, g in groups.values()})

    mixed = cp.mixing_stage(spark, once, SF)
    assert mixed.columns == docs.columns
    uses = Counter(r.doc_id for r in mixed.collect())
    assert set(uses) <= {r.doc_id for r in once.collect()} and max(uses.values()) <= 2

    pieces = cp.packing_stage(spark, mixed, SF).collect()
    assert check(pieces, [(r.doc_id, r.text) for r in mixed.collect()], 2048) == 0


def test_run_chains_the_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "mixing", "packing"]
    assert cp.run(spark, SF).count() > 0


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c", None, None, 5), (2, "a b c", None, None, 5),
            (3, "z " * 20_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for odd in (df, df.limit(0)):
        for _, stage in cp.STAGES:
            assert stage(spark, odd, SF).count() >= 0
