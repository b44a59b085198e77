import re

import corpus_pipeline
from quarrion.llm import langid, mixing
from quarrion.llm.common import stored

from .conftest import SF
from .test_near import brute_components


def test_stages_against_brute_force(spark, tables):
    docs = tables("documents")
    columns = docs.columns
    model = langid.fit(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    keep = {r.doc_id for r in langid.identify(docs, model).where("not rejected").collect()}
    assert len(keep) >= len(rows) - 2
    latest = {}
    for i in sorted(keep):
        latest[rows[i]] = i
    unique = sorted(latest.values())
    heads = {c for _, _, c in brute_components([(i, rows[i]) for i in unique], 5, 80, 100)}
    stage = dict(corpus_pipeline.STAGES)
    one = stored(stage["language_id"](spark, docs, SF), "one")
    two = stored(stage["exact_dedup"](spark, one, SF), "two")
    three = stored(stage["ngram_jaccard_join"](spark, two, SF), "three")
    four = stored(stage["mix_sources"](spark, three, SF), "four")
    five = stage["best_fit_packing"](spark, four, SF)
    assert one.columns == two.columns == three.columns == four.columns == columns
    assert {r.doc_id for r in one.collect()} == keep
    assert sorted(r.doc_id for r in two.collect()) == unique
    assert {r.doc_id for r in three.collect()} == heads
    sampled = {r.doc_id for r in mixing.calibrated(three).where("kept").collect()}
    assert {r.doc_id for r in four.collect()} == sampled and sampled
    assert {r.doc_id for r in five.collect()} == sampled
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(repr, five.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "mix_sources", "best_fit_packing"]
    assert all(re.fullmatch(r"\w+", n) for n, _ in corpus_pipeline.STAGES) and corpus_pipeline.ORACLE_SQL is None
