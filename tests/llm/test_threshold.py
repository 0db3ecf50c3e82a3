"""The near-duplicate threshold: 80 % in the pipeline, 85 % in op9."""

import pytest

from lattiq.llm import near_dedup


def word(i):
    return "w" + "".join(chr(97 + int(d)) for d in str(i))


def pairs(rest):
    """Two texts for each of 30 seeds: 140 words, and the same with the last ``rest`` replaced."""
    out = []
    for k in range(30):
        text = [word(1000 * k + i) for i in range(140)]
        out += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[: 140 - rest] + [word(1000 * k + 500 + i) for i in range(rest)]))]
    return out


@pytest.mark.parametrize("rest, percent, linked", [(14, 80, True), (14, 85, False), (20, 80, False)])
def test_percent(spark, rest, percent, linked):
    # 136 shingles each, of which 136 - rest are shared: 81.3 % at 14, 74.4 % at 20
    docs = spark.createDataFrame(pairs(rest), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(docs, percent).collect()}
    assert got == {i: i - i % 2 if linked else i for i in range(60)}


def test_pipeline_stage(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame(pairs(14), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()) == list(range(0, 60, 2))


def test_derived_limits():
    assert [near_dedup.probes_of(p) for p in (85, 80)] == [10, 12]
    assert [round(near_dedup.least_estimate(p), 2) for p in (85, 80)] == [0.69, 0.62]
