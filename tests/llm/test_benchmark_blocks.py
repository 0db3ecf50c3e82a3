"""A benchmark of many blocks of windows gives the rows of a benchmark of one."""

import pytest

from lattiq.llm import decontaminate


@pytest.fixture(scope="module")
def tables(spark):
    words = [f"q{i}" for i in range(60)]
    text = lambda a, b: " ".join(words[a:b])
    docs = [(None, text(0, 12)), (None, "nothing here"), (None, None), (7, text(20, 35)), (7, "other words"), (7, text(0, 12) + " x " + text(40, 55)), (8, "")]
    bench = [("a", text(0, 30)), ("b", text(25, 60)), ("c", text(0, 14)), ("d", text(41, 44))]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")


def test_blocks(tables, monkeypatch):
    whole = [tuple(map(str, r)) for r in decontaminate.occurrences(*tables).collect()]
    report = sorted(map(str, decontaminate.report(*tables).collect()))
    assert len(whole) == len(report) == 7
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 9)
    assert sorted(tuple(map(str, r)) for r in decontaminate.occurrences(*tables).collect()) == sorted(whole)
    assert sorted(map(str, decontaminate.report(*tables).collect())) == report
    assert sorted(r["n_hit"] for r in decontaminate.report(*tables).collect()) == [0, 0, 0, 0, 12, 15, 27]


def test_proximity(tables):
    docs, bench = tables
    texts = [(r["doc_id"], (r["text"] or "").split()) for r in docs.collect()]

    def near(words, item):
        item = item.split()
        for window in [item[i : i + 10] for i in range(max(1, len(item) - 9))]:
            places = sorted(([j for j, x in enumerate(words) if x == w] for w in set(window)), key=len)
            if all(places) and any(all(any(abs(p - a) <= decontaminate.SLOP for p in other) for other in places) for a in places[0]):
                return True
        return False

    want = sorted((str(i), [k for k, item in sorted((b["item_id"], b["text"]) for b in bench.collect()) if near(words, item)]) for i, words in texts)
    got = sorted((str(r["doc_id"]), r["near_items"]) for r in decontaminate.occurrences(docs, bench).collect())
    assert got == want and any(x for _, x in want)


def test_null_items_and_empty_tables(spark, tables):
    docs, bench = tables
    twice = bench.unionByName(spark.createDataFrame([(None, "other words"), ("z", "other words")], "item_id string, text string"))
    assert {tuple(r["items"]) for r in decontaminate.occurrences(docs, twice).collect() if r["n_words"] == 2 and r["doc_id"] == 7} == {("", "z")}
    assert [r["n_items"] for r in decontaminate.report(docs, bench.limit(0)).collect()] == [0] * 7
    assert decontaminate.report(docs.limit(0), bench).collect() == [] and decontaminate.clean(docs, bench.limit(0)).count() == 7
