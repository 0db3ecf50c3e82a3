"""Readers, writers and streaming on small files."""

import gzip
import json

from lattiq.sources import readers, sinks
from lattiq.streaming.ingest import on_new_files, replay


def _line(i, **more):
    return json.dumps({"id": f"u{i}", "dataset": "d", "reference": "a b", "n_unique": 1, "candidates": [{"text": "a b", "avg_conf": 0.5}], **more})


def test_dumps(spark, tmp_path):
    p = tmp_path / "m1__set1__s03__main"
    p.mkdir()
    with gzip.open(p / "flat.jsonl.gz", "wt") as f:
        f.write(_line(1) + "\n\n" + "{broken\n" + _line(2) + "\n")
    rows = readers.dumps(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["u1", "u2"] and rows[0]["candidates"][0]["word_conf"] is None
    assert (rows[0]["path_model"], rows[0]["path_set_name"], rows[0]["path_shard"], rows[0]["path_kind"], rows[0]["path_arm"]) == ("m1", "set1", 3, "main", "flat")


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.trans.txt").write_text("id1 HELLO WORLD\nid2 ONE\n")
    (tmp_path / "i.csv").write_text("1, f1 ,a, b, c\nbad,line\n2,f2, \n")
    (tmp_path / "t.tsv").write_text("1\tf\traw\ttext\tx\t16000\n2\tf\traw\ttext\tx\tnope\nshort\n")
    (tmp_path / "m.json").write_text('{"audio": "/x/y/q.flac", "text": "t"}\n')
    only = spark.createDataFrame([("id1",)], "id string")
    assert [tuple(r) for r in readers.transcripts(spark, str(tmp_path), only).collect()] == [("id1", "HELLO WORLD")]
    assert [tuple(r) for r in readers.comma_index(spark, str(tmp_path / "i.csv")).collect()] == [("1", "f1", "a, b, c")]
    assert [r["duration_s"] for r in readers.tab_index(spark, str(tmp_path / "t.tsv")).collect()] == [1.0]
    assert readers.utterances(spark, "manifest", str(tmp_path / "m.json")).first()["id"] == "q"


def test_facts_keep_the_last_file(spark, tmp_path):
    for name, e in (("a", 1), ("b", 2)):
        spark.createDataFrame([("x", None, e)], "id string, precision string, e int").coalesce(1).write.parquet(str(tmp_path / name))
    r = readers.fact_tables(spark, str(tmp_path), ["id"]).collect()
    assert [(x["id"], x["precision"], x["e"]) for x in r] == [("x", "", 2)]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.12345), (2, float("nan"))], "id int, x double")
    for _ in range(2):
        sinks.append_new(rows.fillna(0.0), str(tmp_path / "j"), ["id"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.summary({"t": rows}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text())["t"][1]["x"] is None
    assert "| 1 | 0.12 |" in sinks.markdown("T", rows)
    new = sinks.upsert(rows, spark.createDataFrame([(2, 5.0)], "id int, x double"), ["id"])
    assert sorted(tuple(r) for r in new.collect()) == [(1, 0.12345), (2, 5.0)]
    assert readers.spread(list("abcdef"), 2) == ["b", "e"]


def test_streams(spark, tmp_path):
    rows = spark.range(30).selectExpr("id as event_id", "id % 3 as kind")
    assert replay(rows, "event_id").count() == 30
    (tmp_path / "done").mkdir()
    seen = []
    for i in range(2):
        (tmp_path / "done" / f"j{i}.json").write_text(json.dumps({"job": f"j{i}"}))
        on_new_files(spark, str(tmp_path / "done"), spark.createDataFrame([], "job string").schema, lambda df, n: seen.extend(r["job"] for r in df.collect()), str(tmp_path / "state"))
    assert seen == ["j0", "j1"]
