"""The pipeline's stages on tables with nulls, repeats and clashing column names."""

from .test_dedup import brute_classes, brute_words


def test_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([(1, " ".join(rows[9][1].split()[:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sizes, kept = {}, docs
    for name, stage in cp.STAGES:
        before = kept.collect()
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        sizes[name] = out.count()
        plain = [(r["doc_id"], r["text"]) for r in before]
        ids = {r["doc_id"] for r in out.collect()}
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "language":
            assert not ids & {500, 501, 502}
            continue  # the made-up languages are alike: the next stage starts from all documents
        kept = out
        if name == "near_duplicates":
            assert ids == {i for i, c in brute_classes(plain, 80).items() if c == i}
            assert {i for i, t in plain if i not in ids and not (t or "").split()} == set()
        if name == "substrings":
            assert ids == {i for i, n, gone, _ in brute_words(plain) if gone < n or n == 0}
        if name == "benchmark":
            assert rows[9][0] not in ids
    assert 0 < sizes["tokens"] == sizes["benchmark"] < sizes["near_duplicates"]


def test_run(spark, docs, empty, tmp_path):
    import corpus_pipeline as cp

    for name, table in (("some", docs), ("none", empty)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        n = cp.run(spark, str(tmp_path / name)).count()
        assert (n == 0) == (name == "none")


def _operators(cluster):
    names, inner = [cluster.name()], cluster.childClusters().iterator()
    while inner.hasNext():
        names += _operators(inner.next())
    return names


def test_one_python_operator_a_task(spark, docs, rows, tmp_path):
    """Each one takes a worker of its own, and the executor keeps it: later steps would fill them all."""
    import corpus_pipeline as cp

    spark.createDataFrame([(1, " ".join(rows[9][1].split()[:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sc = spark.sparkContext
    seen, docs = 0, docs.drop("words")
    for name, stage in cp.STAGES:
        sc.setJobGroup(name, name)
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for job in sc.statusTracker().getJobIdsForGroup(name):
            for k in sc.statusTracker().getJobInfo(job).stageIds:
                graph = sc._jsc.sc().statusStore().operationGraphForStage(k)
                found = [x for x in _operators(graph.rootCluster()) if "Arrow" in x]
                assert len(found) < 2, (name, k, found)
                seen += len(found)
        if name != "language":  # the made-up languages are alike
            docs = spark.read.parquet(str(tmp_path / name))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert seen > 5
