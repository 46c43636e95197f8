import corpus_pipeline as pipeline

from medialib.llm.near_dup import near_duplicates


def test_stages_on_a_small_corpus(spark, small):
    sf = f"{small}/../sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [docs.count()]
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        rows.append(docs.count())
        if name != "sequences":
            assert docs.columns == pipeline.COLUMNS and docs.dtypes == before.select(pipeline.COLUMNS).dtypes
        if name == "quality":
            good = labels.where("quality = 1").join(docs, "doc_id", "left_semi").count() / labels.where("quality = 1").count()
            assert good > 0.97
        if name == "near_duplicates":
            again = near_duplicates(docs, shingle=pipeline.SHINGLE, percent=pipeline.PERCENT)
            assert again.where("n_shingles > 0 and not kept").isEmpty()
    assert rows[0] > rows[1] >= rows[2] >= rows[3] > rows[4] > 0
    last = docs.toPandas()
    assert last.groupby("sequence_id").length.sum().max() <= 4096
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "benchmark", "sequences"]


def test_rows_of_one_id_with_unlike_texts(spark, frame, prose, tmp_path):
    clean, twin, other, item = prose(60, 1), prose(60, 2), prose(60, 3), prose(20, 4)
    rows = [(1, twin), (2, clean), (2, twin), (2, clean), (3, other), (3, f"{other} {item}"), (None, clean)]
    docs = frame(rows).select(pipeline.COLUMNS)
    got = pipeline.near_duplicates(spark, docs.where("text not like '%" + item + "'"), "")
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, twin), (2, clean), (3, other), (0, clean)])
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.benchmark(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted((d or 0, t) for d, t in rows if item not in t)


def test_near_texts_of_one_id_leave_one_row(spark, frame, prose):
    words = prose(200, 5).split()
    near = " ".join([*words[:199], "other"])
    rows = [(5, " ".join(words)), (5, near), (5, prose(80, 6)), (8, near), (9, None), (9, "")]
    got = pipeline.near_duplicates(spark, frame(rows).select(pipeline.COLUMNS), "").collect()
    assert sorted(r.doc_id for r in got) == [5, 5, 9, 9]
    assert prose(80, 6) in {r.text for r in got}
