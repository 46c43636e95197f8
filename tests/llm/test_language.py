from medialib.llm import language


def test_held_out_languages(spark, small):
    docs = spark.read.parquet(f"{small}/../sf0.01/documents.parquet")
    got = language.classify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert (out.lang == out.lang_pred).mean() > 0.95
    assert (out[out.trusted].lang == out[out.trusted].lang_pred).mean() >= (out.lang == out.lang_pred).mean()
    assert got.score.between(0, 1).all()


def test_held_out_rows_teach_nothing(spark, small):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{small}/documents.parquet")
    other = docs.withColumn("lang", F.when(language.held_out("doc_id", 3, 1), F.lit("xx")).otherwise(F.col("lang")))
    assert language.train(docs) == language.train(other)


def test_edges(spark, frame):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (None, "hello there"), (4, "hello " * 30_000), (4, "dup"), (4, "dup")]
    empty = {}
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.classify(frame(rows), empty).collect()}
    assert {p for _, p, _ in got} == {"und"}
    one = language.train(frame([(0, "some words of english"), (3, None), (None, "x")]))
    assert set(one) <= {"en"}
    known = {"en": b"hello there dup", "de": b"guten tag auch hier"}
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in language.classify(frame(rows), known).collect()))
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (4, "en")]
    assert language.classify(frame([]), known).collect() == []


def test_many_languages_and_one_id_of_many_rows(spark):
    rows = [(i, f"l{i % 450:03d}", f"words {i} of a text") for i in range(2250)] + [(i, "l001", f"more {i}") for i in range(40)]
    rows += [(9, "l002", f"row {i} of the same id") for i in range(3000)]
    got = language.train(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), pieces=4)
    assert len(got) == language.LANGUAGES and {"l001", "l002"} <= set(got)
    assert all(len(d.split(b"\n")) <= 4 for d in got.values())
