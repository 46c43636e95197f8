import zlib

import numpy as np
import pytest

from medialib.llm import quality_rank as q


@pytest.fixture(scope="module")
def small_docs(spark, small):
    return spark.read.parquet(f"{small}/../sf0.01/documents.parquet"), spark.read.parquet(f"{small}/../sf0.01/labels.parquet")


def test_held_out_labels_are_ranked(small_docs):
    docs, labels = small_docs
    got = q.score(docs, q.train(docs, labels)).join(labels, "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    out = got[got.held_out]
    ranks = out.score.rank()
    n1, n0 = (out.quality == 1).sum(), (out.quality == 0).sum()
    assert (ranks[out.quality == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.97
    assert (out.predicted == out.quality).mean() > 0.95
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_no_label_of_the_held_out_fold_counts(spark, small_docs):
    docs, labels = small_docs
    flipped = labels.withColumn("quality", labels.quality)
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = q.train(docs, labels), q.train(docs, flipped)
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_edges(spark, frame):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "x " * 50_000), (3, "y"), (3, "y")]
    model = q.train(frame(rows), labels)
    got = q.score(frame(rows), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and not next(r for r in got if r.doc_id is None).held_out
    assert q.score(frame([]), model).collect() == []
    odd = spark.createDataFrame([(3, 1), (3, None), (None, 0), (1, 0), (1, 1)], "doc_id bigint, quality int")
    assert len(q.score(frame(rows), q.train(frame(rows), odd)).collect()) == 6
    kept = q.score(frame(rows), model, carry=["doc_id", "score", "length"])
    assert kept.columns == ["doc_id", "score", "length", "predicted"]


def test_pairs_learn_a_linear_order():
    rng = np.random.RandomState(0)
    x = rng.randn(800, len(q.FEATURES))
    label = (x[:, 3] - 0.5 * x[:, 7] > 0).astype(int)
    model = q.fit(x, label)
    assert ((q.apply(model, x) >= q.ACCEPT) == label).mean() > 0.97
