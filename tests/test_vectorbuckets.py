import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from medialib.operators import identity, simjoin
from medialib.operators.vectorbuckets import bucket_codes, bucketed, cosine_pairs_buckets, tables_for
from medialib.sources import schemas


def vectors(spark, groups, size=48, near=0.8, seed=3):
    """Groups ``(library, how many, copies each)`` of vectors with cosines of about ``near`` inside a set of copies."""
    rnd = np.random.default_rng(seed)
    rows = []
    for library, sets, copies in groups:
        for _ in range(sets):
            c = rnd.standard_normal(size)
            for _ in range(copies):
                v = np.sqrt(near) * c / np.linalg.norm(c) + np.sqrt(1 - near) * rnd.standard_normal(size) / np.sqrt(size)
                rows.append((library, len(rows), len(rows), -1, v.tolist(), 1.0))
    return spark.createDataFrame(rows, schemas.VECTORS).repartition(3)


def pairs(df):
    return {(r.library_id, r.a, r.b): r.sim for r in df.collect()}


@pytest.mark.parametrize("threshold", [0.55, 0.7])
def test_recall_and_truth_against_all_pairs(spark, threshold):
    v = vectors(spark, [("a", 400, 3), ("b", 60, 2), ("c", 1, 1)])
    exact = pairs(simjoin.cosine_pairs(v, threshold))
    for crowd in (32, 128):
        found = pairs(cosine_pairs_buckets(v, threshold, recall=0.95, crowd=crowd))
        assert all(abs(found[p] - exact[p]) < 1e-9 for p in found) and set(found) <= set(exact)
        assert len(found) >= 0.93 * len(exact) > 300


def test_tables_follow_the_threshold_and_wide_probes_need_fewer():
    assert tables_for(0.9, 8, 16, 0.95) < tables_for(0.6, 8, 16, 0.95) < tables_for(0.4, 8, 16, 0.95)
    assert tables_for(0.6, 8, 37, 0.95) <= tables_for(0.6, 8, 8, 0.95)
    assert tables_for(0.6, 0, 16, 0.95) == 1
    codes = bucket_codes(np.array([[0.1, -2.0, 3.0]]), 4)
    assert codes.tolist() == [[0b101, 0b100, 0b111, 0b110]]


def test_crowded_buckets_are_compared_in_tiles(spark):
    # One bucket holds everything: copies that no hyperplane parts.
    v = vectors(spark, [("a", 1, 150)], near=0.9999)
    found = cosine_pairs_buckets(v, 0.9, crowd=16, block=32)
    assert len(pairs(found)) == 150 * 149 // 2


def test_share_of_pairs_compared_falls_with_size(spark):
    share = {}
    for n in (1_000, 8_000):
        rows = bucketed(vectors(spark, [("a", n, 1)], size=16), 0.85, 0.9, 64, 16).drop("unit")
        counts = rows.groupBy("table", "bucket").agg(F.count("*").alias("asks"), F.count_if("home").alias("homes"))
        share[n] = counts.agg(F.sum(F.col("asks") * F.col("homes"))).first()[0] / n ** 2
    assert share[8_000] < 0.5 * share[1_000] < 0.5


def test_odd_vectors(spark):
    rows = [("a", 1, 1, -1, [], 1.0), ("a", 2, 2, -1, [0.0, 0.0], 1.0), ("a", 3, 3, -1, [1.0, 0.0], 1.0), ("a", 4, 4, -1, [2.0, 0.0], 1.0),
            ("a", 5, 5, -1, [1.0, 0.0, 0.0], 1.0), ("b", 6, 6, -1, [1.0, 0.0], 1.0)]
    assert set(pairs(cosine_pairs_buckets(spark.createDataFrame(rows, schemas.VECTORS), 0.9, crowd=1))) == {("a", 3, 4)}
    assert cosine_pairs_buckets(spark.createDataFrame([], schemas.VECTORS), 0.9).collect() == []


def test_clusters_by_buckets(spark):
    v = vectors(spark, [("a", 50, 4)], near=0.95)
    by = lambda df: sorted((r.id, r.cluster) for r in df.collect())
    assert by(identity.cosine_clusters(v, 0.7, recall=0.999)) == by(identity.cosine_clusters(v, 0.7))


def test_mirrored_blocks_meet_once(spark):
    v = vectors(spark, [("a", 40, 3)])
    assert pairs(simjoin.cosine_pairs(v, 0.6, block=16)).keys() == pairs(simjoin.cosine_pairs(v, 0.6)).keys()
    seen = [(r.a, r.b) for r in simjoin.cosine_pairs(v, 0.6, block=16).collect()]
    assert len(seen) == len(set(seen))


def test_rows_go_to_no_more_blocks_where_a_library_grows(spark):
    def blocks(n):
        v = spark.range(n).select(F.lit("a").alias("library_id"), "id")
        count = lambda pdf: pd.DataFrame({"side": pdf["_side"], "n": 1})
        return simjoin.blocked(v, v, ["library_id"], 16, count, "side int, n int", mirrored=True).count() / n
    assert blocks(1_600) <= 1.1 * blocks(160) <= 1.1 * 9.5


def test_slices_change_no_pair_and_no_best_person(spark, monkeypatch):
    v = vectors(spark, [("a", 40, 3), ("b", 9, 2)]).withColumn("person_id", (F.col("id") % 7).cast("int"))
    def found():
        best = {(r.library_id, r.id, r.person_id): round(r.sim, 9) for r in simjoin.best_two_persons(v, v).collect()}
        links = {(r.library_id, r.a, r.b): round(r.sim, 9) for r in simjoin.person_links(v, 0.6).collect()}
        return pairs(simjoin.cosine_pairs(v, 0.6)).keys(), best, links
    whole = found()
    parts = lambda q, s: ((q.iloc[i:i + 5], simjoin.similarities(q.iloc[i:i + 5], s)) for i in range(0, len(q), 5))
    monkeypatch.setattr(simjoin, "sliced", parts)
    assert found() == whole and len(whole[0]) > 100
