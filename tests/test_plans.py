"""Plan guards: no all-against-all joins, no window over a whole table; and answers equal plain SQL."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from medialib.plans.binding import TABLES

NO_PAIRING = ["snapshot_diff", "label_fusion", "queue_transcript", "dup_pairs", "content_match", "suppression", "shelf_sizes",
              "event_bursts", "feed_candidates", "taste_affinity", "prefix_candidates", "substring_candidates", "search_ranked",
              "similar_clips", "similar_photos", "match_gate", "suggest_names", "hamming_pairs"]
CHECKED = ["catalog_photos", "sweep_guard", "library_stats", "label_fusion", "queue_voice", "dup_keepers", "keeper_reason", "shelf_people",
           "event_bursts", "feed_candidates", "taste_decayed", "search_sections", "prefix_candidates", "match_gate_denied",
           "consolidate_persons", "similar_photos", "similar_clips", "acoustic_profile", "schema_evolution", "bundle_export"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PAIRING)
def test_no_nested_loops_and_no_unpartitioned_windows(spark, small, name):
    text = plan(entry.queries()[name](spark, small))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "Exchange SinglePartition" not in "\n".join(
        x for x in text.splitlines() if "ENSURE_REQUIREMENTS" in x and "Window" in x)
    assert not re.search(r"Window \[[^\]]*\], \[\]", text)


def test_clip_scan_reads_only_what_it_needs(spark, small):
    text = plan(entry.queries()["junk_scores"](spark, small))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert read and all("text" not in r for r in read)


def test_no_forced_repartition(spark, small):
    for name in ("classify_names", "junk_scores", "clip_documents"):
        assert "RoundRobinPartitioning" not in plan(entry.queries()[name](spark, small))


def test_top_lists_are_cut_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plan(entry.queries()["feed_candidates"](spark, small))


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_equal_to_sql(spark, small, db, name):
    got = entry.queries()[name](spark, small).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        df = df[sorted(df.columns)]
        clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
        return sorted((tuple(clean(v) for v in r) for r in df.itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_every_query_has_a_statement_or_a_brute_force_test():
    from medialib.plans.all_queries import QUERIES
    without = set(QUERIES) - set(entry.oracle_sql())
    assert without == {"reel", "session_walk", "split_scan", "cosine_pairs_buckets"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["viewer_id", "library_id", "id", "rank", "score"] and not df.isEmpty()
