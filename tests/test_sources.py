from pyspark.sql import functions as F

from medialib.operators import reconcile
from medialib.operators.reconcile import RunReport, reconcile_clips, snapshot_diff
from medialib.plans.binding import AS_OF, Binding
from medialib.plans.jobs import Library, feed_run, index_run, search_run, shelf_run
from medialib.session import scratch_run, settle
from medialib.sources import bundle, catalog, evolve, schemas
from tests.rows import clips, photos


def test_bundle_restores_ids_only_into_an_empty_library(spark, tmp_path):
    persons = spark.createDataFrame([("a", 3, "Ann", "", True, False, None), ("b", 3, "Bo", "", True, False, None)], schemas.PERSONS)
    empty = spark.createDataFrame([], schemas.PERSONS)
    events = spark.createDataFrame([], schemas.WATCH_EVENTS)
    c = clips(spark, [dict(id=1, is_favorite=True), dict(id=2)])
    hidden = spark.createDataFrame([("a", 2)], schemas.DISMISSALS)
    names = spark.createDataFrame([("a", "gems", "Gold", 5)], schemas.GROUP_NAMES)
    denied = spark.createDataFrame([("a", 1, 3), ("b", 1, 3)], schemas.DENIALS)
    bundle.export_bundle(str(tmp_path), persons, events, c, hidden, names, denied)
    got = bundle.read_bundle(spark, str(tmp_path))
    assert {r["section"]: r["rows"] for r in bundle.import_report(got).collect()} == {
        "persons": 2, "watch_events": 0, "favorites": 1, "dismissals": 1, "group_names": 1, "denials": 2}
    local = spark.createDataFrame([("b", 1, "", "bo", False, False, None), ("b", 2, "Cy", "", True, False, None)], schemas.PERSONS)
    merged = {(r["library_id"], r["id"]): (r["name"], r["verified"]) for r in bundle.import_persons(local, got["persons"]).collect()}
    assert merged == {("a", 3): ("Ann", True), ("b", 1): ("Bo", True), ("b", 2): ("Cy", True)}
    kept = bundle.import_denials(local, spark.createDataFrame([], schemas.DENIALS), got["denials"]).collect()
    assert [(r["library_id"], r["person_id"]) for r in kept] == [("a", 3)]
    mine = spark.createDataFrame([("a", "gems", "Mine", 9)], schemas.GROUP_NAMES)
    assert [r["name"] for r in bundle.import_group_names(mine, got["group_names"]).collect()] == ["Mine"]
    assert bundle.import_persons(empty, got["persons"]).count() == 2


def test_old_files_read_with_defaults(spark, tmp_path):
    old = clips(spark, [dict(id=1, category="pet")]).drop("album_id", "manual_group", "speech_ratio")
    old.write.parquet(str(tmp_path / "v1"))
    clips(spark, [dict(id=2, album_id=4)]).write.parquet(str(tmp_path / "v2"))
    got = evolve.read_versions(spark, str(tmp_path / "v1"), str(tmp_path / "v2"), defaults=schemas.CLIP_DEFAULTS)
    assert {r["id"]: (r["album_id"], r["manual_group"], r["speech_ratio"], r["category"]) for r in got.collect()} == {
        1: (-1, "", 0.0, "pet"), 2: (4, "", 0.0, "unknown")}


def test_events_are_laid_out_by_day(spark, small, tmp_path):
    events = Binding(spark, small).watch_events()
    catalog.append_events(events, str(tmp_path / "e"))
    back = catalog.read_events(spark, str(tmp_path / "e"))
    assert back.count() == events.count() and back.exceptAll(events.select(*back.columns)).count() == 0


def test_the_four_jobs_run_end_to_end(spark, small):
    b = Binding(spark, small)
    names = b.albums().selectExpr("library_id", "'gems' AS group_id", "name", "created_at AS updated_at").where("updated_at = 1")
    lib = Library(b.clips_hashed(), b.photos(), b.watch_events(), b.vectors(), b.persons(), b.denials(), b.dismissals(), b.albums(), names)
    after = index_run(lib, b.listing_new(), b.photos())
    assert after.clips.count() > 0 and set(lib.clips.columns) <= set(after.clips.columns)
    reels = feed_run(after, AS_OF, 9, seed=1)
    assert reels.groupBy("viewer_id", "library_id").count().where("count > 60").isEmpty() and not reels.isEmpty()
    assert shelf_run(after, AS_OF).where("kind = 'ALL'").count() == after.clips.select("library_id").distinct().count()
    assert not search_run(after, b.search_queries()).isEmpty()


def test_new_rows_start_complete(spark):
    known_clips, known_photos = clips(spark, [dict(id=1)]), photos(spark, [dict(id=1)])
    seen = known_clips.select("library_id", "id", "display_name", "folder_name", "duration_ms", "size_bytes", "date_added_sec",
                              "width", "height")
    seen = seen.unionByName(seen.withColumn("id", F.lit(2).cast("bigint")))
    new = reconcile.reconcile_clips(known_clips, seen).where("id = 2").first().asDict()
    assert {c for c, v in new.items() if v is None} == {"transcript"}
    more = known_photos.select("library_id", "id", "display_name", "folder_name", "date_added_sec", "width", "height", "animated")
    more = more.withColumn("id", F.lit(2).cast("bigint")).withColumn("junk_score", F.lit(0.95))
    after = reconcile.settle_junk(reconcile.reconcile_photos(known_photos, more.unionByName(more.withColumn("id", F.lit(1).cast("bigint")))))
    new = after.where("id = 2").first().asDict()
    assert new["brain_level"] == 1 and not {c for c, v in new.items() if v is None} and after.dtypes == known_photos.dtypes


def test_scratch_is_empty_after_a_run(spark):
    with scratch_run(spark):
        df = settle(spark.range(1000), "probe")
        path = df.inputFiles()[0].rsplit("/", 1)[0]
        assert df.count() == 1000
    assert spark.read.parquet(path).count() == 0


def _events(spark, n=40):
    return spark.sql(f"""SELECT id AS row_id, id % 3 AS viewer_id, 'a' AS library_id, id % 7 AS video_id,
        timestamp_seconds(1704067200 + id * 7000) AS at, 0.5D AS completion, false AS skipped, 9 AS hour_of_day FROM range({n})""")


def test_reading_after_a_cursor_opens_the_days_it_needs(spark, tmp_path):
    catalog.append_events(_events(spark), str(tmp_path / "ev"))
    stored = catalog.read_events(spark, str(tmp_path / "ev"), days=True)
    fresh = catalog.events_after(stored, 30, "2024-01-03")
    assert sorted(r.row_id for r in fresh.collect()) == list(range(31, 40))
    assert len(fresh.inputFiles()) == len(stored.inputFiles())  # pruning is the scan's work
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(row_id), GreaterThan(row_id,30)]" in plan
    assert sorted(r.row_id for r in catalog.events_after(_events(spark), 30).collect()) == list(range(31, 40))


def test_imported_events_are_numbered_by_time_and_alike_on_every_run(spark):
    local = _events(spark, 5)
    rows = [(v, "a", i, 1_704_067_200_000 + t, 0.5, False, 9) for i, (v, t) in enumerate([(1, 50), (1, 10), (2, 10), (1, 90_000_000), (1, 10)])]
    ddl = "viewer_id bigint, library_id string, video_id bigint, at_ms bigint, completion double, skipped boolean, hour_of_day int"
    got = [{(r.viewer_id, r.video_id): r.row_id for r in bundle.import_events(local, spark.createDataFrame(rows, ddl).repartition(n)).where("row_id > 4").collect()}
           for n in (1, 3)]
    assert got[0] == got[1] == {(1, 1): 5, (1, 4): 6, (1, 0): 7, (1, 3): 8, (2, 2): 5}


def test_a_run_report_counts_what_was_written(spark):
    report = RunReport("r")
    assert report.settle(spark.range(7), "first").count() == 7
    report.settle(spark.range(0), "second")
    rows = report.table(spark).orderBy("step").collect()
    assert [(r.run, r.stage, r.rows) for r in rows] == [("r", "first", 7), ("r", "second", 0)] and rows[0].seconds > 0


def test_a_moved_file_is_a_changed_one(spark):
    known = clips(spark, [dict(id=1), dict(id=2)]).withColumn("uri", F.lit("content://old"))
    seen = known.withColumn("uri", F.when(F.col("id") == 2, "content://new").otherwise(F.col("uri")))
    assert {r.id: r.status for r in snapshot_diff(known, seen).collect()} == {1: "unchanged", 2: "changed"}
    after = reconcile_clips(known, seen.select("library_id", "id", "display_name", "folder_name", "duration_ms", "size_bytes",
                                               "date_added_sec", "width", "height", "uri"))
    assert {r.id: r.uri for r in after.collect()} == {1: "content://old", 2: "content://new"}
