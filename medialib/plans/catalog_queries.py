"""Catalogue, reconciliation and maintenance queries over the test tables."""

import uuid

from pyspark.sql import functions as F

from medialib.operators import queues, reconcile
from medialib.plans.binding import Binding
from medialib.plans.jobs import Library, index_run
from medialib.plans.registry import as_long, query, r6
from medialib.session import scratch_dir
from medialib.sources import bundle, catalog, evolve, schemas


def raw_listing(b: Binding):
    """The second snapshot as a scanner would list it: paths, and gaps to be defaulted."""
    gap = lambda n, c: F.when(F.col("id") % n != 0, F.col(c)).alias(c)
    return b.listing_new().select(
        "library_id", "id", gap(17, "display_name"),
        F.when(F.col("id") % 19 == 0, F.lit(None)).when(F.col("id") % 23 == 0, "/")
        .otherwise(F.concat(F.lit("DCIM/"), F.col("folder_name"), F.lit("/"))).alias("relative_path"),
        gap(31, "duration_ms"), "size_bytes", "date_added_sec", gap(29, "width"), "height")


def raw_photo_listing(b: Binding):
    p = b.raw("part")
    k = F.col("p_partkey")
    lib = F.when(k % 4 == 0, "de").when(k % 4 == 1, "en").when(k % 4 == 2, "es").otherwise("fr")
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), k.cast("string"),
                    F.when(k % 7 == 0, ".GIF").otherwise(".jpg"))
    return p.select(
        lib.alias("library_id"), k.alias("id"), F.when(k % 17 != 0, name).alias("display_name"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 3 == 0, "Pictures/Beach trip/")
        .otherwise(F.concat(F.lit("Pictures/"), F.col("p_brand"))).alias("relative_path"),
        (F.lit(1704067200) - (k * 7919 % 700) * 86400).alias("date_added_sec"),
        F.when(F.col("p_size") % 3 == 0, 1080).otherwise(4000).alias("width"),
        F.when(F.col("p_size") % 3 == 0, 2400).otherwise(3000).alias("height"),
        F.when(k % 5 == 0, "image/webp").otherwise("image/jpeg").alias("mime"))


@query
def catalog_clips(b):
    return catalog.clip_rows(raw_listing(b)).select(
        "library_id", "id", "display_name", "folder_name",
        *as_long("duration_ms", "size_bytes", "date_added_sec", "width", "height"))


@query
def catalog_photos(b):
    return catalog.photo_rows(raw_photo_listing(b)).select(
        "library_id", "id", "display_name", "folder_name", "date_added_sec", "animated", "category",
        "tags", "about", r6("confidence").alias("confidence"), r6("junk_score").alias("junk_score"))


@query
def delta_read(b):
    listing = b.listing_new()
    changes = listing.where("id % 13 = 0").select("library_id", "id")
    return catalog.delta_rows(listing, changes.unionByName(changes)).select(
        "library_id", "id", "display_name", "size_bytes")


@query
def recent_events(b):
    return catalog.recent_events(b.watch_events()).select(
        "viewer_id", "row_id", "video_id", *as_long("rank"))


@query
def events_after(b):
    """Events stored by day, read from a cursor on."""
    path = f"{scratch_dir(b.spark)}/events-{uuid.uuid4().hex}"
    catalog.append_events(b.watch_events(), path)
    stored = catalog.read_events(b.spark, path, days=True)
    return catalog.events_after(stored, 4_000, "2024-01-21").select("row_id", "viewer_id", "library_id", "video_id")


def _bundled(b):
    return b.watch_events().where("library_id = 'de' AND row_id % 2 = 1").select(
        "viewer_id", "library_id", "video_id", F.unix_millis("at").alias("at_ms"), "completion", "skipped", "hour_of_day")


@query
def bundle_import_events(b):
    """Half of one library's events come in again with a bundle and are numbered after all there are."""
    return bundle.import_events(b.watch_events(), _bundled(b)).select(
        "viewer_id", "row_id", "library_id", "video_id", F.unix_millis("at").alias("at_ms"))


@query
def bundle_import_favorites(b):
    """Favourites named twice, and some of no clip; a second import changes nothing."""
    named = b.clips().where("id % 17 = 0").select("library_id", "id")
    more = named.unionByName(named).unionByName(named.select("library_id", (-F.col("id") - 1).alias("id")))
    once = bundle.import_favorites(b.clips(), more)
    return bundle.import_favorites(once, more).select("library_id", "id", "is_favorite")


@query
def bundle_import_dismissals(b):
    incoming = b.clips().where("id % 23 = 0").select("library_id", F.col("id").alias("video_id"))
    once = bundle.import_dismissals(b.dismissals(), incoming)
    return bundle.import_dismissals(once, incoming)


@query
def snapshot_diff_moved(b):
    """Files that moved: nothing but their address differs."""
    place = lambda df, moved: df.withColumn("uri", F.concat(F.lit("content://"), "library_id", F.lit("/"), moved))
    known = place(b.clips(), F.col("id").cast("string"))
    seen = place(b.clips(), F.when(F.col("id") % 5 == 0, F.col("id") + 7).otherwise(F.col("id")).cast("string"))
    return reconcile.snapshot_diff(known, seen)


@query
def run_report(b):
    """What the stages of an index run over the second snapshot wrote."""
    report = reconcile.RunReport("nightly")
    none = lambda ddl: b.spark.createDataFrame([], ddl)
    library = Library(b.clips_hashed(), b.photos(), b.watch_events(), b.vectors(), b.persons(), b.denials(), b.dismissals(),
                      b.albums(), none(schemas.GROUP_NAMES))
    index_run(library, b.listing_new(), b.photos().where("id % 10 <> 3"), report=report)
    return report.table(b.spark).where(F.col("stage").isin("clips", "photos", "vectors", "events")).select("run", "stage", "rows")


@query
def bundle_import_names(b):
    incoming = (b.persons().select("library_id", "id").withColumn("name", F.expr(
        "CASE id % 3 WHEN 0 THEN 'ANNA' WHEN 1 THEN 'omar' ELSE 'Nobody' END"))
        .withColumn("verified", F.lit(True)).where("library_id <> 'fr' OR id <> 1"))
    local = b.persons().where("library_id <> 'de'")
    return bundle.import_persons(local, incoming).select(
        "library_id", *as_long("id"), "name", "suggested_name", "verified")


@query
def snapshot_diff(b):
    return reconcile.snapshot_diff(b.clips(), b.listing_new())


@query
def sweep_guard(b):
    return reconcile.sweep_guard(reconcile.snapshot_diff(b.clips(), b.listing_new())).select(
        "library_id", *as_long("existing", "seen"), "sweep_ok")


@query
def reconciled_clips(b):
    return reconcile.reconcile_clips(b.clips(), b.listing_new()).select(
        "library_id", "id", "display_name", "folder_name", *as_long("duration_ms", "size_bytes", "date_added_sec", "width", "height"),
        "category", "tags", "about", r6("confidence").alias("confidence"), r6("junk_score").alias("junk_score"),
        *as_long("brain_level", "face_count", "smile_count", "person_id", "album_id"), r6("sharpness").alias("sharpness"),
        r6("speech_ratio").alias("speech_ratio"), "is_favorite", "manual_group", "prosody_tags", "transcript")


@query
def reconciled_photos(b):
    return _photos_after(b).select(
        "library_id", "id", "display_name", "folder_name", *as_long("date_added_sec", "width", "height"), "category", "tags",
        "about", r6("confidence").alias("confidence"), r6("junk_score").alias("junk_score"),
        *as_long("brain_level", "face_count", "smile_count", "phash"), "is_favorite", "animated")


def _photos_after(b):
    """The photo table after a snapshot that lacks a tenth of it; a twentieth was not known before."""
    seen = catalog.photo_rows(raw_photo_listing(b)).where("id % 10 <> 3")
    return reconcile.reconcile_photos(b.photos().where("id % 20 <> 7"), seen)


@query
def reconcile_then_queue(b):
    """What the photo pass reads next, straight after a snapshot: new rows are settled or queued like old ones."""
    return queues.queue_photo(reconcile.settle_junk(_photos_after(b))).select("library_id", "id", *as_long("rank"))


@query
def settle_junk(b):
    return reconcile.settle_junk(b.photos()).select(
        "library_id", "id", *as_long("brain_level", "face_count", "smile_count", "phash"))


@query
def quarantine(b):
    clips = b.clips().withColumn("readable", F.expr("id % 10 <> 4"))
    return reconcile.quarantine(clips).select(
        "library_id", "id", "tags", "about", r6("confidence").alias("confidence"),
        *as_long("brain_level", "face_count"), r6("junk_score").alias("junk_score"))


@query
def reset_derived(b):
    return reconcile.reset_derived(b.clips(), everything=True).select(
        "library_id", "id", "category", "tags", *as_long("face_count", "person_id"), "is_favorite", "manual_group")


@query
def retain_events(b):
    return reconcile.retain_events(b.watch_events(), 15).select("viewer_id", "row_id")


@query
def retain_events_many(b):
    """Few viewers with many events each, cut where they are trimmed in parts first."""
    few = b.watch_events().withColumn("viewer_id", F.col("viewer_id") % 3)
    return reconcile.retain_events(few, 700).select("viewer_id", "row_id")


@query
def cascade_delete(b):
    clips, vectors = b.clips(), b.vectors()
    ids = clips.where("id % 7 = 3").select("library_id", "id")
    kept_clips, kept_vectors = reconcile.cascade_delete(clips, vectors, ids)
    return (kept_clips.select(F.lit("clip").alias("kind"), "library_id", "id")
            .unionByName(kept_vectors.select(F.lit("vector").alias("kind"), "library_id", "id")))


@query
def library_stats(b):
    return reconcile.library_stats(b.clips(), b.persons(), b.vectors()).select(
        "library_id", *as_long("total", "memories", "clutter", "understood_pct", "pending",
                               "people", "flagged", "vectors", "unassigned"))


@query
def threshold_preview(b):
    return reconcile.threshold_preview(b.clips(), [(0.3, 2), (0.5, 10), (0.8, 20)]).select(
        "library_id", "junk_threshold", *as_long(
            "min_clips", "memories", "clutter", "people", "unplaced", "semantic_owed"))


@query
def bundle_export(b):
    """Rows per section of a bundle written out and read back."""
    path = f"{scratch_dir(b.spark)}/bundle-{uuid.uuid4().hex}"
    names = b.persons().select("library_id", F.concat(F.lit("person_"), F.col("id").cast("string")).alias("group_id"),
                               F.lit("Mine").alias("name"), F.lit(1).cast("bigint").alias("updated_at"))
    bundle.export_bundle(path, b.persons(), b.watch_events(), b.clips(), b.dismissals(), names, b.denials())
    return bundle.import_report(bundle.read_bundle(b.spark, path)).select("section", *as_long("rows"))


@query
def bundle_import_denials(b):
    """Denials of the bundle count only for 'de', which has no persons of its own yet."""
    local = b.persons().where("library_id <> 'de'")
    mine = b.denials().where("library_id <> 'de' AND person_id < 5")
    return bundle.import_denials(local, mine, b.denials()).select("library_id", "video_id", *as_long("person_id"))


@query
def schema_evolution(b):
    """Clips written before voice and album columns existed, read together with newer ones."""
    base = f"{scratch_dir(b.spark)}/versions-{uuid.uuid4().hex}"
    clips = b.clips()
    clips.where("id % 2 = 0").drop("prosody_tags", "speech_ratio", "album_id").write.parquet(f"{base}/v1")
    clips.where("id % 2 = 1").write.parquet(f"{base}/v2")
    both = evolve.read_versions(b.spark, f"{base}/v1", f"{base}/v2", defaults=schemas.CLIP_DEFAULTS)
    return both.select("library_id", "id", "prosody_tags", r6("speech_ratio").alias("speech_ratio"),
                       *as_long("album_id", "phash"), "category")
