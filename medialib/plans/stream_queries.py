"""Streams run over the test tables to their end; results are the tables they leave."""

import uuid

from pyspark.sql import functions as F

from medialib.operators import dups
from medialib.plans.binding import AS_OF
from medialib.plans.registry import as_long, query, r6
from medialib.session import scratch_dir
from medialib.sources import catalog, schemas
from medialib.streaming import jobs
from medialib.streaming.upserts import Upserts

DAY_S = 86_400
#: Days of the month before which each delivery of events ends, and how many days later it is learned.
DELIVERIES = ((11, 2), (21, 20), (32, 45))


def _folder(b, name):
    return f"{scratch_dir(b.spark)}/{name}-{uuid.uuid4().hex}"


def _event_files(b, events=None):
    path = _folder(b, "event-files")
    (b.watch_events() if events is None else events).repartition(3, "row_id").write.parquet(path)
    return path


def _run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def _taste(b, event_time, now=None):
    """Taste from three deliveries of events; each holds its events twice and all of the one before again.

    A delivery is as many files as tasks wrote, learned in one batch before the next one arrives.
    """
    events, path, since, before = b.watch_events(), _folder(b, "event-files"), 0, None
    table, cursor = jobs.taste_table(b.spark, _folder(b, "taste")), _folder(b, "cursor")
    for until, _ in DELIVERIES:
        part = events.where((F.dayofmonth("at") >= since) & (F.dayofmonth("at") < until))
        again = part if before is None else before.unionByName(part)
        part.unionByName(again).write.mode("append").parquet(path)
        since, before = until, part
        _run(jobs.learn_taste(jobs.event_stream(b.spark, path), b.clips(), table, cursor, now, event_time, late="60 days"))
    return jobs.learned_taste(table)


@query
def stream_taste(b):
    """Taste learned from three deliveries of event files, every event delivered at least twice."""
    now = F.lit(AS_OF * 1000)
    return _taste(b, True, now).select("viewer_id", "library_id", "key", "likes", "dislikes", "last_seen_ms")


@query
def stream_taste_fading(b):
    """The same with fading: three deliveries, learned days after they end."""
    day, month = F.dayofmonth("at"), F.date_trunc("month", F.col("at"))
    now = F.lit(None)
    for until, wait in reversed(DELIVERIES):
        now = F.when(day < until, F.unix_millis(month) + (until - 1 + wait) * DAY_S * 1000).otherwise(now)
    return _taste(b, False, now).select("viewer_id", "library_id", "key", r6("likes").alias("likes"), r6("dislikes").alias("dislikes"),
                                        "last_seen_ms", "learned_at_ms")


@query
def stream_counters(b):
    """Counters from event files arriving one by one, every event delivered twice, and attention from new favourites."""
    events, path = b.watch_events(), _folder(b, "favorite-files")
    b.clips().where("is_favorite").select("library_id", F.col("id").alias("video_id")).write.parquet(path)
    marked = b.spark.readStream.schema("library_id STRING, video_id BIGINT").parquet(path)
    table = jobs.counters_table(b.spark, _folder(b, "counters"))
    stream = jobs.event_stream(b.spark, _event_files(b, events.unionByName(events)), 1)
    _run(jobs.live_counters(stream, table, _folder(b, "cursor"), marked, late="60 days"))
    return table.read().select("library_id", "video_id", *as_long("watch_count", "skip_count", "last_watched_ms"),
                               r6("completion_sum").alias("completion_sum"), r6("attention").alias("attention"))


@query
def stream_events(b):
    """Events appended by a stream, every one delivered twice, and read back per day."""
    events, path = b.watch_events(), _folder(b, "events")
    stream = jobs.event_stream(b.spark, _event_files(b, events.unionByName(events)), 1)
    _run(jobs.append_event_stream(stream, path, _folder(b, "cursor"), late="60 days"))
    return catalog.read_events(b.spark, path).groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("events"), F.count_distinct("viewer_id").alias("viewers"), F.sum("row_id").alias("row_sum"),
        r6(F.sum("completion")).alias("completion_sum"))


@query
def change_feed(b):
    """Changed ids arriving in two files, most named more than once: only those rows of the clip table change."""
    path = _folder(b, "change-files")
    named = b.listing_new().where("id % 13 = 0").select("library_id", "id")
    for part in (named.where("id % 2 = 0").unionByName(named.where("id % 3 = 0")), named.unionByName(named)):
        part.coalesce(1).write.mode("append").parquet(path)
    table = Upserts(b.spark, _folder(b, "clips"), ["library_id", "id"], schemas.CLIPS).start(b.clips_hashed())
    changes = b.spark.readStream.schema("library_id STRING, id BIGINT").option("maxFilesPerTrigger", 1).parquet(path)
    _run(jobs.follow_changes(changes, b.listing_new, table, _folder(b, "cursor")))
    return table.read().select(
        "library_id", "id", "display_name", "folder_name", *as_long("duration_ms", "size_bytes", "date_added_sec", "width", "height"),
        "category", "tags", "about", r6("confidence").alias("confidence"), r6("junk_score").alias("junk_score"),
        *as_long("brain_level", "face_count", "smile_count", "person_id", "album_id"), r6("sharpness").alias("sharpness"),
        r6("speech_ratio").alias("speech_ratio"), "is_favorite", "manual_group", "prosody_tags", "transcript")


@query
def vector_feed(b):
    """Vectors arriving in two files: each is matched, parked as ambiguous, or founds a person; the second file also
    meets whom the first one placed and founded."""
    path, v = _folder(b, "vector-files"), b.vectors().select("library_id", "id", "video_id", "person_id", "vec", "quality")
    fresh = v.where("person_id < 0")
    for part in (fresh.where("id % 2 = 0"), fresh.where("id % 2 = 1")):
        part.coalesce(1).write.mode("append").parquet(path)
    table = jobs.vectors_table(b.spark, _folder(b, "vectors")).start(v.where("person_id >= 0"))
    arriving = b.spark.readStream.schema(schemas.VECTORS).option("maxFilesPerTrigger", 1).parquet(path)
    _run(jobs.follow_vectors(arriving, b.persons, b.denials, table, _folder(b, "cursor"), min_sim=0.30, min_margin=0.02))
    return table.read().select("library_id", "id", *as_long("video_id", "person_id"))


@query
def library_signatures(b):
    return jobs.signatures(b.clips(), dups.suppression(b.dismissals(), b.clips_hashed())).select(
        "library_id", *as_long("clips", "id_sum", "date_sum", "suppressed"))


@query
def changed_libraries(b):
    """One clip leaves every library but 'de': the others need a new feed."""
    gone = b.dismissals()
    now = jobs.signatures(b.clips(), gone)
    first = b.clips().groupBy("library_id").agg(F.min("id").alias("_first"))
    before = b.clips().join(first, "library_id").where(
        (F.col("library_id") == "de") | (F.col("id") != F.col("_first"))).drop("_first")
    return jobs.changed_libraries(now, jobs.signatures(before, gone))
