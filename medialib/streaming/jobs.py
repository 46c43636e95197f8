"""Streams: taste, counters, events, changed files, new vectors. The checkpoint is the cursor.

What a stream has learned is Spark's own keyed state (RocksDB), restored from the checkpoint; what it tells the world is
an `Upserts` table of the rows each batch changed.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from medialib.functions.when import epoch_ms
from medialib.operators import identity, taste
from medialib.operators.reconcile import reconcile_clips
from medialib.session import configure
from medialib.sources import schemas
from medialib.sources.catalog import delta_rows
from medialib.streaming.taste_state import CHANGES, TasteProcessor
from medialib.streaming.upserts import Upserts

COUNTERS = ("library_id STRING, video_id BIGINT, watch_count BIGINT, completion_sum DOUBLE, "
            "skip_count BIGINT, last_watched_ms BIGINT, attention DOUBLE")
ASSIGNED = ("library_id STRING, id BIGINT, video_id BIGINT, person_id INT, vec ARRAY<DOUBLE>, "
            "quality DOUBLE")
LATE = "1 day"


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.WATCH_EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def once_each(events: DataFrame, late: str = LATE) -> DataFrame:
    """Drop repeats of an event; those later than ``late`` behind the newest are not remembered."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["viewer_id", "row_id"])


def taste_table(spark: SparkSession, root: str) -> Upserts:
    return Upserts(spark, root, ["viewer_id", "library_id", "key"], CHANGES, tombstone="gone").start()


def learned_taste(table: Upserts) -> DataFrame:
    """``(viewer_id, library_id, key, likes, dislikes, last_seen_ms, learned_at_ms)`` as the stream left it."""
    rows = table.read()
    stamps = rows.where("key is null").select("viewer_id", "library_id", "learned_at_ms")
    return rows.where("key is not null").drop("learned_at_ms", "gone").join(stamps, ["viewer_id", "library_id"])


def _votes(events: DataFrame, clips: DataFrame, now: Column) -> DataFrame:
    """One row for each attribute an event votes on, or one with a null key where it teaches nothing."""
    liked, disliked = F.col("completion") >= taste.LIKE_FROM, F.col("completion") < taste.DISLIKE_BELOW
    keyed = clips.select("library_id", F.col("id").alias("video_id"), F.transform(taste.taste_keys(), lambda k: k["key"]).alias("_keys"))
    told = events.withColumn("now_ms", now.cast("bigint")).join(keyed, ["library_id", "video_id"], "left")
    return told.select("viewer_id", "library_id", liked.cast("double").alias("liked"), disliked.cast("double").alias("disliked"),
                       epoch_ms("at").alias("at_ms"), "now_ms", F.explode_outer(F.when(liked | disliked, F.col("_keys"))).alias("key"))


def learn_taste(events: DataFrame, clips: DataFrame, table: Upserts, checkpoint: str, now: Column | None = None,
                event_time: bool = False, late: str = LATE) -> DataStreamWriter:
    """Stream that folds every event into the taste of its viewer exactly once, repeats and late ones left out.

    A viewer with events in a library first fades there by the time since it last learned, then takes the new votes; so
    someone watching daily never fades. With ``event_time`` nothing fades here and readers fade each bucket by its own
    ``last_seen_ms`` instead. ``now``: milliseconds at which a batch is learned, the batch's own time by default; the
    latest of a viewer's rows counts. ``clips`` is the library as its source listed it when the stream was started.
    """
    configure(events.sparkSession)
    clock = now if now is not None else F.unix_millis(F.current_timestamp())
    votes = _votes(once_each(events, late), clips, clock)
    learned = votes.groupBy("viewer_id", "library_id").transformWithStateInPandas(
        TasteProcessor(not event_time), CHANGES, "Update", "None")
    return learned.writeStream.outputMode("update").foreachBatch(table.sink()).option("checkpointLocation", checkpoint)


def _steps(events: DataFrame) -> DataFrame:
    """What each event adds to the counters and to the attention of its clip."""
    return events.select(
        "library_id", "video_id", F.lit(1).cast("bigint").alias("watched"), "completion", F.col("skipped").cast("bigint").alias("skips"),
        epoch_ms("at").alias("at_ms"), F.when(F.col("skipped"), 0.0).otherwise(taste.WATCH_STEP).alias("step"))


def _favorite_steps(favorites: DataFrame) -> DataFrame:
    """What newly marked favourites ``(library_id, video_id)`` add: attention alone, no watch."""
    nothing = F.lit(0).cast("bigint")
    return favorites.select("library_id", "video_id", nothing.alias("watched"), F.lit(0.0).alias("completion"), nothing.alias("skips"),
                            nothing.alias("at_ms"), F.lit(taste.FAVORITE_STEP).alias("step"))


def counters_table(spark: SparkSession, root: str) -> Upserts:
    return Upserts(spark, root, ["library_id", "video_id"], COUNTERS).start()


def live_counters(events: DataFrame, table: Upserts, checkpoint: str, favorites: DataFrame | None = None,
                  late: str = LATE) -> DataStreamWriter:
    """Stream that keeps watch counters and attention current, repeats and late events left out.

    The sums are Spark's aggregation state; a batch emits the clips it touched. Attention steps only ever add, so
    capping the sum equals capping each step.
    """
    configure(events.sparkSession)
    steps = _steps(once_each(events, late))
    if favorites is not None:
        steps = steps.unionByName(_favorite_steps(favorites))
    counters = steps.groupBy("library_id", "video_id").agg(
        F.sum("watched").alias("watch_count"), F.sum("completion").alias("completion_sum"), F.sum("skips").alias("skip_count"),
        F.max("at_ms").alias("last_watched_ms"), F.least(F.lit(taste.ATTENTION_CAP), F.sum("step")).alias("attention"))
    return counters.writeStream.outputMode("update").foreachBatch(table.sink()).option("checkpointLocation", checkpoint)


def follow_changes(changes: DataFrame, listing: Callable[[], DataFrame], clips: Upserts, checkpoint: str,
                   every: str = "8 seconds") -> DataStreamWriter:
    """Stream of changed ids ``(library_id, id)``, gathered for a while, that reconciles and writes just those rows."""
    def step(batch: DataFrame, n: int) -> None:
        named = batch.select("library_id", "id").distinct()
        clips.write(reconcile_clips(clips.read(below=n, only=named), delta_rows(listing(), named), delta=True), n)
    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def vectors_table(spark: SparkSession, root: str) -> Upserts:
    return Upserts(spark, root, ["library_id", "id"], ASSIGNED)


def follow_vectors(vectors: DataFrame, persons: Callable[[], DataFrame], denials: Callable[[], DataFrame],
                   table: Upserts, checkpoint: str, **bars) -> DataStreamWriter:
    """Stream of new vectors, matched to persons as they come; leftovers found new persons. A batch writes its own."""
    def step(batch: DataFrame, n: int) -> None:
        stored = table.read(below=n)
        held = stored.where("person_id >= 0").select("library_id", F.col("person_id").alias("id"))
        known = persons().select("library_id", "id").unionByName(held)
        got = identity.assign_or_create(batch, stored, known, denials(), **bars)
        table.write(batch.drop("person_id").join(got.drop("created"), ["library_id", "id"]), n)
    return vectors.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def append_event_stream(events: DataFrame, path: str, checkpoint: str, late: str = LATE) -> DataStreamWriter:
    """Stream that appends watch events to files by day, each event once.

    The file sink's log lists whole batches only, so a reader never sees half of one, nor a retried one twice.
    """
    configure(events.sparkSession)
    return (once_each(events, late).withColumn("day", F.to_date("at")).writeStream.format("parquet").partitionBy("day")
            .option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))


def signatures(clips: DataFrame, suppressed: DataFrame, tuning: str = "", nonce: int = 0) -> DataFrame:
    """What may reshape a running feed, per library: membership, suppression, weights, a reshuffle."""
    c = clips.groupBy("library_id").agg(F.count("*").alias("clips"), F.sum("id").alias("id_sum"),
                                        F.sum("date_added_sec").alias("date_sum"))
    s = suppressed.groupBy("library_id").agg(F.count("*").alias("suppressed"))
    return (c.join(s, "library_id", "left").na.fill(0, ["suppressed"])
            .withColumn("tuning", F.lit(tuning)).withColumn("nonce", F.lit(nonce)))


def changed_libraries(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Libraries whose signature differs from the stored one, or has none."""
    return now.join(stored, now.columns, "left_anti").select("library_id")
