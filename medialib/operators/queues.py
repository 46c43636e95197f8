"""Budgeted work queues: which items the costly passes should read next, per library."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialib.functions.ranking import top_k
from medialib.operators.classify import owes_labels, priority

SEMANTIC_FLOOR, SEMANTIC_CEILING = 25, 600


def _newest():
    return [F.desc("date_added_sec"), F.asc("id")]


def queue_perceptual(clips: DataFrame, limit: int = 200) -> DataFrame:
    return top_k(clips.where("brain_level < 1"), ["library_id"], _newest(), limit)


def queue_semantic(clips: DataFrame, budget: int = 250) -> DataFrame:
    """Most valuable first. The budget follows how much is owed, between 25 and the setting."""
    owed = clips.where(owes_labels()).withColumn("priority", priority())
    ceiling = max(SEMANTIC_FLOOR, min(SEMANTIC_CEILING, budget))
    counts = owed.groupBy("library_id").agg(F.count("*").alias("owed"))
    ranked = top_k(owed, ["library_id"], [F.desc("priority"), *_newest()], ceiling)
    allowed = F.greatest(F.lit(SEMANTIC_FLOOR), F.least(F.col("owed"), F.lit(ceiling)))
    return (ranked.join(counts, "library_id").withColumn("budget", allowed)
            .where(F.col("rank") <= F.col("budget")))


def queue_voice(clips: DataFrame, limit: int = 60) -> DataFrame:
    """Clips with a face that the audio pass has not heard, clutter left out."""
    waiting = clips.where((F.col("prosody_tags") == "") & (F.col("face_count") > 0)
                          & (F.col("junk_score") < 0.6) & (F.col("brain_level") >= 1))
    return top_k(waiting, ["library_id"],
                 [F.desc(F.col("speech_ratio") == 0), F.desc("face_count"), F.desc("size_bytes"), F.asc("id")],
                 limit)


def queue_transcript(clips: DataFrame, attention: DataFrame, limit: int = 8,
                     min_speech: float = 0.1, max_ms: int = 120_000) -> DataFrame:
    """Short talking clips never tried; what the viewer cares about goes first."""
    waiting = (clips.where(F.col("transcript").isNull() & (F.col("speech_ratio") >= min_speech)
                           & (F.col("duration_ms") <= max_ms))
               .withColumn("priority", priority())
               .join(attention.select("library_id", F.col("video_id").alias("id"), "attention"),
                     ["library_id", "id"], "left")
               .withColumn("attention", F.coalesce("attention", F.lit(0.0))))
    return top_k(waiting, ["library_id"],
                 [F.desc("attention"), F.desc("priority"), *_newest()], limit)


def queue_photo(photos: DataFrame, limit: int = 40) -> DataFrame:
    return top_k(photos.where("brain_level < 1 AND junk_score < 0.9"), ["library_id"], _newest(), limit)


def queue_counts(clips: DataFrame, photos: DataFrame) -> DataFrame:
    """How much each queue still holds, per library."""
    c = clips.groupBy("library_id").agg(
        F.count_if(F.col("brain_level") < 1).alias("perceptual"),
        F.count_if(owes_labels()).alias("semantic"),
        F.count_if((F.col("prosody_tags") == "") & (F.col("face_count") > 0)
                   & (F.col("junk_score") < 0.6) & (F.col("brain_level") >= 1)).alias("voice"),
        F.count_if(F.col("prosody_tags") != "").alias("voice_done"),
        F.count_if(F.coalesce("transcript", F.lit("")) != "").alias("transcripts"))
    p = photos.groupBy("library_id").agg(F.count_if(F.col("brain_level") < 1).alias("photo"))
    return c.join(p, "library_id", "full_outer").na.fill(0)
