"""Watching behaviour: counters, attention, and the taste learned from watch events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialib.functions.when import epoch_ms

WATCH_STEP, FAVORITE_STEP, ATTENTION_CAP, QUEUE_PULL = 1.0, 1.5, 3.0, 0.25
LIKE_FROM, DISLIKE_BELOW = 0.7, 0.2
NEUTRAL_EVIDENCE, HALF_LIFE_DAYS, SHORT_MS = 6.0, 21.0, 25_000
DAY_MS = 86_400_000


def engagement(events: DataFrame) -> DataFrame:
    """Counters per clip: watches, summed completion, skips, last watch."""
    return events.groupBy("library_id", "video_id").agg(
        F.count("*").alias("watch_count"), F.sum("completion").alias("completion_sum"),
        F.count_if("skipped").alias("skip_count"), F.max(epoch_ms("at")).alias("last_watched_ms"))


def with_engagement(clips: DataFrame, counters: DataFrame) -> DataFrame:
    """Clips with their counters (zero when never watched) and derived columns."""
    c = counters.withColumnRenamed("video_id", "id")
    joined = clips.join(c, ["library_id", "id"], "left").na.fill(
        0, ["watch_count", "completion_sum", "skip_count", "last_watched_ms"])
    return joined.withColumns({
        "avg_completion": F.when(F.col("watch_count") == 0, 0.0)
        .otherwise(F.try_divide("completion_sum", "watch_count")),
        "effective_group": effective_group(),
        "prosody_known": F.trim("prosody_tags") != ""})


def effective_group() -> Column:
    """The hand-made group where there is one, else the category."""
    return F.when(F.trim(F.coalesce("manual_group", F.lit(""))) != "", F.col("manual_group")) \
        .otherwise(F.col("category"))


def attention(events: DataFrame, favorites: DataFrame) -> DataFrame:
    """Attention per clip. Steps only ever add, so capping each step equals capping the sum."""
    steps = events.where(~F.col("skipped")).select(
        "library_id", "video_id", F.lit(WATCH_STEP).alias("step")).unionByName(
        favorites.select("library_id", "video_id", F.lit(FAVORITE_STEP).alias("step")))
    total = steps.groupBy("library_id", "video_id").agg(F.sum("step").alias("_s"))
    capped = F.least(F.lit(ATTENTION_CAP), F.col("_s"))
    return total.select("library_id", "video_id", capped.alias("attention"),
                        (capped >= QUEUE_PULL).alias("pulls_queue"))


def taste_keys() -> Column:
    """Attribute keys a clip votes on, each with its weight in the blend."""
    key = lambda cond, text, w: F.when(cond, F.struct(text.alias("key"), F.lit(w).alias("weight")))
    length = F.when(F.col("duration_ms") < SHORT_MS, "dur:short").otherwise("dur:long")
    return F.filter(F.array(
        key(F.trim("category") != "", F.concat(F.lit("cat:"), "category"), 2.0),
        key(F.col("person_id") >= 0, F.concat(F.lit("person:"), F.col("person_id").cast("string")), 2.0),
        key(F.trim("folder_name") != "", F.concat(F.lit("folder:"), "folder_name"), 1.0),
        key(F.lit(True), length, 1.0)), lambda k: k.isNotNull())


def taste_buckets(events: DataFrame, clips: DataFrame) -> DataFrame:
    """Likes, dislikes and last event per ``(viewer_id, library_id, key)``; keys name persons and folders of one library.

    Events are first reduced per viewer and clip, so a clip or viewer with a large
    share of all events costs one row per pair when keys are exploded.
    """
    votes = (events.withColumn("_l", (F.col("completion") >= LIKE_FROM).cast("double"))
             .withColumn("_d", (F.col("completion") < DISLIKE_BELOW).cast("double"))
             .where("_l + _d > 0")
             .groupBy("viewer_id", "library_id", F.col("video_id").alias("id")).agg(
                 F.sum("_l").alias("_l"), F.sum("_d").alias("_d"), F.max(epoch_ms("at")).alias("_t")))
    keyed = clips.select("library_id", "id", taste_keys().alias("_keys"))
    return (votes.join(keyed, ["library_id", "id"])
            .select("viewer_id", "library_id", "_l", "_d", "_t", F.explode("_keys").alias("k"))
            .groupBy("viewer_id", "library_id", F.col("k.key").alias("key")).agg(
                F.sum("_l").alias("likes"), F.sum("_d").alias("dislikes"), F.max("_t").alias("last_seen_ms")))


def decay(buckets: DataFrame, elapsed_ms: Column) -> DataFrame:
    """Fade buckets by half-life once half a half-life has passed; nearly empty ones vanish."""
    halvings = elapsed_ms / F.lit(HALF_LIFE_DAYS * DAY_MS)
    due = halvings >= 0.5
    factor = F.when(due, F.pow(F.lit(0.5), halvings)).otherwise(F.lit(1.0))
    faded = buckets.withColumn("_due", due).withColumn("likes", F.col("likes") * factor) \
        .withColumn("dislikes", F.col("dislikes") * factor)
    return faded.where(~F.col("_due") | (F.col("likes") + F.col("dislikes") >= 1.0)).drop("_due")


def bucket_affinity(likes: Column, dislikes: Column) -> Column:
    """Smoothed like ratio; thin evidence stays near one half."""
    n = likes + dislikes
    return F.when(n > 0, F.least(F.lit(1.0), (likes + NEUTRAL_EVIDENCE * 0.5) / (n + NEUTRAL_EVIDENCE))) \
        .otherwise(F.lit(0.5))


def profiles(clips: DataFrame) -> DataFrame:
    """Clips with ``profile``, the text of the attributes that taste looks at."""
    return clips.withColumn("profile", F.concat_ws("\u0001", F.transform(taste_keys(), lambda k: k["key"])))


def profile_ids(clips: DataFrame) -> DataFrame:
    """``(library_id, profile, profile_id, _keys)``: each profile named by its lowest clip id."""
    return profiles(clips).groupBy("library_id", "profile").agg(
        F.min("id").alias("profile_id"), F.first(taste_keys()).alias("_keys"))


def taste_affinity(viewers: DataFrame, clips: DataFrame, buckets: DataFrame) -> DataFrame:
    """Blend and strongest affinity per viewer and attribute profile of the viewer's library.

    ``viewers`` is ``(viewer_id, library_id)``. Clips sharing all attributes get
    one row, so the work follows distinct profiles rather than clips, and
    profiles a viewer has no evidence about are left out: they read neutral.
    """
    distinct = profile_ids(clips)
    keys = distinct.select("library_id", "profile", "profile_id",
                           F.aggregate("_keys", F.lit(0.0), lambda a, k: a + k["weight"]).alias("_all"),
                           F.size("_keys").alias("_n"), F.explode("_keys").alias("k")) \
        .select("library_id", "profile", "profile_id", "_all", "_n", "k.key", "k.weight")
    known = viewers.join(buckets, ["viewer_id", "library_id"]).select(
        "viewer_id", "library_id", "key", bucket_affinity(F.col("likes"), F.col("dislikes")).alias("a"))
    hits = known.join(keys, ["library_id", "key"]).groupBy("viewer_id", "library_id", "profile_id").agg(
        F.first("profile").alias("profile"), F.first("_all").alias("_all"), F.first("_n").alias("_n"), F.count("*").alias("_k"),
        F.sum((F.col("a") - 0.5) * F.col("weight")).alias("_lift"), F.max("a").alias("_max"))
    return hits.select(
        "viewer_id", "library_id", "profile", "profile_id", (0.5 + F.col("_lift") / F.col("_all")).alias("affinity"),
        F.when(F.col("_k") < F.col("_n"), F.greatest(F.col("_max"), F.lit(0.5))).otherwise(F.col("_max"))
        .alias("strongest"))
