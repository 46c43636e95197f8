"""Classification, feature and queue queries over the test tables."""

from pyspark.sql import functions as F

from medialib.operators import classify, fingerprints, queues, taste
from medialib.plans.registry import as_long, query, r6


@query
def classify_names(b):
    return classify.classify_names(b.clips()).select(
        "library_id", "id", F.col("l0_category").alias("category"), F.col("l0_about").alias("about"),
        r6("l0_confidence").alias("confidence"))


@query
def name_tags(b):
    return classify.classify_names(b.clips()).select(
        "library_id", "id", F.array_join("l0_tags", ",").alias("tags"))


@query
def junk_scores(b):
    return b.clips().select("library_id", "id", r6(classify.clip_junk()).alias("junk"))


@query
def photo_junk(b):
    return b.photos().select("library_id", "id", r6(classify.photo_junk()).alias("junk"))


@query
def label_fusion(b):
    photos = b.photos().withColumn("sharpness", F.expr("CAST(id % 12 AS DOUBLE)"))
    labels = b.label_rows().withColumnRenamed("media_id", "id")
    return classify.fuse_labels(photos, labels).select(
        "library_id", "id", F.col("fused_category").alias("category"), F.col("fused_tags").alias("tags"),
        F.col("fused_about").alias("about"), r6("fused_confidence").alias("confidence"))


@query
def label_merge(b):
    labels = b.label_rows().withColumnRenamed("media_id", "id").withColumn("frame_no", F.col("pos"))
    return classify.merge_labels(b.clips(), labels).select(
        "library_id", "id", F.col("merged_category").alias("category"), F.col("merged_tags").alias("tags"),
        F.col("merged_about").alias("about"), r6("merged_confidence").alias("confidence"))


@query
def priority_scores(b):
    return b.clips().select("library_id", "id", r6(classify.priority()).alias("priority"),
                            classify.owes_labels().alias("pending"))


@query
def needs_deeper(b):
    clips = taste.with_engagement(b.clips(), taste.engagement(b.watch_events()))
    return clips.select("library_id", "id", classify.needs_deeper(1706659200).alias("deeper"))


@query
def queue_perceptual(b):
    return queues.queue_perceptual(b.clips()).select("library_id", "id", *as_long("rank"))


@query
def queue_semantic(b):
    return queues.queue_semantic(b.clips()).select(
        "library_id", "id", *as_long("rank", "budget"), r6("priority").alias("priority"))


@query
def queue_voice(b):
    return queues.queue_voice(b.clips()).select("library_id", "id", *as_long("rank"))


def _attention(b):
    favs = b.clips().where("is_favorite").select("library_id", F.col("id").alias("video_id"))
    return taste.attention(b.watch_events(), favs)


@query
def queue_transcript(b):
    return queues.queue_transcript(b.clips(), _attention(b)).select("library_id", "id", *as_long("rank"))


@query
def queue_photo(b):
    return queues.queue_photo(b.photos()).select("library_id", "id", *as_long("rank"))


@query
def queue_counts(b):
    return queues.queue_counts(b.clips(), b.photos()).select(
        "library_id", *as_long("perceptual", "semantic", "voice", "voice_done", "transcripts", "photo"))


@query
def acoustic_profile(b):
    durations = b.clips().select(F.col("id").alias("clip_id"), "duration_ms")
    p = classify.acoustic_profile(b.acoustic_windows(), durations)
    return p.select("clip_id", *[r6(c).alias(c) for c in (
        "speech_ratio", "pitch_hz", "pitch_range", "energy_range", "peaks_per_sec")], "tags", "summary")


@query
def requeue_unclear(b):
    return classify.requeue_unclear(b.clips()).select("library_id", "id", "prosody_tags")


@query
def requeue_ids(b):
    """Named clips wait for their voice again; names are given twice, and some are of no clip."""
    named = b.clips().where("id % 9 = 4").select("library_id", "id")
    ids = named.unionByName(named).unionByName(named.select("library_id", (F.col("id") + 5_000_000).alias("id")))
    return classify.requeue_ids(b.clips(), ids).select("library_id", "id", "prosody_tags")


@query
def shape_transcripts(b):
    return b.clips().select(
        "library_id", "id", classify.shape_transcript("transcript").alias("line"),
        classify.usable_transcript("transcript").alias("usable"))


@query
def fingerprint_grids(b):
    """Gradient hash and sharpness of a 9x8 grid made from the digest of each whole text."""
    docs = b.raw("documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("_m"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.conv(F.substring(F.md5(F.concat(
        F.col("_m"), i.cast("string"))), 1, 2), 16, 10).cast("int"))
    g = docs.withColumn("grid", grid)
    return g.select("id", fingerprints.gradient_hash("grid").alias("phash"),
                    r6(fingerprints.step_sharpness("grid", 9)).alias("sharpness"))


@query
def text_fingerprints(b):
    return b.fingerprints()


@query
def detection_gate(b):
    return classify.detection_gate(b.detections()).select(
        "media_id", *as_long("box_no", "size_rank"), r6(F.col("quality") + 1e-9).alias("quality"))
