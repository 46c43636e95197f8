"""Column programs that name, tag and price items from their text, shape, labels and sound."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialib.functions.ranking import top_k, upper_median
from medialib.functions.text import (
    contains_any, first_upper, starts_with_any, strip_extension, tag_list)
from medialib.functions.when import age_days
from medialib.operators import ontology as words

NAME_CONFIDENCE, FOLDER_CONFIDENCE, UNKNOWN_CONFIDENCE = 0.85, 0.70, 0.35
LABEL_FLOOR, BLURRED_BELOW = 0.60, 8.0


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def name_words(name) -> Column:
    """First six distinct words (three letters or more) of a file name."""
    bare = F.regexp_replace(F.lower(strip_extension(name)), "[^a-z0-9 ]", " ")
    return F.slice(F.array_distinct(F.filter(F.split(bare, " "), lambda t: F.length(t) > 2)), 1, 6)


def classify_names(clips: DataFrame) -> DataFrame:
    """Category, tags, sentence and confidence from the name, else from the folder."""
    by_name, by_folder = words.category_of("display_name"), words.category_of("folder_name")
    df = clips.withColumn("_n", by_name).withColumn("_f", by_folder)
    known = F.coalesce("_n", "_f")
    length_word = F.when(F.col("duration_ms") < 20_000, "Quick clip").otherwise("Video")
    tokens = name_words("display_name")
    return df.withColumns({
        "l0_category": F.coalesce(known, F.lit("unknown")),
        "l0_tags": F.when(known.isNull(), F.slice(tokens, 1, 5)).otherwise(
            F.slice(F.array_distinct(F.concat(tokens, F.array(known))), 1, 8)),
        "l0_about": F.concat(F.coalesce(first_upper(known), length_word), F.lit(" • "),
                             F.col("folder_name")),
        "l0_confidence": F.when(F.col("_n").isNotNull(), NAME_CONFIDENCE)
        .when(F.col("_f").isNotNull(), FOLDER_CONFIDENCE).otherwise(UNKNOWN_CONFIDENCE),
    }).drop("_n", "_f")


def clip_junk(folder="folder_name", name="display_name") -> Column:
    """Clutter price of a clip from folder and file name, 0 to 1."""
    f, n = F.lower(F.trim(F.col(folder))), F.lower(F.col(name))
    step = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    return clamp01(step(contains_any(f, words.JUNK_FOLDERS), 0.75)
                   + step(contains_any(n, words.JUNK_NAMES), 0.45)
                   - step(contains_any(f, words.MEMORY_FOLDERS), 0.55)
                   - step(starts_with_any(n, words.CLIP_CAMERA_PREFIXES), 0.45))


def _has_utility_word(path) -> Column:
    tokens = F.split(strip_extension(F.lower(F.col(path))), r"[^\p{L}\p{N}]+")
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words.UTILITY_WORDS]))


def photo_junk(folder="folder_name", name="display_name") -> Column:
    """Clutter price of a photo: clip price, record words, and screen-shaped pixels."""
    w, h = F.col("width"), F.col("height")
    long, short = F.greatest(w, h), F.least(w, h)
    ratio = F.try_divide(long, short)
    shaped = (w > 0) & (h > 0) & ~starts_with_any(F.lower(F.col(name)), words.PHOTO_CAMERA_PREFIXES)
    listed = (short.isin(words.SCREEN_SHORT) & long.isin(words.SCREEN_LONG) & ratio.between(1.6, 2.5))
    tall = ratio.between(1.9, 2.45) & short.between(600, 1600)
    shape = F.when(shaped & listed, 0.9).when(shaped & tall, 0.7).otherwise(0.0)
    record = F.when(_has_utility_word(name) | _has_utility_word(folder), 0.75).otherwise(0.0)
    return F.greatest(clip_junk(folder, name), record, shape)


def normal_label(label) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"\s+", "_"), "^_+|_+$", "")


def spoken(word) -> Column:
    return first_upper(F.translate(F.col(word) if isinstance(word, str) else word, "_", " "))


def fuse_labels(photos: DataFrame, labels: DataFrame | None, key=("id",)) -> DataFrame:
    """Verdict per photo from name, folder and label rows ``(key, pos, label, conf)``.

    Precedence: name, folder, the strongest label that is a known category (with
    its own confidence), the strongest label. Blurred frames (sharpness above 0
    and under 8) void their labels. Adds ``fused_category/_tags/_about/_confidence``.
    """
    key = list(key)
    df = photos if "sharpness" in photos.columns else photos.withColumn("sharpness", F.lit(0.0))
    if labels is None:
        best = df.select(*key).where(F.lit(False)).select(
            *key, F.lit(None).cast("string").alias("_top"), F.lit(None).cast("double").alias("_top_conf"),
            F.lit(None).cast("string").alias("_map"), F.lit(None).cast("double").alias("_map_conf"),
            F.lit(None).cast("array<string>").alias("_first5"))
    else:
        solid = (labels.where(F.col("conf") >= LABEL_FLOOR)
                 .withColumn("_cat", words.category_of("label"))
                 .withColumn("_order", F.struct((-F.col("conf")).alias("c"), F.col("pos").alias("p"))))
        strongest = solid.groupBy(*key).agg(
            F.min_by("label", "_order").alias("_top"), F.max("conf").alias("_top_conf"),
            F.min_by("_cat", F.when(F.col("_cat").isNotNull(), F.col("_order"))).alias("_map"),
            F.max(F.when(F.col("_cat").isNotNull(), F.col("conf"))).alias("_map_conf"))
        first5 = (top_k(solid, key, [F.desc("conf"), F.asc("pos")], 5, "_r", salt="pos")
                  .groupBy(*key).agg(F.transform(
                      F.array_sort(F.collect_list(F.struct("_r", "label"))),
                      lambda s: normal_label(s["label"])).alias("_first5")))
        best = strongest.join(first5, key)
    df = (df.join(best, key, "left")
          .withColumn("_n", words.category_of("display_name"))
          .withColumn("_f", words.category_of("folder_name"))
          .withColumn("_void", (F.col("sharpness") > 0) & (F.col("sharpness") < BLURRED_BELOW)))
    for c in ("_top", "_top_conf", "_map", "_map_conf", "_first5"):
        df = df.withColumn(c, F.when(~F.col("_void"), F.col(c)))
    df = df.withColumn("fused_category", F.coalesce(
        "_n", "_f", "_map", normal_label("_top"), F.lit("unknown")))
    named = F.col("_n").isNotNull() | F.col("_f").isNotNull()
    parts = F.concat(F.coalesce("_first5", F.array().cast("array<string>")),
                     F.array("_n", "_f", "_map", F.when(
                         F.col("fused_category") != "unknown", F.col("fused_category"))))
    return df.withColumns({
        "fused_tags": F.array_join(F.slice(F.array_distinct(
            F.filter(parts, lambda t: t.isNotNull())), 1, 6), ","),
        "fused_about": F.when(F.col("fused_category") == "unknown", "")
        .when(~named, spoken("_top"))
        .when(F.trim("folder_name") == "", spoken("fused_category"))
        .otherwise(F.concat(spoken("fused_category"), F.lit(" • "), F.col("folder_name"))),
        "fused_confidence": F.when(F.col("_n").isNotNull(), NAME_CONFIDENCE)
        .when(F.col("_f").isNotNull(), FOLDER_CONFIDENCE)
        .otherwise(F.coalesce("_map_conf", "_top_conf", F.lit(0.0))),
    }).drop("_top", "_top_conf", "_map", "_map_conf", "_first5", "_n", "_f", "_void")


def merge_labels(clips: DataFrame, labels: DataFrame, key=("id",)) -> DataFrame:
    """Semantic pass over label rows ``(key, frame_no, pos, label, conf)``.

    Up to five labels above .6 per frame, distinct over frames; the category is
    looked up in the labels, else kept; tags grow to at most twelve. Labels of a
    clip are reduced to its distinct words before anything is gathered.
    """
    key = list(key)
    per_frame = top_k(labels.where(F.col("conf") > 0.6), [*key, "frame_no"], [F.asc("pos")], 5,
                      "_r", salt="pos")
    distinct = (per_frame.withColumn("_w", F.translate(F.lower("label"), " ", "_"))
                .groupBy(*key, "_w").agg(F.min(F.struct("frame_no", "pos")).alias("_at")))
    cat_rank = distinct.groupBy(*key).agg(
        F.min(words.category_rank(words.category_of("_w"))).alias("_rank"))
    # Twelve tags survive, so the first twelve words of a clip are all that can matter.
    first = (top_k(distinct, key, [F.asc("_at")], 12, "_i", salt="_w").groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_w"))), lambda s: s["_w"]).alias("_words")))
    table = F.array(*[F.lit(c) for c in words.CATEGORIES])
    df = clips.join(cat_rank.join(first, key), key, "left")
    found = F.when(F.col("_rank").isNotNull(), F.element_at(table, F.col("_rank").cast("int")))
    category = F.coalesce(found, F.col("category"))
    read = F.col("_words").isNotNull()
    # A word that repeats an old tag adds nothing but fills no place either, so twelve suffice.
    merged = F.slice(F.array_distinct(F.concat(tag_list("tags"), "_words")), 1, 12)
    return df.withColumns({
        "merged_category": category,
        "merged_tags": F.when(read, F.array_join(merged, ",")).otherwise(F.col("tags")),
        "merged_about": F.when(read, F.concat(first_upper(category), F.lit(" • "), F.array_join(
            F.slice("_words", 1, 2), ", "))).otherwise(F.col("about")),
        "merged_confidence": F.when(read, 0.85).otherwise(0.7),
    }).drop("_rank", "_words")


def priority(junk="junk_score", duration="duration_ms", faces="face_count",
             category="category") -> Column:
    """Expected value of a semantic read, 0 to 1."""
    minutes = F.col(duration) / 600_000.0
    add = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    return clamp01(clamp01(1.0 - F.col(junk)) * 0.40 + add(F.col(category) == "unknown", 0.20)
                   + add(F.col(faces) > 0, 0.20) + add(F.col(duration) > 60_000, 0.10)
                   + 0.10 * F.least(F.lit(1.0), minutes))


def owes_labels(category="category", confidence="confidence") -> Column:
    return (F.col(category) == "unknown") | (F.col(confidence) < 0.6)


def needs_deeper(as_of: int) -> Column:
    """Whether a clip deserves the deeper read; expects ``watch_count`` joined in."""
    return (F.when(F.col("confidence") >= 0.85, False)
            .when(F.col("junk_score") >= 0.8, False)
            .when(F.col("watch_count") > 0, True)
            .when((age_days("date_added_sec", as_of) > 180) & (F.col("junk_score") < 0.4), True)
            .otherwise(F.col("confidence") < 0.6))


def acoustic_profile(windows: DataFrame, durations: DataFrame, key=("clip_id",)) -> DataFrame:
    """Sound profile per clip from window rows ``(key, db, voiced, pitch_hz)``.

    ``durations`` holds ``(key, duration_ms)``. A clip needs two windows to count
    as sampled. Medians are the upper ones and are picked through value steps,
    so a clip with very many windows is not sorted in one task.
    """
    key = list(key)
    is_speech = F.col("db").between(-46.0, -4.0) & (F.col("voiced") >= 0.16)
    w = windows.withColumn("_speech", is_speech).withColumn(
        "_pitch", F.when(is_speech, F.col("pitch_hz")))
    stats = w.groupBy(*key).agg(
        F.count("*").alias("windows"), F.count_if("_speech").alias("speech"),
        F.max("db").alias("_hi"), F.min("db").alias("_lo"),
        F.count("_pitch").alias("_np"), F.stddev_pop("_pitch").alias("_sd"))
    mid_db = upper_median(w, key, "db", 0.05, "_mid_db")
    mid_pitch = upper_median(w.where(F.col("_pitch").isNotNull()), key, "_pitch", 0.5, "pitch_hz")
    peaks = (w.select(*key, "db").join(mid_db, key).where(F.col("db") > F.col("_mid_db") + 6.0)
             .groupBy(*key).agg(F.count("*").alias("_peaks")))
    df = (stats.join(mid_pitch, key, "left").join(peaks, key, "left")
          .join(durations.select(*key, "duration_ms"), key, "left"))
    sampled = F.col("windows") >= 2
    heard = sampled & (F.col("speech") > 0)
    seconds = F.greatest(F.coalesce("duration_ms", F.lit(0)) / 1000.0, F.lit(1.0))
    zero = lambda c: F.when(heard, c).otherwise(F.lit(0.0))
    df = df.select(
        *key, sampled.alias("sampled"),
        zero(clamp01(F.col("speech") / F.col("windows"))).alias("speech_ratio"),
        zero(F.coalesce("pitch_hz", F.lit(0.0))).alias("pitch_hz"),
        zero(F.when((F.col("_np") >= 4) & (F.col("pitch_hz") > 0),
                    clamp01(F.try_divide("_sd", "pitch_hz"))).otherwise(0.0)).alias("pitch_range"),
        zero(F.when(F.col("windows") > 2, clamp01((F.col("_hi") - F.col("_lo")) / 40.0))
             .otherwise(0.0)).alias("energy_range"),
        zero(F.least(F.lit(12.0), F.coalesce("_peaks", F.lit(0)) / seconds)).alias("peaks_per_sec"))
    talk = F.col("speech_ratio") > 0.45
    pick = lambda cond, tag: F.when(talk & cond, tag)
    p, spread, pace = F.col("pitch_hz"), F.col("pitch_range"), F.col("peaks_per_sec")
    tags = F.array(
        F.when(talk, "speaking"),
        F.when(talk & p.between(60, 165), "low voice").when(talk & p.between(165, 240), "steady voice")
        .when(talk & (p >= 240), "high voice"),
        pick(spread > 0.28, "expressive"), pick(spread < 0.10, "flat delivery"),
        pick(F.col("energy_range") > 0.55, "emphatic"),
        pick(pace > 3.2, "fast talker"), pick(pace.between(0.4, 1.6), "unhurried"),
        F.when(F.col("speech_ratio") < 0.12, "mostly music or ambience"),
        F.when(~talk & (F.col("speech_ratio") >= 0.12), "partly speaking"))
    pct = lambda c: F.floor(F.col(c) * 100 + 1e-9).cast("string")
    return df.withColumn("tags", F.when(F.col("sampled"), F.array_join(tags, ",")).otherwise("")) \
        .withColumn("summary", F.when(~F.col("sampled"), "audio not read").otherwise(F.concat(
            pct("speech_ratio"), F.lit("% speech, "),
            F.when(p > 0, F.concat(F.floor(p).cast("string"), F.lit(" Hz")))
            .otherwise("no clear pitch"), F.lit(", pitch range "), pct("pitch_range"), F.lit("%"))))


def requeue_unclear(clips: DataFrame) -> DataFrame:
    """Blank the voice tags of clips whose reading was unclear, flat or half-and-half."""
    again = (F.col("prosody_tags").contains("unclear") | F.col("prosody_tags").contains("flat delivery")
             | ((F.col("speech_ratio") > 0.35) & (F.col("speech_ratio") < 0.55)))
    return clips.withColumn("prosody_tags", F.when(again, "").otherwise(F.col("prosody_tags")))


def requeue_ids(clips: DataFrame, ids: DataFrame) -> DataFrame:
    """Blank the voice tags of the clips named in ``ids (library_id, id)``."""
    named = ids.select("library_id", "id").distinct().withColumn("_again", F.lit(True))
    return (clips.join(named, ["library_id", "id"], "left")
            .withColumn("prosody_tags", F.when(F.col("_again"), "").otherwise(F.col("prosody_tags")))
            .drop("_again"))


def shape_transcript(text) -> Column:
    """One line: whitespace collapsed, trailing dots and commas dropped, cut at a word within 240."""
    c = F.col(text) if isinstance(text, str) else text
    line = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    line = F.regexp_replace(line, r"[ .,…]*[.,…]$", "")
    head = F.substring(line, 1, 241)
    # A space within the first 241 characters ends the last whole word that fits.
    at_word = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    long = F.when(at_word != "", F.trim(at_word)).otherwise(F.substring(line, 1, 240))
    return F.when(F.length(line) <= 240, line).otherwise(long)


def usable_transcript(text) -> Column:
    return F.regexp_count(shape_transcript(text), F.lit(r"[\p{L}\p{Nd}]")) >= 3


def detection_gate(detections: DataFrame, key=("media_id",)) -> DataFrame:
    """The two largest boxes per item that are big and sharp enough, with their quality.

    Ranking precedes the size test, so a small second box is not replaced by a third.
    """
    d = detections.withColumn("_area", F.col("w").cast("bigint") * F.col("h"))
    two = top_k(d, key, [F.desc("_area"), F.asc("box_no"), F.desc("w"), F.desc("sharpness")], 2, "size_rank", salt="box_no")
    return (two.where((F.col("w") >= 48) & (F.col("h") >= 48) & (F.col("sharpness") >= BLURRED_BELOW))
            .withColumn("quality", 0.6 * clamp01(F.col("_area") / (640.0 * 640.0))
                        + 0.4 * clamp01(F.col("sharpness") / 400.0)).drop("_area"))

