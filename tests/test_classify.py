from pyspark.sql import functions as F

from medialib.operators import classify, fingerprints
from tests.rows import clips, photos


def values(df, *cols):
    rows = df.orderBy("id").select(*cols).collect()
    return [r[0] if len(cols) == 1 else tuple(r) for r in rows]


def test_name_beats_folder_beats_unknown(spark):
    df = clips(spark, [dict(id=1, display_name="Bday_cake.final.mp4", folder_name="Trip 2020"),
                       dict(id=2, display_name="x.mp4", folder_name="Beach"),
                       dict(id=3, display_name="x.mp4", folder_name="zz", duration_ms=19_999),
                       dict(id=4, display_name="x.mp4", folder_name="zz", duration_ms=20_000)])
    got = values(classify.classify_names(df), "l0_category", "l0_about", "l0_confidence")
    assert got == [("birthday", "Birthday • Trip 2020", 0.85), ("trip", "Trip • Beach", 0.7),
                   ("unknown", "Quick clip • zz", 0.35), ("unknown", "Video • zz", 0.35)]


def test_name_words_are_distinct_long_and_capped(spark):
    df = clips(spark, [dict(id=1, display_name="One-one TWO_ab three four five six seven.mov")])
    assert values(classify.classify_names(df), "l0_tags") == [["one", "two", "three", "four", "five"]]


def test_clip_junk_adds_and_clamps(spark):
    df = clips(spark, [dict(id=1, folder_name="WhatsApp Video", display_name="Screenshot 1.mp4"),
                       dict(id=2, folder_name="Camera", display_name="VID_2019.mp4"),
                       dict(id=3, folder_name="TikTok-Vids", display_name="IMG_2020.mp4")])
    assert [round(v, 6) for v in values(df.select("id", classify.clip_junk().alias("j")), "j")] == [1.0, 0.0, 0.3]


def test_photo_shapes_and_record_words(spark):
    df = photos(spark, [dict(id=1, display_name="a.png", width=1080, height=2400),
                        dict(id=2, display_name="IMG_1.png", width=1080, height=2400),
                        dict(id=3, display_name="a.png", width=1000, height=2000),
                        dict(id=4, display_name="my receipt.png"), dict(id=5, display_name="Scandinavia.png"),
                        dict(id=6, display_name="a.png", width=0, height=0)])
    assert values(df.select("id", classify.photo_junk().alias("j")), "j") == [0.9, 0.0, 0.7, 0.75, 0.0, 0.0]


def fuse(spark, labels, **photo):
    p = photos(spark, [dict(id=1, **{k: v for k, v in photo.items() if k != "sharpness"})]).withColumn(
        "sharpness", F.lit(float(photo.get("sharpness", 0))))
    rows = [(1, i, t, float(c)) for i, (t, c) in enumerate(labels)]
    df = spark.createDataFrame(rows, "id bigint, pos int, label string, conf double")
    r = classify.fuse_labels(p, df).first()
    return r["fused_category"], r["fused_tags"], r["fused_about"], round(r["fused_confidence"], 6)


def test_labels_follow_name_then_folder_then_known_label(spark):
    labels = [("Dress", 0.9), ("Dog", 0.7), ("Mud", 0.5)]
    assert fuse(spark, labels, display_name="cake.jpg", folder_name="Trips") == (
        "birthday", "dress,dog,birthday,trip,pet", "Birthday • Trips", 0.85)
    assert fuse(spark, labels, display_name="q.jpg", folder_name="zz") == ("pet", "dress,dog,pet", "Dress", 0.7)
    assert fuse(spark, [("Night Sky", 0.8)], display_name="q.jpg", folder_name="zz") == (
        "night_sky", "night_sky", "Night Sky", 0.8)
    assert fuse(spark, [("Dog", 0.59)], display_name="q.jpg", folder_name="zz") == ("unknown", "", "", 0.0)


def test_blur_voids_labels_but_unmeasured_does_not(spark):
    assert fuse(spark, [("Dog", 0.9)], display_name="q.jpg", folder_name="zz", sharpness=7.9)[0] == "unknown"
    assert fuse(spark, [("Dog", 0.9)], display_name="q.jpg", folder_name="zz", sharpness=0)[0] == "pet"
    assert fuse(spark, [("Dog", 0.9)], display_name="q.jpg", folder_name="zz", sharpness=8)[0] == "pet"


def test_transcripts(spark):
    long = "word " * 60
    df = spark.createDataFrame([(1, "  hi \n there ... , "), (2, None), (3, "…"), (4, long), (5, "x" * 300), (6, "ab"),
                                (7, "مرحبا")], "id int, t string")
    got = values(df.select("id", classify.shape_transcript("t").alias("s"), classify.usable_transcript("t").alias("u")), "s", "u")
    assert got[0] == ("hi there", True) and got[1] == ("", False) and got[2] == ("", False)
    assert len(got[3][0]) <= 240 and got[3][0].endswith("word") and got[4][0] == "x" * 240
    assert got[5] == ("ab", False) and got[6][1]
    again = df.select("id", classify.shape_transcript(classify.shape_transcript("t")).alias("s"))
    assert values(again, "s") == [g[0] for g in got]


def test_acoustic_profile_uses_upper_medians(spark):
    rows = [("c", float(db), 0.5, float(hz)) for db, hz in [(-20, 100), (-10, 200), (-30, 300), (-40, 400)]]
    rows += [("q", -50.0, 0.5, 100.0), ("q", -2.0, 0.5, 100.0), ("one", -20.0, 0.5, 100.0)]
    w = spark.createDataFrame(rows, "clip_id string, db double, voiced double, pitch_hz double")
    d = spark.createDataFrame([("c", 2000), ("q", 2000), ("one", 2000)], "clip_id string, duration_ms bigint")
    r = {x["clip_id"]: x for x in classify.acoustic_profile(w, d).collect()}
    assert r["c"]["pitch_hz"] == 300.0 and r["c"]["speech_ratio"] == 1.0 and r["c"]["peaks_per_sec"] == 0.5
    assert r["c"]["tags"].startswith("speaking,high voice,expressive")
    assert r["q"]["tags"] == "mostly music or ambience" and r["one"]["summary"] == "audio not read"


def test_gradient_hash_and_sharpness(spark):
    falling = [9 - x for _ in range(8) for x in range(9)]
    df = spark.createDataFrame([(1, falling), (2, [5] * 72)], "id int, g array<int>")
    got = values(df.select("id", fingerprints.gradient_hash("g").alias("h"), fingerprints.step_sharpness("g", 9).alias("s")), "h", "s")
    assert got == [(-1, 4.0), (0, 0.0)]


def test_detection_rank_precedes_size_gate(spark):
    rows = [(1, 0, 100, 100, 9.0), (1, 1, 300, 40, 9.0), (1, 2, 60, 60, 9.0), (2, 0, 100, 100, 7.9)]
    df = spark.createDataFrame(rows, "media_id int, box_no int, w int, h int, sharpness double")
    got = classify.detection_gate(df).collect()
    assert [(r["media_id"], r["box_no"]) for r in got] == [(1, 0)]


def test_merged_tags_keep_old_and_stop_at_twelve(spark):
    df = clips(spark, [dict(id=1, tags="a,b,dog"), dict(id=2, tags="z", category="vlog")])
    rows = [(1, f, i, f"Dog {f}{i}" if i else "Dog", 0.9) for f in range(4) for i in range(5)] + [(2, 0, 0, "Cat", 0.6)]
    lab = spark.createDataFrame(rows, "id bigint, frame_no int, pos int, label string, conf double")
    got = values(classify.merge_labels(df, lab), "merged_category", "merged_tags", "merged_confidence")
    assert got[0][0] == "pet" and got[0][1].split(",")[:4] == ["a", "b", "dog", "dog_01"]
    assert len(got[0][1].split(",")) == 12 and got[1] == ("vlog", "z", 0.7)
