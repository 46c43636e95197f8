"""Keeping tables in step with the world: snapshot diff, sweep guard, retention, deletes, stats."""

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from medialib.functions.ranking import top_k
from medialib.operators.classify import clip_junk, classify_names
from medialib.session import settle
from medialib.sources.evolve import with_defaults
from medialib.sources.schemas import NEW_CLIP, NEW_PHOTO

KEY = ["library_id", "id"]
METADATA = ["uri", "display_name", "duration_ms", "size_bytes", "folder_name", "width", "height"]


def snapshot_diff(known: DataFrame, seen: DataFrame, compare=METADATA) -> DataFrame:
    """``(library_id, id, status)``: new, changed, unchanged or gone, from one full outer join."""
    compare = [c for c in compare if c in known.columns and c in seen.columns]
    old = known.select(*KEY, F.struct(*compare).alias("_old"))
    new = seen.select(*KEY, F.struct(*compare).alias("_new"))
    return old.join(new, KEY, "full_outer").select(
        *KEY, F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed").alias("status"))


def sweep_guard(diff: DataFrame, delta: bool = False) -> DataFrame:
    """Per library: rows known, rows seen, and whether gone rows may be deleted.

    A snapshot that saw less than half of what is known was truncated; a delta
    run never deletes.
    """
    counts = diff.groupBy("library_id").agg(
        F.count_if(F.col("status") != "new").alias("existing"),
        F.count_if(F.col("status") != "gone").alias("seen"))
    truncated = (F.col("existing") > 0) & (F.col("seen") < F.floor(F.col("existing") / 2))
    return counts.withColumn("sweep_ok", F.lit(False) if delta else ~truncated)


def reconcile_clips(known: DataFrame, seen: DataFrame, delta: bool = False) -> DataFrame:
    """The next clip table. New rows get name-based columns, changed rows take the new
    metadata and keep everything derived or taught, gone rows leave if the guard allows."""
    diff = snapshot_diff(known, seen)
    guard = sweep_guard(diff, delta).select("library_id", "sweep_ok")
    status = diff.join(guard, "library_id")
    meta = [c for c in METADATA if c in seen.columns]
    fresh = seen.select(*KEY, *[F.col(c).alias(f"_n_{c}") for c in meta])
    kept = (known.join(status, KEY).where((F.col("status") != "gone") | ~F.col("sweep_ok"))
            .join(fresh, KEY, "left"))
    changed = F.col("status") == "changed"
    kept = kept.select(*[
        F.when(changed, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in meta else F.col(c)
        for c in known.columns])
    added = classify_names(seen.join(diff.where("status = 'new'"), KEY, "left_semi")).select(
        *seen.columns, F.col("l0_category").alias("category"),
        F.array_join("l0_tags", ",").alias("tags"), F.col("l0_about").alias("about"),
        F.col("l0_confidence").alias("confidence"), F.lit(0).alias("brain_level"),
        clip_junk().alias("junk_score"), F.lit(-1).alias("person_id"))
    return kept.unionByName(_started(added, known, NEW_CLIP), allowMissingColumns=True)


def _started(added: DataFrame, known: DataFrame, defaults: dict) -> DataFrame:
    """New rows with a starting value in every column of ``known`` that has one."""
    types = dict(known.dtypes)
    full = with_defaults(added, {c: v for c, v in defaults.items() if c in types and v is not None})
    return full.withColumns({c: F.col(c).cast(types[c]) for c in full.columns if c in types})


def reconcile_photos(known: DataFrame, seen: DataFrame, delta: bool = False) -> DataFrame:
    """The next photo table: new rows in, gone rows out under the guard, known rows untouched."""
    diff = snapshot_diff(known, seen, compare=["display_name"])
    guard = sweep_guard(diff, delta).select("library_id", "sweep_ok")
    status = diff.join(guard, "library_id").where((F.col("status") != "gone") | ~F.col("sweep_ok"))
    kept = known.join(status, KEY, "left_semi")
    added = seen.join(diff.where("status = 'new'"), KEY, "left_semi")
    return kept.unionByName(_started(added, known, NEW_PHOTO), allowMissingColumns=True)


def settle_junk(photos: DataFrame, bar: float = 0.9) -> DataFrame:
    """Unread photos priced at or above ``bar`` count as read, with nothing found in them."""
    done = (F.col("brain_level") < 1) & (F.col("junk_score") >= bar)
    return photos.withColumns({
        "brain_level": F.when(done, 1).otherwise(F.col("brain_level")),
        **{c: F.when(done, F.lit(0)).otherwise(F.col(c))
           for c in ("face_count", "smile_count", "phash") if c in photos.columns}})


def quarantine(clips: DataFrame, readable: str = "readable") -> DataFrame:
    """Park rows whose media could not be read: level 1, no confidence, tagged, never retried."""
    bad = ~F.col(readable)
    swap = lambda c, v: F.when(bad, v).otherwise(F.col(c))
    tags = F.when(F.trim("tags") == "", "unreadable").otherwise(F.concat_ws(",", "tags", F.lit("unreadable")))
    zeros = {c: swap(c, F.lit(0)) for c in ("face_count", "smile_count", "phash", "sharpness")
             if c in clips.columns}
    return clips.withColumns({
        **zeros, "tags": swap("tags", tags), "about": swap("about", F.lit("Could not read a frame")),
        "confidence": swap("confidence", F.lit(0.0)), "brain_level": swap("brain_level", F.lit(1)),
        "junk_score": swap("junk_score", F.greatest("junk_score", F.lit(0.5)))})


def reset_derived(clips: DataFrame, everything: bool = False) -> DataFrame:
    """Forget what was computed; with ``everything`` also what was watched and liked."""
    blank = {"category": "unknown", "tags": "", "about": "", "confidence": 0.0, "brain_level": 0,
             "pending_semantic": False, "priority": 0.0, "face_count": 0, "smile_count": 0,
             "phash": 0, "sharpness": 0.0, "person_id": -1}
    if everything:
        blank |= {"watch_count": 0, "completion_sum": 0.0, "skip_count": 0, "last_watched_ms": 0,
                  "is_favorite": False}
    types = dict(clips.dtypes)
    return clips.withColumns({c: F.lit(v).cast(types[c]) for c, v in blank.items() if c in types})


def retain_events(events: DataFrame, keep: int = 20_000) -> DataFrame:
    """Newest ``keep`` events per viewer; hot viewers are trimmed in sub-groups first."""
    return top_k(events, ["viewer_id"], [F.desc("at"), F.desc("row_id")], keep, "_r",
                 salt="row_id").drop("_r")


def delete_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    gone = ids.select("library_id", F.col("id").alias(id_col))
    return df.join(gone, ["library_id", id_col], "left_anti")


def cascade_delete(clips: DataFrame, vectors: DataFrame, ids: DataFrame):
    """Clips without ``ids``, and vectors without those of the deleted clips."""
    return delete_ids(clips, ids), delete_ids(vectors, ids, "video_id")


def library_stats(clips: DataFrame, persons: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of totals per library. The .5 clutter line is fixed here, unlike on the shelves."""
    c = clips.groupBy("library_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("junk_score") < 0.5).alias("memories"),
        F.count_if(F.col("junk_score") >= 0.5).alias("clutter"),
        F.floor(F.count_if(F.col("brain_level") >= 1) * 100 / F.count("*")).alias("understood_pct"),
        F.count_if(F.col("brain_level") < 1).alias("pending"))
    p = persons.groupBy("library_id").agg(
        F.count("*").alias("people"), F.count_if("split_suggested").alias("flagged"))
    v = vectors.groupBy("library_id").agg(
        F.count("*").alias("vectors"), F.count_if(F.col("person_id") < 0).alias("unassigned"))
    return (c.join(p, "library_id", "left").join(v, "library_id", "left")
            .na.fill(0, ["people", "flagged", "vectors", "unassigned"]))


class RunReport:
    """What each stage of a run wrote and how long that took, from metrics observed while it was written."""

    def __init__(self, run: str):
        self.run, self.stages = run, []

    def settle(self, df: DataFrame, stage: str) -> DataFrame:
        seen, begun = Observation(f"{self.run}-{stage}-{len(self.stages)}"), time.perf_counter()
        written = settle(df.observe(seen, F.count(F.lit(1)).alias("rows")), stage)
        self.stages.append((self.run, len(self.stages), stage, seen.get["rows"], time.perf_counter() - begun))
        return written

    def table(self, spark: SparkSession) -> DataFrame:
        """``(run, step, stage, rows, seconds)``, one row per stage written."""
        return spark.createDataFrame(self.stages, "run string, step int, stage string, rows bigint, seconds double")


def threshold_preview(clips: DataFrame, thresholds) -> DataFrame:
    """What each ``(junk, clips_per_person)`` setting would do to each library.

    The settings are literals expanded per aggregated row, not a joined table.
    """
    settings = F.array(*[F.struct(F.lit(float(j)).alias("junk_threshold"),
                                  F.lit(int(k)).alias("min_clips")) for j, k in thresholds])
    memory = [F.count_if(F.col("junk_score") < float(j)).alias(f"_m{i}")
              for i, (j, _) in enumerate(thresholds)]
    totals = clips.groupBy("library_id").agg(
        F.count("*").alias("total"), *memory,
        F.count_if((F.col("face_count") > 0) & (F.col("person_id") < 0)).alias("unplaced"),
        F.count_if(((F.col("category") == "unknown") | (F.col("confidence") < 0.6))
                   | (F.col("brain_level") < 2)).alias("semantic_owed"))
    people = (clips.where("person_id >= 0").groupBy("library_id", "person_id").agg(F.count("*").alias("n"))
              .groupBy("library_id").agg(*[F.count_if(F.col("n") >= int(k)).alias(f"_p{i}")
                                           for i, (_, k) in enumerate(thresholds)]))
    pick = lambda p: F.element_at(F.array(*[F.col(f"{p}{i}") for i in range(len(thresholds))]),
                                  F.col("pos") + 1)
    return (totals.join(people, "library_id", "left")
            .select("*", F.posexplode(settings).alias("pos", "s"))
            .select("library_id", "s.junk_threshold", "s.min_clips", pick("_m").alias("memories"),
                    (F.col("total") - pick("_m")).alias("clutter"),
                    F.coalesce(pick("_p"), F.lit(0)).alias("people"), "unplaced", "semantic_owed"))
