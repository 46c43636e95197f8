"""Catalogue reads: listing rows become clip and photo rows; deltas; watch-event files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialib.functions.ranking import top_k
from medialib.operators.classify import fuse_labels, photo_junk
from medialib.sources import schemas


def read_listing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Listing rows with the declared schema (parquet, json, csv or orc)."""
    reader = spark.read.schema(schemas.LISTING)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def clip_rows(listing: DataFrame) -> DataFrame:
    """Clips from listing rows: last path part as folder, defaults for what is missing; ``uri`` where the listing has it."""
    path = F.regexp_replace(F.coalesce("relative_path", F.lit("")), "^/+|/+$", "")
    folder = F.substring_index(path, "/", -1)
    return listing.select(
        "library_id", "id",
        F.coalesce("display_name", F.concat(F.lit("video_"), F.col("id").cast("string")))
        .alias("display_name"),
        F.when(folder == "", "Videos").otherwise(folder).alias("folder_name"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in
          ("duration_ms", "size_bytes", "date_added_sec", "width", "height")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in listing.columns if c == "uri"])


def photo_rows(listing: DataFrame) -> DataFrame:
    """Photos from listing rows, with the name-and-shape verdict attached on read."""
    path = F.regexp_replace(F.coalesce("relative_path", F.lit("")), "/+$", "")
    base = listing.where(F.col("display_name").isNotNull()).select(
        "library_id", "id", "display_name", F.substring_index(path, "/", -1).alias("folder_name"),
        "date_added_sec", "width", "height",
        (F.coalesce(F.col("mime").isin("image/gif", "image/webp"), F.lit(False))
         | F.lower("display_name").endswith(".gif")).alias("animated"))
    fused = fuse_labels(base, None)
    return fused.select(*base.columns, F.col("fused_category").alias("category"),
                        F.col("fused_tags").alias("tags"), F.col("fused_about").alias("about"),
                        F.col("fused_confidence").alias("confidence"),
                        photo_junk().alias("junk_score"))


def delta_rows(listing: DataFrame, changes: DataFrame) -> DataFrame:
    """Listing rows named by a change feed, each once however often it was named."""
    return listing.join(changes.select("library_id", "id"), ["library_id", "id"], "left_semi")


def append_events(events: DataFrame, path: str) -> None:
    """Append watch events, laid out by day so that recent reads prune."""
    (events.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path))


def read_events(spark: SparkSession, path: str, days: bool = False) -> DataFrame:
    """Stored events; with ``days`` also the day each is kept under."""
    stored = spark.read.schema(schemas.WATCH_EVENTS + ", day DATE").parquet(path)
    return stored if days else stored.drop("day")


def recent_events(events: DataFrame, keep: int = 300) -> DataFrame:
    """Newest ``keep`` events per viewer, newest first by ``rank``."""
    return top_k(events, ["viewer_id"], [F.desc("at"), F.desc("row_id")], keep, "rank", salt="row_id")


def events_after(events: DataFrame, row_id: int, seen_until: str | None = None, late_days: int = 1) -> DataFrame:
    """Events that arrived after ``row_id``. ``seen_until``: the day of the newest event known then; of a table kept by
    day only the days from ``late_days`` before it are read, as nothing later than that is taken in."""
    fresh = events.where(F.col("row_id") > row_id)
    if seen_until is None:
        return fresh
    first = F.date_sub(F.lit(seen_until).cast("date"), late_days)
    return fresh.where((F.col("day") if "day" in events.columns else F.to_date("at")) >= first)
