"""The human layer: what people taught the library, exported and imported as one folder."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialib.sources import schemas

VERSION = 2

SECTIONS = {
    "persons": "library_id STRING, id INT, name STRING, verified BOOLEAN",
    "watch_events": "library_id STRING, viewer_id BIGINT, video_id BIGINT, at_ms BIGINT, "
                    "completion DOUBLE, skipped BOOLEAN, hour_of_day INT",
    "favorites": "library_id STRING, id BIGINT",
    "dismissals": schemas.DISMISSALS,
    "group_names": schemas.GROUP_NAMES,
    "denials": schemas.DENIALS,
}


def export_bundle(path: str, persons: DataFrame, events: DataFrame, clips: DataFrame,
                  dismissals: DataFrame, group_names: DataFrame, denials: DataFrame) -> None:
    """Write one JSON section per table of the human layer under ``path/v2``."""
    sections = {
        "persons": persons.select("library_id", "id", "name", "verified"),
        "watch_events": events.select(
            "library_id", "viewer_id", "video_id",
            F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"),
            "completion", "skipped", "hour_of_day"),
        "favorites": clips.where("is_favorite").select("library_id", "id"),
        "dismissals": dismissals.select("library_id", "video_id"),
        "group_names": group_names.select("library_id", "group_id", "name", "updated_at"),
        "denials": denials.select("library_id", "video_id", "person_id"),
    }
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/v{VERSION}/{name}")


def read_bundle(spark: SparkSession, path: str, version: int = VERSION) -> dict[str, DataFrame]:
    return {name: spark.read.schema(ddl).json(f"{path}/v{version}/{name}")
            for name, ddl in SECTIONS.items()}


def import_persons(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Persons after an import.

    A library with no persons takes the incoming rows with their ids. Elsewhere
    ids mean nothing: an incoming name lands only on the unnamed cluster that was
    itself suggested that name, and only if no verified person bears it already.
    """
    known = local.select("library_id").distinct()
    restored = incoming.join(known, "library_id", "left_anti").select(
        "library_id", "id", "name", F.lit("").alias("suggested_name"), "verified")
    taken = (local.where(F.col("verified") & (F.trim("name") != ""))
             .select("library_id", F.lower("name").alias("_k")).distinct())
    offers = (incoming.where(F.trim("name") != "")
              .groupBy("library_id", F.lower("name").alias("_k"))
              .agg(F.max_by("name", "id").alias("_offer"))
              .join(taken, ["library_id", "_k"], "left_anti"))
    open_to = F.when((F.trim("name") == "") & (F.trim("suggested_name") != ""), F.lower("suggested_name"))
    # Of several clusters suggested the same name only the last is renamed.
    adopts = (local.withColumn("_k", open_to).where(F.col("_k").isNotNull())
              .groupBy("library_id", "_k").agg(F.max("id").alias("id"))
              .join(offers, ["library_id", "_k"]).select("library_id", "id", "_offer"))
    merged = local.join(adopts, ["library_id", "id"], "left").select(
        "library_id", "id", F.coalesce("_offer", "name").alias("name"), "suggested_name",
        (F.col("verified") | F.col("_offer").isNotNull()).alias("verified"))
    return merged.unionByName(restored)


def import_denials(local_persons: DataFrame, local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Denials name person ids, so they are kept only where the ids were restored verbatim."""
    known = local_persons.select("library_id").distinct()
    return local.unionByName(incoming.join(known, "library_id", "left_anti")).distinct()


def import_group_names(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Names already chosen here are never overwritten."""
    fresh = (incoming.where(F.trim("group_id") != "")
             .join(local.select("library_id", "group_id"), ["library_id", "group_id"], "left_anti")
             .groupBy("library_id", "group_id").agg(
                 F.min_by("name", F.struct("updated_at", "name")).alias("name"),
                 F.min("updated_at").alias("updated_at")))
    return local.unionByName(fresh.select(*local.columns))


def import_events(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Events append. A viewer's new rows are numbered by time after the largest row id there is.

    Numbers follow the events themselves, so a task run again gives the same ones. They are counted per viewer and day
    and ranked inside a day only.
    """
    last = local.agg(F.coalesce(F.max("row_id"), F.lit(0)).alias("_last"))
    days = incoming.withColumn("_day", F.floor(F.col("at_ms") / F.lit(86_400_000)))
    before = Window.partitionBy("viewer_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.groupBy("viewer_id", "_day").agg(F.count("*").alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("viewer_id", "_day").orderBy("at_ms", "library_id", "video_id", "completion", "skipped", "hour_of_day")
    # A one-row table: the cross join is a broadcast of a single number.
    fresh = days.withColumn("_in", F.row_number().over(inside)).join(starts, ["viewer_id", "_day"]).crossJoin(F.broadcast(last)).select(
        (F.col("_last") + F.col("_start") + F.col("_in")).alias("row_id"), "viewer_id",
        "library_id", "video_id", F.timestamp_millis("at_ms").alias("at"), "completion",
        "skipped", "hour_of_day")
    return local.unionByName(fresh)


def import_favorites(clips: DataFrame, favorites: DataFrame) -> DataFrame:
    named = favorites.select("library_id", "id").distinct().withColumn("_fav", F.lit(True))
    return (clips.join(named, ["library_id", "id"], "left")
            .withColumn("is_favorite", F.col("is_favorite") | F.coalesce("_fav", F.lit(False)))
            .drop("_fav"))


def import_dismissals(local: DataFrame, incoming: DataFrame) -> DataFrame:
    return local.unionByName(incoming).distinct()


def import_report(bundle: dict[str, DataFrame]) -> DataFrame:
    """Rows per section of a bundle: ``(section, rows)``."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("section"), "rows")
              for name, df in bundle.items()]
    return reduce(DataFrame.unionByName, counts)
