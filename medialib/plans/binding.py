"""Maps the shared test tables onto the library's own tables.

The statements are plain SQL kept as text, because the checking engine runs the
same text; ``{documents}`` and the like stand for the source tables. Views that
need a position inside a language are built with ``sliced_position`` here, so
the Spark side never sorts a whole language in one task.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialib.functions.ranking import sliced_position
from medialib.functions.text import UNICODE_BREAK
from medialib.operators.fingerprints import simhash64
from medialib.session import configure, settle

AS_OF = 1706659200  # 2024-01-31 00:00 UTC

CLIPS_BASE = """
SELECT d.lang AS library_id, d.doc_id AS id,
  CASE d.doc_id % 6 WHEN 0 THEN 'VID_20' || CAST(d.doc_id AS STRING) || '.mp4'
    WHEN 1 THEN 'screenrecording_' || CAST(d.doc_id AS STRING) || '.mp4'
    WHEN 2 THEN 'anna_cake_' || CAST(d.doc_id AS STRING) || '.mp4'
    WHEN 3 THEN 'beach_day_' || CAST(d.doc_id AS STRING) || '.mp4'
    WHEN 4 THEN 'omar-football.' || CAST(d.doc_id AS STRING) || '.mov'
    ELSE 'clip ' || CAST(d.doc_id AS STRING) END AS display_name,
  CASE CAST(floor(d.n_chars / 1000.0) AS BIGINT) % 5 WHEN 0 THEN 'Camera' WHEN 1 THEN 'WhatsApp Video'
    WHEN 2 THEN 'Summer Trip' WHEN 3 THEN 'Downloads' ELSE 'Anna' END AS folder_name,
  d.n_chars * 20 AS duration_ms, d.n_chars * 1024 AS size_bytes,
  1704067200 - d.n_chars * 3600 - d.doc_id % 3600 AS date_added_sec,
  CASE d.doc_id % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1080 ELSE 1280 END AS width,
  CASE d.doc_id % 3 WHEN 0 THEN 1080 WHEN 1 THEN 2400 ELSE 720 END AS height,
  CASE WHEN d.source = 'src0' THEN 'unknown' WHEN d.source = 'src1' THEN 'music'
    WHEN d.source = 'src2' THEN 'sport' ELSE d.source END AS category,
  d.source || ',t' || CAST(d.doc_id % 7 AS STRING) || ',u' || CAST(d.doc_id % 5 AS STRING) AS tags,
  CASE WHEN d.doc_id % 9 = 0 THEN '' ELSE 'Video • ' || d.source END AS about,
  CAST((d.doc_id * 7 % 10) / 10.0 AS DOUBLE) AS confidence,
  CAST(d.doc_id % 3 AS INT) AS brain_level,
  CAST(CASE WHEN l.toxic = 1 THEN 0.9 WHEN l.quality = 0 THEN 0.6 WHEN l.quality = 1 THEN 0.1 ELSE 0.3 END AS DOUBLE) AS junk_score,
  CAST(CASE WHEN d.doc_id % 4 = 0 THEN d.doc_id % 3 + 1 ELSE 0 END AS INT) AS face_count,
  CAST(CASE WHEN d.doc_id % 8 = 0 THEN 1 ELSE 0 END AS INT) AS smile_count,
  CAST(d.n_chars % 500 AS DOUBLE) AS sharpness,
  CAST(CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id % 7 ELSE -1 END AS INT) AS person_id,
  d.doc_id % 11 = 0 AS is_favorite,
  CASE WHEN d.doc_id % 97 = 0 THEN 'keepers' ELSE '' END AS manual_group,
  CAST(CASE WHEN d.doc_id % 29 = 0 THEN 1 ELSE -1 END AS BIGINT) AS album_id,
  CASE d.doc_id % 5 WHEN 0 THEN 'speaking,expressive' WHEN 1 THEN 'mostly music or ambience'
    WHEN 2 THEN 'partly speaking' WHEN 3 THEN 'speaking,flat delivery' ELSE '' END AS prosody_tags,
  CAST((d.doc_id % 100) / 100.0 AS DOUBLE) AS speech_ratio,
  CASE WHEN d.source = 'src3' THEN NULL ELSE d.text END AS transcript
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

PHOTOS_BASE = """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS library_id,
  p_partkey AS id, replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) || '.jpg' AS display_name,
  CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_brand END AS folder_name,
  1704067200 - (p_partkey * 7919 % 700) * 86400 AS date_added_sec,
  CASE WHEN p_size % 3 = 0 THEN 1080 ELSE 4000 END AS width, CASE WHEN p_size % 3 = 0 THEN 2400 ELSE 3000 END AS height,
  CASE WHEN p_type = 'PROMO' THEN 'unknown' ELSE lower(p_type) END AS category,
  replace(p_name, ' ', ',') AS tags,
  CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'Photo of ' || p_name END AS about,
  CAST((p_size % 10) / 10.0 AS DOUBLE) AS confidence,
  CAST(p_size % 2 AS INT) AS brain_level,
  CAST(CASE WHEN p_size % 10 = 0 THEN 0.9 ELSE 0.2 END AS DOUBLE) AS junk_score,
  CAST(p_size % 3 AS INT) AS face_count, CAST(CASE WHEN p_size % 6 = 0 THEN 1 ELSE 0 END AS INT) AS smile_count,
  p_partkey % 13 = 0 AS is_favorite, p_size % 7 = 0 AS animated, md5(p_name) AS phash_src, p_size % 8 AS phash_flip
FROM {part}
"""

VECTORS = """
SELECT d.lang AS library_id, e.vec_id AS id, d.doc_id AS video_id,
  CAST(CASE WHEN e.vec_id % 5 = 0 THEN -1 ELSE e.label END AS INT) AS person_id,
  CAST(((e.vec_id * 37) % 100) / 100.0 AS DOUBLE) AS quality, e.embedding AS vec
FROM {embeddings} e CROSS JOIN (SELECT count(*) AS n FROM {documents}) c JOIN {documents} d ON d.doc_id = e.vec_id % c.n
"""

PERSONS = """
SELECT l.library_id, CAST(p.label AS INT) AS id,
  CASE WHEN p.label % 3 = 0 THEN 'Anna' ELSE '' END AS name,
  CASE WHEN p.label % 3 = 1 THEN 'Omar' WHEN p.label % 3 = 2 THEN 'Sara' ELSE '' END AS suggested_name,
  p.label % 3 = 0 AS verified, p.label = 5 AS split_suggested, p.label = 4 AS split_silenced
FROM (SELECT DISTINCT lang AS library_id FROM {documents}) l CROSS JOIN (SELECT DISTINCT label FROM {embeddings}) p
"""

DENIALS = """
SELECT d.lang AS library_id, d.doc_id AS video_id, CAST(e.label AS INT) AS person_id
FROM {embeddings} e CROSS JOIN (SELECT count(*) AS n FROM {documents}) c JOIN {documents} d ON d.doc_id = e.vec_id % c.n
WHERE e.vec_id % 10 = 0
"""

DETECTIONS = """
SELECT l_orderkey AS media_id, l_linenumber AS box_no, CAST(floor(l_quantity * 5) AS INT) AS w,
  CAST(floor(l_extendedprice) AS BIGINT) % 300 AS h, CAST(l_discount * 200 AS DOUBLE) AS sharpness
FROM {lineitem}
"""

ACOUSTIC_WINDOWS = """
SELECT user_id AS clip_id, event_id AS window_no, -60.0 + value / 6.0 AS db, CAST((event_id % 10) / 10.0 AS DOUBLE) AS voiced,
  CASE WHEN 60.0 + value > 400.0 THEN NULL ELSE 60.0 + value END AS pitch_hz FROM {events}
"""

LABEL_ROWS = """
SELECT media_id, pos, label, CAST(((media_id * 31 + pos * 23) % 60 + 40) / 100.0 AS DOUBLE) AS conf
FROM (SELECT p_partkey AS media_id, {words} FROM {part})
UNION ALL
SELECT p_partkey, 9, CASE p_partkey % 5 WHEN 0 THEN 'Dog' WHEN 1 THEN 'Beach' WHEN 2 THEN 'Birthday Cake' WHEN 3 THEN 'Dress' ELSE 'Guitar' END,
  CAST((p_partkey * 17 % 60 + 40) / 100.0 AS DOUBLE) FROM {part}
"""

LISTING_NEW = """
SELECT library_id, id, display_name, folder_name, duration_ms,
  CASE WHEN id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, date_added_sec, width, height
FROM ({clips_base}) WHERE id % 10 <> 1 AND NOT (library_id = 'es' AND id % 5 <> 0)
UNION ALL
SELECT library_id, id + 1000000, display_name, folder_name, duration_ms, size_bytes, date_added_sec, width, height
FROM ({clips_base}) WHERE id % 20 = 0
"""

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class Binding:
    """The library's tables, read from one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir.rstrip("/")
        self._stored: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{table}.parquet")

    def _sql(self, text: str, **extra) -> DataFrame:
        names = {t: f"parquet.`{self.dir}/{t}.parquet`" for t in TABLES}
        return self.spark.sql(text.format(**names, **extra))

    def clips(self) -> DataFrame:
        """Clips without fingerprints: enough for every operator that never compares content."""
        return self._sql(CLIPS_BASE)

    def _fingerprints(self) -> DataFrame:
        """Stored fingerprints of the clips, written once like any other column of a library."""
        docs = self.raw("documents").select("doc_id", "text")
        return simhash64(docs, "doc_id", "text", UNICODE_BREAK, 2).select(
            F.col("doc_id").alias("id"), "phash")

    def clips_hashed(self) -> DataFrame:
        return (self.clips().join(self.fingerprints(), "id", "left")
                .withColumn("phash", F.coalesce("phash", F.lit(0).cast("bigint"))))

    def photos(self) -> DataFrame:
        """Photos; names repeat, so fingerprints of one name sit 0 or 2 bits apart."""
        hex60 = F.conv(F.substring("phash_src", 2, 15), 16, 10).cast("bigint")
        flip = F.expr("shiftleft(1L, CAST(phash_flip AS INT))")
        return (self._sql(PHOTOS_BASE).withColumn("phash", hex60.bitwiseXOR(flip))
                .drop("phash_src", "phash_flip"))

    def _positioned_docs(self) -> tuple[DataFrame, DataFrame]:
        docs = self.raw("documents").select("doc_id", "lang")
        sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
        return sliced_position(docs, ["lang"], "doc_id", 100_000, "i"), sizes

    def _event_clips(self, events: DataFrame) -> DataFrame:
        docs, sizes = self._positioned_docs()
        # A third of a viewer's events are in the next library.
        home = (F.col("user_id") + (F.col("event_id") % 3 == 0).cast("int")) % 4
        lang = F.when(home == 0, "de").when(home == 1, "en").when(home == 2, "es").otherwise("fr")
        keyed = (events.withColumn("lang", lang).join(sizes, "lang")
                 .withColumn("i", (F.col("event_id") * 7919) % F.col("n")).drop("n"))
        return keyed.join(docs, ["lang", "i"])

    def _store(self, name: str, make) -> DataFrame:
        """Tables a library keeps on disk are written once per binding, then read."""
        if name not in self._stored:
            self._stored[name] = settle(make(), name)
        return self._stored[name]

    def watch_events(self) -> DataFrame:
        return self._store("watch_events", self._watch_events)

    def dismissals(self) -> DataFrame:
        return self._store("dismissals", self._dismissals)

    def fingerprints(self) -> DataFrame:
        return self._store("phash", self._fingerprints)

    def _watch_events(self) -> DataFrame:
        events = self.raw("events").where(F.col("event_type").isin("view", "click"))
        share = F.col("value") / 100.0
        return self._event_clips(events).select(
            F.col("event_id").alias("row_id"), F.col("user_id").alias("viewer_id"),
            F.col("lang").alias("library_id"), F.col("doc_id").alias("video_id"),
            F.col("ts").cast("timestamp").alias("at"),
            F.least(share, F.lit(1.0)).cast("double").alias("completion"),
            (share < 0.15).alias("skipped"), F.hour("ts").cast("int").alias("hour_of_day"))

    def _dismissals(self) -> DataFrame:
        events = self.raw("events").where(
            (F.col("event_type") == "error") & (F.col("event_id") % 20 == 0))
        return self._event_clips(events).select(
            F.col("lang").alias("library_id"), F.col("doc_id").alias("video_id")).distinct()

    def vectors(self) -> DataFrame:
        return self._store("vectors", lambda: self._sql(VECTORS).withColumn(
            "vec", F.col("vec").cast("array<double>")))

    def persons(self) -> DataFrame:
        return self._store("persons", lambda: self._sql(PERSONS))

    def denials(self) -> DataFrame:
        return self._store("denials", lambda: self._sql(DENIALS))

    def detections(self) -> DataFrame:
        return self._sql(DETECTIONS)

    def acoustic_windows(self) -> DataFrame:
        return self._sql(ACOUSTIC_WINDOWS)

    def label_rows(self) -> DataFrame:
        return self._sql(LABEL_ROWS, words="posexplode(split(p_name, ' ')) AS (pos, label)")

    def listing_new(self) -> DataFrame:
        inner = CLIPS_BASE.format(documents="{documents}", labels="{labels}")
        return self._sql(LISTING_NEW.replace("{clips_base}", inner))

    def albums(self) -> DataFrame:
        """Album 1 has members, album 2 is empty, in every library."""
        libs = self.raw("documents").select(F.col("lang").alias("library_id")).distinct()
        row = F.struct
        made = F.array(
            row(F.lit(1).cast("bigint").alias("id"), F.lit("Road movies").alias("name"),
                F.lit(1).cast("bigint").alias("created_at")),
            row(F.lit(2).cast("bigint").alias("id"), F.lit("Later").alias("name"),
                F.lit(2).cast("bigint").alias("created_at")))
        return libs.select("library_id", F.inline(made))

    def search_queries(self) -> DataFrame:
        """Each user turn as one query of the library ``conv_id % 4``."""
        lib = (F.when(F.col("conv_id") % 4 == 0, "de").when(F.col("conv_id") % 4 == 1, "en")
               .when(F.col("conv_id") % 4 == 2, "es").otherwise("fr"))
        return self.raw("conversations").where(F.col("role") == "user").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), lib.alias("library_id"),
            "text", (F.col("conv_id") % 50).alias("viewer_id"), F.col("turn").alias("at"))

