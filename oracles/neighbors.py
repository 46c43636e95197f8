"""Neighbours, scoring every item against every other of its library."""

from oracles.dups import chained, hd


def _shared(a: str, b: str) -> str:
    return f"least(1.0, 0.25::DOUBLE * len(list_intersect(string_split({a}.tags, ','), string_split({b}.tags, ','))))"


_CLIPS = f""", s AS (SELECT a.library_id, a.id AS seed, b.id, abs(a.date_added_sec - b.date_added_sec) AS gap, b.date_added_sec AS d, round(
    CASE WHEN a.person_id >= 0 AND a.person_id = b.person_id THEN 3 ELSE 0 END
    + CASE WHEN lower(a.folder_name) = lower(b.folder_name) AND abs(a.date_added_sec - b.date_added_sec) < 259200 THEN 2 ELSE 0 END
    + CASE WHEN a.category = b.category AND a.category <> 'unknown' THEN 1.5::DOUBLE ELSE 0 END
    + CASE WHEN a.phash <> 0 AND b.phash <> 0 AND {hd('a.phash', 'b.phash')} <= 10 THEN 1 ELSE 0 END + {_shared('a', 'b')}, 6) AS score
    FROM clips_h a JOIN clips_h b ON a.library_id = b.library_id AND a.id <> b.id),
  cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY library_id, seed ORDER BY score DESC, gap, d DESC, id) AS r FROM s WHERE score > 0) WHERE r <= 12)"""


def _photos(src: str, odd: bool) -> str:
    tags = lambda x: f"CASE WHEN {x}.tags = '' THEN [] ELSE string_split({x}.tags, ',') END"
    return f""", s AS (SELECT a.library_id, a.id AS seed, b.id, abs(a.date_added_sec - b.date_added_sec) AS gap, b.date_added_sec AS d, round(
    CASE WHEN trim(a.folder_name) <> '' AND lower(a.folder_name) = lower(b.folder_name) AND abs(a.date_added_sec - b.date_added_sec) < 259200 THEN 2 ELSE 0 END
    + CASE WHEN a.category = b.category AND a.category <> 'unknown' THEN 1.5::DOUBLE ELSE 0 END
    + CASE WHEN a.phash <> 0 AND b.phash <> 0 AND {hd('a.phash', 'b.phash')} <= 10 THEN 1 + (10 - {hd('a.phash', 'b.phash')}) / 10.0::DOUBLE ELSE 0 END
    + CASE WHEN a.animated AND b.animated THEN 0.5::DOUBLE ELSE 0 END
    + least(1.0, 0.25::DOUBLE * len(list_intersect({tags('a')}, {tags('b')}))), 6) AS score
    FROM {src} a JOIN {src} b ON a.library_id = b.library_id AND a.id <> b.id),
  cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY library_id, seed ORDER BY score DESC, gap, d DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 12)"""


_ODD = """, odd AS (SELECT library_id, id, folder_name, date_added_sec, CASE WHEN id % 9 = 4 THEN 'unknown' ELSE category END AS category,
  CASE WHEN id % 9 = 4 THEN '' ELSE tags END AS tags, animated AND id % 9 <> 4 AS animated, CASE WHEN id % 9 = 4 THEN 0 ELSE phash END AS phash FROM photos)"""

SQL = {
    "similar_clips": chained(_CLIPS, """SELECT library_id, seed, id, score, row_number() OVER (PARTITION BY library_id, seed
      ORDER BY score DESC, ('0x' || substr(md5('5|' || id), 1, 15))::BIGINT, id) AS rank FROM cut""", "clips_h"),
    "similar_photos": chained(_photos("photos", False), "SELECT library_id, seed, id, rank, score FROM cut", "photos"),
    "similar_photos_fallback": chained(_ODD + _photos("odd", True), """SELECT library_id, seed, id, rank FROM (
      SELECT a.library_id, a.id AS seed, b.id, row_number() OVER (PARTITION BY a.library_id, a.id ORDER BY abs(a.date_added_sec - b.date_added_sec), b.date_added_sec DESC, b.id) AS rank
      FROM odd a JOIN odd b ON a.library_id = b.library_id AND a.id <> b.id AND trim(a.folder_name) <> '' AND lower(a.folder_name) = lower(b.folder_name)
      WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.library_id = a.library_id AND c.seed = a.id)) WHERE rank <= 12""", "photos"),
}
