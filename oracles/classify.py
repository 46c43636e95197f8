"""Classification, features and queues."""

from oracles.catalog import _NAME_TOKENS
from oracles.views import AS_OF, category_case, clip_junk, in_order, photo_junk, title, with_views

_FAVS = """, fav AS (SELECT library_id, id AS video_id FROM clips WHERE is_favorite),
  attention AS (SELECT library_id, video_id, least(3.0, sum(step)) AS attention FROM (
    SELECT library_id, video_id, 1.0::DOUBLE AS step FROM watch_events WHERE NOT skipped
    UNION ALL SELECT library_id, video_id, 1.5 FROM fav) GROUP BY 1, 2)"""
_PRIORITY = """least(1.0, greatest(0.0, 0.4 * least(1.0, greatest(0.0, 1 - junk_score))
  + CASE WHEN category = 'unknown' THEN 0.2 ELSE 0 END + CASE WHEN face_count > 0 THEN 0.2 ELSE 0 END
  + CASE WHEN duration_ms > 60000 THEN 0.1 ELSE 0 END + 0.1 * least(1.0, duration_ms / 600000.0)))::DOUBLE"""
_OWES = "(category = 'unknown' OR confidence < 0.6)"
_LINE = r"""regexp_replace(trim(regexp_replace(coalesce(transcript, ''), '\s+', ' ', 'g')), '[ .,…]*[.,…]$', '')"""
_NORM = r"trim(regexp_replace(lower(trim({0})), '\s+', '_', 'g'), '_')"


def _queue(where: str, order: str, limit: int, table: str, extra: str = "", joins: str = "") -> str:
    return f"""SELECT library_id, id, rank{extra} FROM (SELECT m.*, row_number() OVER (PARTITION BY m.library_id
      ORDER BY {order}) AS rank FROM {table} m {joins} WHERE {where}) WHERE rank <= {limit}"""


def _median(value: str, where: str) -> str:
    return f"list_sort(list({value}) FILTER (WHERE {where}))[(count(*) FILTER (WHERE {where})) // 2 + 1]"


_SPEECH = "(db BETWEEN -46 AND -4 AND voiced >= 0.16)"

SQL = {
    "classify_names": with_views(f"""SELECT library_id, id, coalesce(n, f, 'unknown') AS category,
      coalesce({title('coalesce(n, f)')}, CASE WHEN duration_ms < 20000 THEN 'Quick clip' ELSE 'Video' END) || ' • ' || folder_name AS about,
      CASE WHEN n IS NOT NULL THEN 0.85 WHEN f IS NOT NULL THEN 0.7 ELSE 0.35 END::DOUBLE AS confidence
      FROM (SELECT *, {category_case('display_name')} AS n, {category_case('folder_name')} AS f FROM clips)""", "clips"),
    "name_tags": with_views(f"""SELECT library_id, id, array_to_string(CASE WHEN c IS NULL THEN toks[1:5]
        ELSE ({in_order('list_append(toks, c)')})[1:8] END, ',') AS tags
      FROM (SELECT *, coalesce({category_case('display_name')}, {category_case('folder_name')}) AS c,
        ({in_order(_NAME_TOKENS)})[1:6] AS toks FROM clips)""", "clips"),
    "junk_scores": with_views(f"SELECT library_id, id, round({clip_junk()}, 6) AS junk FROM clips", "clips"),
    "photo_junk": with_views(f"SELECT library_id, id, round({photo_junk()}, 6) AS junk FROM photos", "photos"),
    "label_fusion": with_views(f"""
      , p AS (SELECT *, (id % 12)::DOUBLE AS sharpness, {category_case('display_name')} AS n, {category_case('folder_name')} AS f FROM photos),
      solid AS (SELECT l.*, {category_case('label')} AS cat, {_NORM.format('label')} AS norm,
          row_number() OVER (PARTITION BY media_id ORDER BY conf DESC, pos) AS r
        FROM label_rows l JOIN p ON p.id = l.media_id WHERE conf >= 0.6 AND NOT (sharpness > 0 AND sharpness < 8)),
      agg AS (SELECT media_id, arg_min(label, r) AS top, arg_min(norm, r) AS topn, arg_min(conf, r) AS topc,
          arg_min(cat, r) FILTER (WHERE cat IS NOT NULL) AS map, arg_min(conf, r) FILTER (WHERE cat IS NOT NULL) AS mapc,
          list(norm ORDER BY r) FILTER (WHERE r <= 5) AS first5 FROM solid GROUP BY 1),
      j AS (SELECT p.*, a.*, coalesce(n, f, map, topn, 'unknown') AS winner FROM p LEFT JOIN agg a ON a.media_id = p.id),
      t AS (SELECT *, list_filter(list_concat(coalesce(first5, []), [n, f, map, CASE WHEN winner <> 'unknown' THEN winner END]),
          lambda x: x IS NOT NULL) AS parts FROM j)
      SELECT library_id, id, winner AS category, array_to_string(({in_order('parts')})[1:6], ',') AS tags,
        CASE WHEN winner = 'unknown' THEN '' WHEN n IS NULL AND f IS NULL THEN {title("replace(top, '_', ' ')")}
          WHEN trim(folder_name) = '' THEN {title("replace(winner, '_', ' ')")}
          ELSE {title("replace(winner, '_', ' ')")} || ' • ' || folder_name END AS about,
        round(CASE WHEN n IS NOT NULL THEN 0.85 WHEN f IS NOT NULL THEN 0.7 ELSE coalesce(mapc, topc, 0.0) END, 6)::DOUBLE AS confidence
      FROM t""", "photos", "label_rows"),
    "label_merge": with_views(f"""
      , w AS (SELECT media_id, pos, replace(lower(label), ' ', '_') AS word FROM label_rows WHERE conf > 0.6),
      m AS (SELECT media_id, list(word ORDER BY pos) AS words FROM (SELECT media_id, word, min(pos) AS pos FROM w GROUP BY 1, 2) GROUP BY 1),
      j AS (SELECT c.*, words, CASE WHEN words IS NOT NULL THEN coalesce({category_case("array_to_string(words, ' ')")}, category) ELSE category END AS cat,
        list_concat(string_split(tags, ','), words) AS bothw FROM clips c LEFT JOIN m ON m.media_id = c.id)
      SELECT library_id, id, cat AS category, CASE WHEN words IS NULL THEN tags ELSE array_to_string(({in_order('bothw')})[1:12], ',') END AS tags,
        CASE WHEN words IS NULL THEN about ELSE {title('cat')} || ' • ' || array_to_string(words[1:2], ', ') END AS about,
        CASE WHEN words IS NULL THEN 0.7 ELSE 0.85 END::DOUBLE AS confidence FROM j""", "clips", "label_rows")
,
    "priority_scores": with_views(f"SELECT library_id, id, round({_PRIORITY}, 6) AS priority, {_OWES} AS pending FROM clips", "clips"),
    "needs_deeper": with_views(f"""SELECT library_id, id, CASE WHEN confidence >= 0.85 THEN false WHEN junk_score >= 0.8 THEN false
      WHEN watch_count > 0 THEN true WHEN ({AS_OF} - date_added_sec) // 86400 > 180 AND junk_score < 0.4 THEN true
      ELSE confidence < 0.6 END AS deeper FROM clips_w""", "clips_w"),
    "queue_perceptual": with_views(_queue("brain_level < 1", "date_added_sec DESC, id", 200, "clips"), "clips"),
    "queue_semantic": with_views(f"""SELECT library_id, id, rank, budget, round(priority, 6) AS priority FROM (
      SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY priority DESC, date_added_sec DESC, id) AS rank,
        greatest(25, least(250, count(*) OVER (PARTITION BY library_id))) AS budget
      FROM (SELECT *, {_PRIORITY} AS priority FROM clips WHERE {_OWES})) WHERE rank <= budget""", "clips"),
    "queue_voice": with_views(_queue("prosody_tags = '' AND face_count > 0 AND junk_score < 0.6 AND brain_level >= 1",
                                     "(speech_ratio = 0) DESC, face_count DESC, size_bytes DESC, id", 60, "clips"), "clips"),
    "queue_transcript": with_views(_FAVS + "\n" + f"""SELECT library_id, id, rank FROM (SELECT c.*, row_number() OVER (PARTITION BY c.library_id
      ORDER BY coalesce(a.attention, 0) DESC, {_PRIORITY} DESC, date_added_sec DESC, id) AS rank FROM clips c
      LEFT JOIN attention a ON a.library_id = c.library_id AND a.video_id = c.id
      WHERE transcript IS NULL AND speech_ratio >= 0.1 AND duration_ms <= 120000) WHERE rank <= 8""", "clips", "watch_events"),
    "queue_photo": with_views(_queue("brain_level < 1 AND junk_score < 0.9", "date_added_sec DESC, id", 40, "photos"), "photos"),
    "queue_counts": with_views(f"""SELECT library_id, perceptual, semantic, voice, voice_done, transcripts, photo FROM (
      SELECT library_id, count(*) FILTER (WHERE brain_level < 1) AS perceptual, count(*) FILTER (WHERE {_OWES}) AS semantic,
        count(*) FILTER (WHERE prosody_tags = '' AND face_count > 0 AND junk_score < 0.6 AND brain_level >= 1) AS voice,
        count(*) FILTER (WHERE prosody_tags <> '') AS voice_done, count(*) FILTER (WHERE transcript <> '') AS transcripts
      FROM clips GROUP BY 1) JOIN (SELECT library_id, count(*) FILTER (WHERE brain_level < 1) AS photo FROM photos GROUP BY 1) USING (library_id)""",
                               "clips", "photos"),
    "acoustic_profile": with_views(f"""
      , a AS (SELECT clip_id, count(*) AS n, count(*) FILTER (WHERE {_SPEECH}) AS speech, max(db) AS hi, min(db) AS lo,
          {_median('db', 'db IS NOT NULL')} AS mid, {_median('pitch_hz', f'{_SPEECH} AND pitch_hz IS NOT NULL')} AS pitch,
          count(pitch_hz) FILTER (WHERE {_SPEECH}) AS np, stddev_pop(pitch_hz) FILTER (WHERE {_SPEECH}) AS sd,
          list(db) AS dbs FROM acoustic_windows GROUP BY 1),
      s AS (SELECT a.clip_id, n >= 2 AS sampled, n >= 2 AND speech > 0 AS heard, speech / n::DOUBLE AS sr0, coalesce(pitch, 0) AS p0,
          CASE WHEN np >= 4 AND pitch > 0 THEN least(1.0, sd / pitch) ELSE 0 END AS pr0,
          CASE WHEN n > 2 THEN least(1.0, (hi - lo) / 40.0) ELSE 0 END AS er0,
          least(12.0, len(list_filter(dbs, lambda x: x > mid + 6)) / greatest(1.0, coalesce(d.duration_ms, 0) / 1000.0)) AS g0
        FROM a LEFT JOIN clips d ON d.id = a.clip_id),
      v AS (SELECT clip_id, sampled, CASE WHEN heard THEN sr0 ELSE 0 END::DOUBLE AS sr, CASE WHEN heard THEN p0 ELSE 0 END::DOUBLE AS p,
          CASE WHEN heard THEN pr0 ELSE 0 END::DOUBLE AS pr, CASE WHEN heard THEN er0 ELSE 0 END::DOUBLE AS er,
          CASE WHEN heard THEN g0 ELSE 0 END::DOUBLE AS g FROM s)
      SELECT clip_id, round(sr, 6) AS speech_ratio, round(p, 6) AS pitch_hz, round(pr, 6) AS pitch_range, round(er, 6) AS energy_range,
        round(g, 6) AS peaks_per_sec,
        CASE WHEN NOT sampled THEN '' WHEN sr > 0.45 THEN concat_ws(',', 'speaking',
            CASE WHEN p BETWEEN 60 AND 165 THEN 'low voice' WHEN p BETWEEN 165 AND 240 THEN 'steady voice' WHEN p >= 240 THEN 'high voice' END,
            CASE WHEN pr > 0.28 THEN 'expressive' WHEN pr < 0.1 THEN 'flat delivery' END, CASE WHEN er > 0.55 THEN 'emphatic' END,
            CASE WHEN g > 3.2 THEN 'fast talker' WHEN g BETWEEN 0.4 AND 1.6 THEN 'unhurried' END)
          WHEN sr < 0.12 THEN 'mostly music or ambience' ELSE 'partly speaking' END AS tags,
        CASE WHEN NOT sampled THEN 'audio not read' ELSE floor(sr * 100 + 1e-9)::BIGINT || '% speech, ' ||
          CASE WHEN p > 0 THEN floor(p)::BIGINT || ' Hz' ELSE 'no clear pitch' END || ', pitch range ' || floor(pr * 100 + 1e-9)::BIGINT || '%' END AS summary
      FROM v""", "acoustic_windows", "clips"),
    "requeue_unclear": with_views("""SELECT library_id, id, CASE WHEN prosody_tags LIKE '%unclear%' OR prosody_tags LIKE '%flat delivery%'
      OR (speech_ratio > 0.35 AND speech_ratio < 0.55) THEN '' ELSE prosody_tags END AS prosody_tags FROM clips""", "clips"),
    "requeue_ids": with_views("SELECT library_id, id, CASE WHEN id % 9 = 4 THEN '' ELSE prosody_tags END AS prosody_tags FROM clips", "clips"),
    "shape_transcripts": with_views(rf"""SELECT library_id, id, shaped AS line,
        len(regexp_extract_all(shaped, '[\p{{L}}\p{{Nd}}]')) >= 3 AS usable FROM (
      SELECT *, CASE WHEN length(line) <= 240 THEN line
        WHEN instr(reverse(line[1:241]), ' ') BETWEEN 1 AND 240 THEN trim(line[1:241 - instr(reverse(line[1:241]), ' ')])
        ELSE line[1:240] END AS shaped FROM (SELECT library_id, id, {_LINE} AS line FROM clips))""", "clips"),
    "fingerprint_grids": "WITH g AS (SELECT doc_id AS id, list_transform(range(72), lambda i: ('0x' || substr(md5(md5(text) || i), 1, 2))::INT) AS g FROM documents)\n"
        "SELECT id, " + " + ".join(
            f"CASE WHEN g[{y * 9 + x + 1}] > g[{y * 9 + x + 2}] THEN "
            + ("(-9223372036854775807 - 1)" if y * 8 + x == 63 else f"{1 << (y * 8 + x)}::BIGINT") + " ELSE 0 END"
            for y in range(8) for x in range(8)) + " AS phash, round(("
        + " + ".join(f"(g[{y * 9 + x + 3}] - g[{y * 9 + x + 1}]) ** 2" for y in range(8) for x in range(7))
        + ") / 56.0, 6)::DOUBLE AS sharpness FROM g",
    "text_fingerprints": with_views("SELECT id, phash FROM hashes", "hashes"),
    "detection_gate": with_views("""SELECT media_id, box_no, size_rank,
      round(0.6 * least(1.0, w * h / 409600.0) + 0.4 * least(1.0, sharpness / 400.0) + 1e-9, 6)::DOUBLE AS quality FROM (
        SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY w::BIGINT * h DESC, box_no, w DESC, sharpness DESC) AS size_rank FROM detections)
      WHERE size_rank <= 2 AND w >= 48 AND h >= 48 AND sharpness >= 8""", "detections"),
}
