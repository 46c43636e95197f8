"""Catalogue, reconciliation and maintenance."""

from oracles.views import category_case, clip_junk, photo_junk, title, with_views

_LISTING = """listing AS (SELECT library_id, id, CASE WHEN id % 17 <> 0 THEN display_name END AS display_name,
  CASE WHEN id % 19 = 0 THEN NULL WHEN id % 23 = 0 THEN '/' ELSE 'DCIM/' || folder_name || '/' END AS relative_path,
  CASE WHEN id % 31 <> 0 THEN duration_ms END AS duration_ms, size_bytes, date_added_sec,
  CASE WHEN id % 29 <> 0 THEN width END AS width, height FROM listing_new)"""

_PHOTO_LISTING = """plisting AS (SELECT
  CASE p_partkey % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS library_id, p_partkey AS id,
  CASE WHEN p_partkey % 17 <> 0 THEN replace(p_name, ' ', '_') || '_' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '.GIF' ELSE '.jpg' END END AS display_name,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'Pictures/Beach trip/' ELSE 'Pictures/' || p_brand END AS relative_path,
  1704067200 - (p_partkey * 7919 % 700) * 86400 AS date_added_sec,
  CASE WHEN p_size % 3 = 0 THEN 1080 ELSE 4000 END AS width, CASE WHEN p_size % 3 = 0 THEN 2400 ELSE 3000 END AS height,
  CASE WHEN p_partkey % 5 = 0 THEN 'image/webp' ELSE 'image/jpeg' END AS mime FROM part),
pbase AS (SELECT library_id, id, display_name, regexp_extract(rtrim(coalesce(relative_path, ''), '/'), '[^/]*$') AS folder_name,
  date_added_sec, width, height, mime IN ('image/gif', 'image/webp') OR lower(display_name) LIKE '%.gif' AS animated
  FROM plisting WHERE display_name IS NOT NULL),
pcat AS (SELECT *, """ + category_case("display_name") + " AS n, " + category_case("folder_name") + """ AS f FROM pbase),
prows AS (SELECT *, coalesce(n, f, 'unknown') AS category,
  CASE WHEN n IS NULL AND f IS NULL THEN '' WHEN n IS NULL THEN f WHEN f IS NULL OR n = f THEN n ELSE n || ',' || f END AS tags,
  CASE WHEN n IS NULL AND f IS NULL THEN '' WHEN folder_name = '' THEN """ + title("coalesce(n, f)") + " ELSE " \
    + title("coalesce(n, f)") + """ || ' • ' || folder_name END AS about,
  CASE WHEN n IS NOT NULL THEN 0.85 WHEN f IS NOT NULL THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence,
  round(""" + photo_junk() + """, 6) AS junk_score FROM pcat)"""

_DIFF = """diff AS (SELECT coalesce(o.library_id, s.library_id) AS library_id, coalesce(o.id, s.id) AS id,
  CASE WHEN o.id IS NULL THEN 'new' WHEN s.id IS NULL THEN 'gone'
    WHEN o.display_name IS DISTINCT FROM s.display_name OR o.duration_ms IS DISTINCT FROM s.duration_ms
      OR o.size_bytes IS DISTINCT FROM s.size_bytes OR o.folder_name IS DISTINCT FROM s.folder_name
      OR o.width IS DISTINCT FROM s.width OR o.height IS DISTINCT FROM s.height THEN 'changed' ELSE 'unchanged' END AS status
  FROM clips o FULL OUTER JOIN listing_new s ON s.library_id = o.library_id AND s.id = o.id),
guard AS (SELECT library_id, count(*) FILTER (WHERE status <> 'new') AS existing, count(*) FILTER (WHERE status <> 'gone') AS seen
  FROM diff GROUP BY 1)"""

_AFTER = """seen AS (SELECT * FROM prows WHERE id % 10 <> 3), had AS (SELECT * FROM photos WHERE id % 20 <> 7),
after AS (SELECT p.library_id, p.id, p.display_name, p.folder_name, p.date_added_sec, p.width::BIGINT AS width, p.height::BIGINT AS height,
    p.category, p.tags, p.about, round(p.confidence, 6) AS confidence, round(p.junk_score, 6) AS junk_score,
    p.brain_level::BIGINT AS brain_level, p.face_count::BIGINT AS face_count, p.smile_count::BIGINT AS smile_count, p.phash,
    p.is_favorite, p.animated FROM had p JOIN seen USING (library_id, id)
  UNION ALL SELECT library_id, id, display_name, folder_name, date_added_sec, width, height, category, tags, about, confidence,
    junk_score, 0, 0, 0, 0, false, animated FROM (SELECT s.* FROM seen s LEFT JOIN had p USING (library_id, id) WHERE p.id IS NULL))"""


def _also(base: str, *ctes: str) -> str:
    """Append further CTEs to a WITH clause built by with_views (body starts after them)."""
    head, body = base.split("\n@@", 1)
    return head + ",\n" + ",\n".join(ctes) + "\n" + body


def _w(body, views, *ctes):
    if not views:
        return "WITH " + ",\n".join(ctes) + "\n" + body
    return _also(with_views("@@" + body, *views), *ctes) if ctes else with_views(body, *views)


_NAME_TOKENS = r"list_filter(string_split(regexp_replace(lower(regexp_replace(display_name, '\.[^.]*$', '')), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda t: length(t) > 2)"

_RECONCILED = f"""
      SELECT c.library_id, c.id, CASE WHEN status = 'changed' THEN s.display_name ELSE c.display_name END AS display_name,
        CASE WHEN status = 'changed' THEN s.folder_name ELSE c.folder_name END AS folder_name,
        CASE WHEN status = 'changed' THEN s.duration_ms ELSE c.duration_ms END AS duration_ms,
        CASE WHEN status = 'changed' THEN s.size_bytes ELSE c.size_bytes END AS size_bytes, c.date_added_sec,
        CASE WHEN status = 'changed' THEN s.width ELSE c.width END::BIGINT AS width,
        CASE WHEN status = 'changed' THEN s.height ELSE c.height END::BIGINT AS height, c.category, c.tags, c.about,
        round(c.confidence, 6) AS confidence, round(c.junk_score, 6) AS junk_score, c.brain_level::BIGINT AS brain_level,
        c.face_count::BIGINT AS face_count, c.smile_count::BIGINT AS smile_count, c.person_id::BIGINT AS person_id, c.album_id,
        round(c.sharpness, 6) AS sharpness, round(c.speech_ratio, 6) AS speech_ratio, c.is_favorite, c.manual_group,
        c.prosody_tags, c.transcript
      FROM clips c JOIN diff d USING (library_id, id) JOIN guard g USING (library_id)
      LEFT JOIN listing_new s ON s.library_id = c.library_id AND s.id = c.id
      WHERE status <> 'gone' OR (existing > 0 AND seen < existing // 2)
      UNION ALL SELECT library_id, id, display_name, folder_name, duration_ms, size_bytes, date_added_sec, width, height,
        coalesce(n, f, 'unknown'),
        array_to_string(CASE WHEN n IS NULL AND f IS NULL THEN t6[1:5] ELSE (CASE WHEN list_contains(t6, coalesce(n, f))
          THEN t6 ELSE list_append(t6, coalesce(n, f)) END)[1:8] END, ','),
        coalesce({title('coalesce(n, f)')}, CASE WHEN duration_ms < 20000 THEN 'Quick clip' ELSE 'Video' END) || ' • ' || folder_name,
        CASE WHEN n IS NOT NULL THEN 0.85 WHEN f IS NOT NULL THEN 0.7 ELSE 0.35 END, junk, 0, 0, 0, -1, -1, 0.0, 0.0, false, '',
        '', NULL
      FROM (SELECT s.*, {category_case('display_name')} AS n, {category_case('folder_name')} AS f,
        (list_filter({_NAME_TOKENS}, lambda x, i: list_position({_NAME_TOKENS}, x) = i))[1:6] AS t6,
        round({clip_junk()}, 6) AS junk FROM listing_new s) s JOIN diff USING (library_id, id) WHERE status = 'new'"""


def _named(text: str) -> str:
    """The same with the rows a change feed named in place of the whole listing."""
    return text.replace("listing_new s", "named s")


SQL = {
    "catalog_clips": _w(r"""SELECT library_id, id, coalesce(display_name, 'video_' || id) AS display_name,
      coalesce(nullif(regexp_extract(trim(coalesce(relative_path, ''), '/'), '[^/]*$'), ''), 'Videos') AS folder_name,
      coalesce(duration_ms, 0)::BIGINT AS duration_ms, coalesce(size_bytes, 0)::BIGINT AS size_bytes,
      coalesce(date_added_sec, 0)::BIGINT AS date_added_sec, coalesce(width, 0)::BIGINT AS width,
      coalesce(height, 0)::BIGINT AS height FROM listing""", ["listing_new"], _LISTING),
    "catalog_photos": _w("""SELECT library_id, id, display_name, folder_name, date_added_sec, animated, category, tags,
      about, confidence, junk_score FROM prows""", [], _PHOTO_LISTING),
    "delta_read": with_views("""SELECT library_id, id, display_name, size_bytes FROM listing_new WHERE id % 13 = 0""",
                             "listing_new"),
    "recent_events": with_views("""SELECT viewer_id, row_id, video_id, rank FROM (SELECT *, row_number() OVER (
      PARTITION BY viewer_id ORDER BY "at" DESC, row_id DESC) AS rank FROM watch_events) WHERE rank <= 300""",
                                "watch_events"),
    "bundle_import_names": with_views("""
      , incoming AS (SELECT library_id, id, CASE id % 3 WHEN 0 THEN 'ANNA' WHEN 1 THEN 'omar' ELSE 'Nobody' END AS name
        FROM persons WHERE library_id <> 'fr' OR id <> 1),
      loc AS (SELECT * FROM persons WHERE library_id <> 'de'),
      taken AS (SELECT DISTINCT library_id, lower(name) AS k FROM loc WHERE verified AND name <> ''),
      offers AS (SELECT library_id, lower(name) AS k, arg_max(name, id) AS offer FROM incoming
        WHERE (library_id, lower(name)) NOT IN (SELECT (library_id, k) FROM taken) GROUP BY 1, 2),
      adopts AS (SELECT l.library_id, max(l.id) AS id, any_value(offer) AS offer FROM loc l JOIN offers o
        ON o.library_id = l.library_id AND o.k = lower(l.suggested_name) WHERE l.name = '' AND l.suggested_name <> ''
        GROUP BY l.library_id, lower(l.suggested_name))
      SELECT l.library_id, l.id::BIGINT AS id, coalesce(a.offer, l.name) AS name, l.suggested_name,
        l.verified OR a.offer IS NOT NULL AS verified
      FROM loc l LEFT JOIN adopts a ON a.library_id = l.library_id AND a.id = l.id
      UNION ALL SELECT library_id, id, name, '', true FROM incoming WHERE library_id = 'de'""", "persons"),
    "events_after": with_views("""SELECT row_id, viewer_id, library_id, video_id FROM watch_events WHERE row_id > 4000 AND "at" >= DATE '2024-01-20'""", "watch_events"),
    "bundle_import_events": with_views("""SELECT viewer_id, row_id, library_id, video_id, epoch_us("at") // 1000 AS at_ms FROM watch_events
      UNION ALL SELECT viewer_id, (SELECT max(row_id) FROM watch_events) + row_number() OVER (PARTITION BY viewer_id
        ORDER BY epoch_us("at") // 1000, library_id, video_id, completion, skipped, hour_of_day), library_id, video_id, epoch_us("at") // 1000
      FROM watch_events WHERE library_id = 'de' AND row_id % 2 = 1""", "watch_events"),
    "bundle_import_favorites": with_views("SELECT library_id, id, is_favorite OR id % 17 = 0 AS is_favorite FROM clips", "clips"),
    "bundle_import_dismissals": with_views("""SELECT library_id, video_id FROM dismissals
      UNION SELECT library_id, id FROM clips WHERE id % 23 = 0""", "dismissals", "clips"),
    "snapshot_diff_moved": with_views("SELECT library_id, id, CASE WHEN id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM clips", "clips"),
    "run_report": _w("""SELECT 'nightly' AS run, 'clips' AS stage, k.n AS rows FROM (SELECT count(*) + (SELECT count(*) FROM diff WHERE status = 'new') AS n
        FROM diff JOIN guard USING (library_id) WHERE status IN ('changed', 'unchanged') OR status = 'gone' AND existing > 0 AND seen < existing // 2) k, range(2)
      UNION ALL SELECT 'nightly', 'photos', count(*) FROM (SELECT p.*, count(*) FILTER (WHERE id % 10 <> 3) OVER w AS left_over, count(*) OVER w AS n
        FROM photos p WINDOW w AS (PARTITION BY library_id)) WHERE id % 10 <> 3 OR left_over < n // 2
      UNION ALL SELECT 'nightly', 'vectors', count(*) FROM vectors, range(2) GROUP BY range
      UNION ALL SELECT 'nightly', 'events', count(*) FROM watch_events""", ["clips", "listing_new", "photos", "vectors", "watch_events"], _DIFF),
    "snapshot_diff": _w("SELECT * FROM diff", ["clips", "listing_new"], _DIFF),
    "sweep_guard": _w("SELECT *, NOT (existing > 0 AND seen < existing // 2) AS sweep_ok FROM guard",
                      ["clips", "listing_new"], _DIFF),
    "reconciled_clips": _w(_RECONCILED, ["clips", "listing_new"], _DIFF),
    "change_feed": _w(_named(_RECONCILED).replace("WHERE status <> 'gone' OR (existing > 0 AND seen < existing // 2)", ""),
                      ["clips", "listing_new"], "named AS (SELECT * FROM listing_new WHERE id % 13 = 0)", _named(_DIFF)),
    "reconciled_photos": _w("SELECT * FROM after", ["photos"], _PHOTO_LISTING, _AFTER),
    "reconcile_then_queue": _w("""SELECT library_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY library_id
        ORDER BY date_added_sec DESC, id) AS rank FROM after WHERE brain_level < 1 AND junk_score < 0.9) WHERE rank <= 40""",
                               ["photos"], _PHOTO_LISTING, _AFTER),
    "settle_junk": with_views("""SELECT library_id, id,
      CASE WHEN brain_level < 1 AND junk_score >= 0.9 THEN 1 ELSE brain_level END::BIGINT AS brain_level,
      CASE WHEN brain_level < 1 AND junk_score >= 0.9 THEN 0 ELSE face_count END::BIGINT AS face_count,
      CASE WHEN brain_level < 1 AND junk_score >= 0.9 THEN 0 ELSE smile_count END::BIGINT AS smile_count,
      CASE WHEN brain_level < 1 AND junk_score >= 0.9 THEN 0 ELSE phash END::BIGINT AS phash FROM photos""", "photos"),
    "quarantine": with_views("""SELECT library_id, id, CASE WHEN id % 10 = 4 THEN tags || ',unreadable' ELSE tags END AS tags,
      CASE WHEN id % 10 = 4 THEN 'Could not read a frame' ELSE about END AS about,
      round(CASE WHEN id % 10 = 4 THEN 0.0 ELSE confidence END, 6) AS confidence,
      CASE WHEN id % 10 = 4 THEN 1 ELSE brain_level END::BIGINT AS brain_level,
      CASE WHEN id % 10 = 4 THEN 0 ELSE face_count END::BIGINT AS face_count,
      round(CASE WHEN id % 10 = 4 THEN greatest(junk_score, 0.5) ELSE junk_score END, 6) AS junk_score FROM clips""",
                             "clips"),
    "reset_derived": with_views("""SELECT library_id, id, 'unknown' AS category, '' AS tags, 0::BIGINT AS face_count,
      (-1)::BIGINT AS person_id, false AS is_favorite, manual_group FROM clips""", "clips"),
    "retain_events": with_views("""SELECT viewer_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY viewer_id
      ORDER BY "at" DESC, row_id DESC) AS r FROM watch_events) WHERE r <= 15""", "watch_events"),
    "retain_events_many": with_views("""SELECT viewer_id, row_id FROM (SELECT viewer_id % 3 AS viewer_id, row_id, row_number() OVER (PARTITION BY viewer_id % 3
      ORDER BY "at" DESC, row_id DESC) AS r FROM watch_events) WHERE r <= 700""", "watch_events"),
    "cascade_delete": with_views("""SELECT 'clip' AS kind, library_id, id FROM clips WHERE id % 7 <> 3
      UNION ALL SELECT 'vector', v.library_id, v.id FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM clips c
        WHERE c.library_id = v.library_id AND c.id = v.video_id AND c.id % 7 = 3)""", "clips", "vectors"),
    "library_stats": with_views("""SELECT c.library_id, total, memories, clutter, understood_pct, pending,
      coalesce(people, 0) AS people, coalesce(flagged, 0) AS flagged, coalesce(vectors, 0) AS vectors,
      coalesce(unassigned, 0) AS unassigned
      FROM (SELECT library_id, count(*) AS total, count(*) FILTER (WHERE junk_score < 0.5) AS memories,
        count(*) FILTER (WHERE junk_score >= 0.5) AS clutter,
        count(*) FILTER (WHERE brain_level >= 1) * 100 // count(*) AS understood_pct,
        count(*) FILTER (WHERE brain_level < 1) AS pending FROM clips GROUP BY 1) c
      LEFT JOIN (SELECT library_id, count(*) AS people, count(*) FILTER (WHERE split_suggested) AS flagged FROM persons GROUP BY 1) p USING (library_id)
      LEFT JOIN (SELECT library_id, count(*) AS vectors, count(*) FILTER (WHERE person_id < 0) AS unassigned FROM vectors GROUP BY 1) v USING (library_id)""",
                                "clips", "persons", "vectors"),
    "threshold_preview": with_views("""SELECT library_id, jt AS junk_threshold, mc AS min_clips,
      count(*) FILTER (WHERE junk_score < jt) AS memories, count(*) FILTER (WHERE junk_score >= jt) AS clutter,
      any_value((SELECT count(*) FROM (SELECT person_id FROM clips p WHERE p.library_id = clips.library_id AND person_id >= 0
        GROUP BY 1 HAVING count(*) >= mc))) AS people,
      count(*) FILTER (WHERE face_count > 0 AND person_id < 0) AS unplaced,
      count(*) FILTER (WHERE category = 'unknown' OR confidence < 0.6 OR brain_level < 2) AS semantic_owed
      FROM clips, (VALUES (0.3::DOUBLE, 2::BIGINT), (0.5, 10), (0.8, 20)) t(jt, mc) GROUP BY 1, 2, 3""", "clips"),
    "bundle_export": with_views("""SELECT 'persons' AS section, count(*) AS rows FROM persons UNION ALL SELECT 'watch_events', count(*) FROM watch_events
      UNION ALL SELECT 'favorites', count(*) FROM clips WHERE is_favorite UNION ALL SELECT 'dismissals', count(*) FROM dismissals
      UNION ALL SELECT 'group_names', count(*) FROM persons UNION ALL SELECT 'denials', count(*) FROM denials""",
                                "persons", "watch_events", "clips", "dismissals", "denials"),
    "bundle_import_denials": with_views("""SELECT DISTINCT library_id, video_id, person_id::BIGINT AS person_id FROM denials
      WHERE library_id = 'de' OR person_id < 5""", "denials"),
    "schema_evolution": with_views("""SELECT library_id, id, CASE WHEN id % 2 = 0 THEN '' ELSE prosody_tags END AS prosody_tags,
      round(CASE WHEN id % 2 = 0 THEN 0.0 ELSE speech_ratio END, 6)::DOUBLE AS speech_ratio,
      CASE WHEN id % 2 = 0 THEN -1 ELSE album_id END::BIGINT AS album_id, 0::BIGINT AS phash, category FROM clips""", "clips"),
}
