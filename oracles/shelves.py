"""Shelves."""

from oracles.dups import SETS, chained
from oracles.views import AS_OF, title, with_views

_AGE = f"trunc(({AS_OF} - date_added_sec) / 86400.0)"
_MEM = f"(junk_score < 0.5 AND (is_favorite OR smile_count > 0 OR {_AGE} <= 120))"
_GEM = f"(junk_score < 0.5 AND watch_count = 0 AND {_AGE} > 180)"
_NOW = f"make_timestamp({AS_OF}::BIGINT * 1000000)"
_THEN = "make_timestamp(date_added_sec * 1000000)"
_OTD = f"(junk_score < 0.5 AND date_added_sec > 0 AND dayofyear({_THEN}) = dayofyear({_NOW}) AND year({_THEN}) <> year({_NOW}))"


def _members(where: str) -> str:
    return with_views(f"SELECT library_id, id FROM clips_w WHERE {where}", "clips_w")


_PEOPLE = """people AS (SELECT c.library_id, 'person_' || c.person_id AS group_id,
    coalesce(nullif(trim(p.name), ''), nullif(trim(p.suggested_name), ''), 'Unknown person') AS title,
    CASE WHEN p.split_suggested THEN 'might be two people'
      WHEN coalesce(p.suggested_name, '') <> '' AND p.name = '' THEN 'named "' || p.suggested_name || '" by context'
      ELSE n || ' videos' || CASE WHEN smiles > 0 THEN ' • ' || smiles || ' smiles' ELSE '' END END AS subtitle,
    n AS size, CASE WHEN coalesce(p.name, '') = '' AND (SELECT count(*) FROM persons q WHERE q.library_id = p.library_id AND q.name = ''
      AND lower(q.suggested_name) = lower(p.suggested_name) AND q.suggested_name <> '') > 1 THEN p.suggested_name END AS name_collision
  FROM (SELECT library_id, person_id, count(*) AS n, sum(smile_count)::BIGINT AS smiles FROM clips WHERE person_id >= 0 GROUP BY 1, 2 HAVING count(*) >= 2) c
  LEFT JOIN persons p ON p.library_id = c.library_id AND p.id = c.person_id)"""

_EVENTS = f"""gaps AS (SELECT *, CASE WHEN date_added_sec - lag(date_added_sec) OVER w < 259200 THEN 0 ELSE 1 END AS s FROM
    (SELECT *, lower(folder_name) AS folder FROM clips WHERE junk_score < 0.5) WINDOW w AS (PARTITION BY library_id, folder ORDER BY date_added_sec, id)),
  runs AS (SELECT *, sum(s) OVER (PARTITION BY library_id, folder ORDER BY date_added_sec, id) AS burst FROM gaps),
  bursts AS (SELECT library_id, folder, burst, count(*) AS size, min(date_added_sec) AS "first", max(date_added_sec) AS "last",
      arg_min(category, (date_added_sec, id)) AS lead FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= 2),
  events AS (SELECT library_id, folder, burst, 'event_' || folder || '_' || "first" AS group_id,
      CASE WHEN lead <> 'unknown' THEN {title('lead')} ELSE {title('folder')} END AS title, size || ' clips • ' || folder AS subtitle,
      "first", "last", size, row_number() OVER (PARTITION BY library_id ORDER BY size DESC, "first", folder) AS r FROM bursts)"""

_CATS = f"""catagg AS (SELECT library_id, cat, count(*) AS size, bool_or(trim(manual_group) <> '') AS hand,
      count(*) FILTER (WHERE confidence >= 0.5) AS sure,
      count(*) FILTER (WHERE list_contains(string_split(tags, ','), cat) OR trim(manual_group) <> '') AS agree
    FROM (SELECT *, coalesce(nullif(trim(manual_group), ''), category) AS cat FROM clips) WHERE cat <> 'unknown' GROUP BY 1, 2),
  catok AS (SELECT *, CASE WHEN hand THEN 1.0::DOUBLE ELSE agree::DOUBLE / size END AS agreement FROM catagg
    WHERE size >= 8 AND (hand OR sure::DOUBLE / size >= 0.6)),
  cats AS (SELECT library_id, 'cat_' || cat AS group_id, {title('cat')} AS title,
      size || ' videos' || CASE WHEN agreement >= 0.6 THEN '' ELSE ' • still learning' END AS subtitle, size, agreement,
      row_number() OVER (PARTITION BY library_id ORDER BY size * (0.5::DOUBLE + agreement) DESC, cat) AS rank FROM catok)"""

_ALBUMS = """albums AS (SELECT DISTINCT library_id, id, name, created_at FROM (SELECT DISTINCT library_id FROM clips),
    (VALUES (1, 'Road movies', 1), (2, 'Later', 2)) a(id, name, created_at)),
  albumg AS (SELECT a.library_id, 'album_' || a.id AS group_id, a.name AS title,
    CASE WHEN count(c.id) = 0 THEN 'empty — tick clips and add them' ELSE count(c.id) || ' clips' END AS subtitle, count(c.id) AS size
    FROM albums a LEFT JOIN clips c ON c.library_id = a.library_id AND c.album_id = a.id GROUP BY a.library_id, a.id, a.name)"""

_BASIC = f"""basic AS (SELECT library_id, g.group_id, g.kind, g.title, replace(g.sub, '#', count(*)::VARCHAR) AS subtitle, count(*) AS size
  FROM clips_w, LATERAL (SELECT unnest([
    {{'group_id': 'all', 'kind': 'ALL', 'title': 'Everything', 'sub': 'all # videos on this device · nothing hidden', 'ok': true}},
    {{'group_id': 'memories', 'kind': 'MEMORIES', 'title': 'Memories', 'sub': '# favorites, recent and smiles', 'ok': {_MEM}}},
    {{'group_id': 'gems', 'kind': 'GEMS', 'title': 'Buried gems', 'sub': '# unseen for 6+ months', 'ok': {_GEM}}},
    {{'group_id': 'otd', 'kind': 'ON_THIS_DAY', 'title': 'On this day', 'sub': 'From years past, today', 'ok': {_OTD}}},
    {{'group_id': 'favs', 'kind': 'FAVORITES', 'title': 'Favorites', 'sub': '# hand-picked', 'ok': is_favorite}},
    {{'group_id': 'unreviewed', 'kind': 'UNREVIEWED', 'title': 'Needs a look', 'sub': '# not understood yet', 'ok': brain_level < 1}},
    {{'group_id': 'junk', 'kind': 'JUNK', 'title': 'Clutter drawer', 'sub': '# memes, screenshots, downloads', 'ok': junk_score >= 0.5}}]) AS g)
  WHERE g.ok GROUP BY library_id, g.group_id, g.kind, g.title, g.sub)"""

_ALL = f""", {_PEOPLE}, {_EVENTS}, {_CATS}, {_ALBUMS}, {_BASIC},
  shelf AS (SELECT * FROM basic UNION ALL SELECT library_id, group_id, 'PEOPLE', title, subtitle, size FROM people
    UNION ALL SELECT library_id, 'people', 'PEOPLE', 'People', count(*) || ' videos • ' || sum(smile_count)::BIGINT || ' smiles', count(*) FROM clips
      WHERE junk_score < 0.5 AND face_count > 0 AND library_id NOT IN (SELECT library_id FROM clips WHERE person_id >= 0) GROUP BY library_id
    UNION ALL SELECT library_id, group_id, 'EVENT', title, subtitle, size FROM events WHERE r <= 4
    UNION ALL SELECT library_id, group_id, 'CATEGORY', title, subtitle, size FROM cats WHERE rank <= 4
    UNION ALL SELECT library_id, group_id, 'ALBUM', title, subtitle, size FROM albumg)"""
_V = ("clips_w", "persons")

SQL = {
    "shelf_sizes": chained(_ALL, "SELECT library_id, group_id, kind, subtitle, size FROM shelf", *_V),
    "shelf_members": chained(f""", {_PEOPLE}, {_EVENTS}, {_CATS},
      cw AS (SELECT * REPLACE (CASE WHEN library_id = 'fr' THEN -1 ELSE person_id END AS person_id) FROM clips_w),
      m AS (SELECT library_id, 'all' AS group_id, 'ALL' AS kind, id, date_added_sec, 0 AS smiles, 0 AS faces FROM cw
        UNION ALL SELECT library_id, 'memories', 'MEMORIES', id, date_added_sec, 0, 0 FROM cw WHERE {_MEM}
        UNION ALL SELECT library_id, 'gems', 'GEMS', id, -date_added_sec, 0, 0 FROM cw WHERE {_GEM}
        UNION ALL SELECT library_id, 'otd', 'ON_THIS_DAY', id, date_added_sec, 0, 0 FROM cw WHERE {_OTD}
        UNION ALL SELECT library_id, 'favs', 'FAVORITES', id, date_added_sec, 0, 0 FROM cw WHERE is_favorite
        UNION ALL SELECT library_id, 'unreviewed', 'UNREVIEWED', id, date_added_sec, 0, 0 FROM cw WHERE brain_level < 1
        UNION ALL SELECT library_id, 'junk', 'JUNK', id, date_added_sec, 0, 0 FROM cw WHERE junk_score >= 0.5
        UNION ALL SELECT library_id, 'person_' || person_id, 'PEOPLE', id, date_added_sec, 0, 0 FROM cw
          WHERE person_id >= 0 AND (library_id, 'person_' || person_id) IN (SELECT (library_id, group_id) FROM people)
        UNION ALL SELECT library_id, 'people', 'PEOPLE', id, date_added_sec, smile_count, face_count FROM cw
          WHERE junk_score < 0.5 AND face_count > 0 AND library_id NOT IN (SELECT library_id FROM cw WHERE person_id >= 0)
        UNION ALL SELECT r.library_id, e.group_id, 'EVENT', r.id, r.date_added_sec, 0, 0 FROM runs r JOIN events e
          ON e.library_id = r.library_id AND e.folder = r.folder AND e.burst = r.burst AND e.r <= 4
        UNION ALL SELECT w.library_id, c.group_id, 'CATEGORY', w.id, w.date_added_sec, 0, 0 FROM cw w JOIN cats c ON c.library_id = w.library_id
          AND c.group_id = 'cat_' || coalesce(nullif(trim(w.manual_group), ''), w.category) AND c.rank <= 4
        UNION ALL SELECT library_id, 'album_' || album_id, 'ALBUM', id, date_added_sec, 0, 0 FROM cw WHERE album_id >= 0)""",
      """SELECT library_id, group_id, kind, id, row_number() OVER (PARTITION BY library_id, group_id
        ORDER BY smiles DESC, faces DESC, date_added_sec DESC, id) AS pos FROM m""", *_V),
    "shelf_memories": _members(_MEM),
    "shelf_gems": _members(_GEM),
    "shelf_on_this_day": _members(_OTD),
    "shelf_favorites": _members("is_favorite"),
    "shelf_clutter": with_views("""SELECT library_id, 'JUNK' AS kind, id FROM clips WHERE junk_score >= 0.5
      UNION ALL SELECT library_id, 'UNREVIEWED', id FROM clips WHERE brain_level < 1""", "clips"),
    "shelf_people": chained(", " + _PEOPLE, "SELECT * FROM people", "clips", "persons"),
    "shelf_people_fallback": with_views("""SELECT library_id, id FROM clips WHERE junk_score < 0.5 AND face_count > 0 AND library_id = 'fr'""", "clips"),
    "album_changes": with_views("""SELECT library_id, id, (CASE WHEN id % 12 = 5 THEN 2 WHEN album_id = 1 THEN -1 ELSE album_id END)::BIGINT AS album_id
      FROM clips""", "clips"),
    "hand_placement": with_views("""SELECT library_id, id, g AS manual_group, CASE WHEN g = '' THEN category ELSE g END AS effective_group FROM (
      SELECT *, CASE WHEN id % 97 = 0 OR id % 20 = 3 THEN '' WHEN id % 10 = 3 THEN 'Best of' ELSE manual_group END AS g FROM clips)""", "clips"),
    "shelf_duplicates": chained(SETS, """SELECT library_id, count(*) || ' sets' AS subtitle, sum(members)::BIGINT AS size,
      (sum(members) - count(*))::BIGINT AS redundant, sum(savings_bytes)::BIGINT AS savings_bytes FROM sets GROUP BY 1""",
                                "clips_h", "clips_w", recursive=True),
    "shelf_duplicate_members": chained(SETS, """SELECT library_id, set_id::BIGINT AS set_id, id, row_number() OVER (
        PARTITION BY library_id, set_id ORDER BY r > 1, date_added_sec, id) AS pos, r > 1 AS redundant FROM ranked""",
                                       "clips_h", "clips_w", recursive=True),
    "event_bursts": chained(", " + _EVENTS, 'SELECT library_id, group_id, title, subtitle, "first", "last", size FROM events', "clips"),
    "shelf_events": chained(", " + _EVENTS, """SELECT r.library_id, e.group_id, r.id FROM runs r JOIN events e
      ON e.library_id = r.library_id AND e.folder = r.folder AND e.burst = r.burst AND e.r <= 4""", "clips"),
    "shelf_categories": chained(", " + _CATS, """SELECT library_id, group_id, title, subtitle, size, rank, round(agreement, 6) AS agreement
      FROM cats WHERE rank <= 4""", "clips"),
    "shelf_albums": chained(", " + _ALBUMS, "SELECT * FROM albumg", "clips"),
    "shelf_titles": chained(_ALL, """SELECT library_id, group_id, CASE WHEN group_id IN ('gems', 'person_0') THEN 'Mine: ' || group_id ELSE title END AS title
      FROM shelf""", *_V),
    "photo_shelves": with_views(f"""
      , cats AS (SELECT library_id, category, count(*) AS size, row_number() OVER (PARTITION BY library_id ORDER BY count(*) DESC, category) AS r
        FROM photos WHERE category <> 'unknown' GROUP BY 1, 2 HAVING count(*) >= 4)
      SELECT library_id, 'faces' AS group_id, 'FACES' AS kind, 'With people' AS title, count(*) || ' photos with faces in them' AS subtitle, count(*) AS size
        FROM photos WHERE face_count > 0 GROUP BY 1 HAVING count(*) >= 3
      UNION ALL SELECT library_id, 'smiles', 'FACES', 'All smiles', count(*) || ' caught smiling', count(*) FROM photos WHERE smile_count > 0 GROUP BY 1 HAVING count(*) >= 3
      UNION ALL SELECT library_id, 'learning', 'LEARNING', 'Being read', count(*) || ' still being understood', count(*) FROM photos WHERE brain_level < 1 GROUP BY 1
      UNION ALL SELECT library_id, 'clutter', 'CLUTTER', 'Clutter', count(*) || ' screenshots and downloads', count(*) FROM photos WHERE junk_score >= 0.5 GROUP BY 1 HAVING count(*) >= 3
      UNION ALL SELECT library_id, 'cat_' || category, 'CATEGORY', {title('category')}, size || ' photos', size FROM cats WHERE r <= 4""", "photos"),
    "month_sections": with_views("""SELECT library_id, strftime(make_timestamp(date_added_sec * 1000000), '%Y-%m') AS month, count(*) AS size,
      max(date_added_sec) AS newest FROM photos GROUP BY 1, 2""", "photos"),
    "folder_facet": with_views("""SELECT library_id, folder, size, rank FROM (SELECT library_id, CASE WHEN folder_name = '' THEN 'Other' ELSE folder_name END AS folder,
      count(*) AS size, row_number() OVER (PARTITION BY library_id ORDER BY count(*) DESC, CASE WHEN folder_name = '' THEN 'Other' ELSE folder_name END) AS rank
      FROM photos GROUP BY 1, 2) WHERE rank <= 6""", "photos"),
    "group_choices": with_views("""SELECT library_id, coalesce(nullif(trim(manual_group), ''), category) AS choice, count(*) AS size FROM clips
      WHERE coalesce(nullif(trim(manual_group), ''), category) <> 'unknown' GROUP BY 1, 2""", "clips"),
    "featured_shelf": chained(_ALL, """SELECT library_id, group_id, row_number() OVER (PARTITION BY library_id ORDER BY place, k) AS rank FROM (
      SELECT *, CASE kind WHEN 'MEMORIES' THEN 0 WHEN 'GEMS' THEN 1 WHEN 'FAVORITES' THEN 2 WHEN 'PEOPLE' THEN 3 WHEN 'ALBUM' THEN 4 END AS place,
        row_number() OVER (PARTITION BY library_id, kind ORDER BY CASE WHEN kind = 'ALBUM' THEN group_id END, size DESC, group_id) AS k FROM shelf)
      WHERE place IS NOT NULL AND (k = 1 OR (kind = 'PEOPLE' AND k = 2))""", *_V),
    "hide_group": with_views(f"""SELECT library_id, video_id FROM dismissals UNION SELECT library_id, id FROM clips_w WHERE {_GEM}""",
                             "dismissals", "clips_w"),
}
