"""Near-duplicates and content match, by brute force over all pairs of a library."""

from oracles.views import _BITS, _FOLD, with_views


def hd(a: str, b: str) -> str:
    return f"bit_count(xor({a}, {b}))"


def pairs(k: int) -> str:
    return f"""
  , held AS (SELECT library_id, phash, count(*) AS copies FROM clips_h WHERE phash <> 0 GROUP BY 1, 2),
  fp AS (SELECT a.library_id, a.phash AS phash_a, b.phash AS phash_b, {hd('a.phash', 'b.phash')}::BIGINT AS distance,
    a.copies AS copies_a, b.copies AS copies_b,
    (CASE WHEN a.phash = b.phash THEN a.copies * (a.copies - 1) // 2 ELSE a.copies * b.copies END)::BIGINT AS pairs
    FROM held a JOIN held b ON a.library_id = b.library_id AND a.phash <= b.phash AND {hd('a.phash', 'b.phash')} <= {k})
  """


# Directed edges between clips; the grouped form is derived from them.
EDGES = f"""
  , prof AS (SELECT library_id, lower(folder_name) AS folder, phash, duration_ms, date_added_sec, count(*) AS copies, min(id) AS node
    FROM clips_h WHERE phash <> 0 GROUP BY ALL),
  edges AS (SELECT a.library_id, a.folder, a.node AS a, b.node AS b, {hd('a.phash', 'b.phash')}::BIGINT AS distance,
      a.copies AS copies_a, b.copies AS copies_b, a.date_added_sec AS t
    FROM prof a JOIN prof b ON a.library_id = b.library_id AND a.folder = b.folder
     AND abs(a.date_added_sec - b.date_added_sec) < 604800
     AND (a.duration_ms <= 0 OR b.duration_ms <= 0 OR a.duration_ms::DOUBLE / b.duration_ms BETWEEN 0.75 AND 1.34)
     AND {hd('a.phash', 'b.phash')} <= 6 AND (a.node <> b.node OR a.copies > 1))
"""

SETS = EDGES + """,
  und AS (SELECT library_id, a, b FROM edges UNION SELECT library_id, b, a FROM edges),
  reach(library_id, a, b) AS (SELECT library_id, a, b FROM und UNION SELECT r.library_id, r.a, u.b FROM reach r JOIN und u
    ON u.library_id = r.library_id AND u.a = r.b),
  linked AS (SELECT library_id, a AS node, least(a, min(b)) AS comp FROM reach GROUP BY library_id, a),
  turns AS (SELECT e.library_id, l.comp, e.a, list(e.b) AS mates, row_number() OVER (PARTITION BY e.library_id, l.comp ORDER BY min(e.t), e.a) AS k
    FROM edges e JOIN linked l ON l.library_id = e.library_id AND l.node = e.a GROUP BY e.library_id, l.comp, e.a),
  -- Clip by clip in date order: whoever is free takes its free mates.
  walk(library_id, comp, k, taken, sets) AS (
    SELECT DISTINCT library_id, comp, 0::BIGINT, []::BIGINT[], []::STRUCT(node BIGINT, set_id BIGINT)[] FROM turns
    UNION ALL SELECT library_id, comp, k, CASE WHEN idle THEN taken ELSE list_concat(taken, free) END,
      CASE WHEN idle THEN sets ELSE list_concat(sets, list_transform(free, lambda m: {'node': m, 'set_id': a})) END
    FROM (SELECT *, list_distinct(list_append(left_over, a)) AS free, list_contains(taken, a) OR len(left_over) = 0 AS idle
      FROM (SELECT w.library_id, w.comp, t.k, w.taken, w.sets, t.a, list_filter(t.mates, lambda m: NOT list_contains(w.taken, m)) AS left_over
        FROM walk w JOIN turns t ON t.library_id = w.library_id AND t.comp = w.comp AND t.k = w.k + 1))),
  comp AS (SELECT library_id, s.node AS node, s.set_id AS set_id FROM (
    SELECT library_id, unnest(arg_max(sets, k)) AS s FROM walk GROUP BY library_id, comp)),
  members AS (SELECT c.*, h.phash, k.set_id FROM clips_w c JOIN clips_h h ON h.id = c.id
    JOIN prof p ON p.library_id = c.library_id AND p.folder = lower(c.folder_name) AND p.phash = h.phash
      AND p.duration_ms = c.duration_ms AND p.date_added_sec = c.date_added_sec
    JOIN comp k ON k.library_id = c.library_id AND k.node = p.node),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY library_id, set_id ORDER BY sharpness DESC, avg_completion DESC,
      smile_count DESC, width * height DESC, watch_count DESC, date_added_sec, id) AS r FROM members),
  sets AS (SELECT library_id, set_id, max(id) FILTER (WHERE r = 1) AS keeper_id, count(*) AS members,
      coalesce(sum(size_bytes) FILTER (WHERE r > 1), 0)::BIGINT AS savings_bytes, max(smile_count) FILTER (WHERE r = 1) AS ks,
      max(avg_completion) FILTER (WHERE r = 1) AS kc, max(sharpness) FILTER (WHERE r = 1) AS ksh,
      coalesce(sum(smile_count) FILTER (WHERE r > 1), 0) AS os, max(sharpness) FILTER (WHERE r > 1) AS osh FROM ranked GROUP BY 1, 2)
"""

_LOOKUP = f"""
  , bh AS (SELECT item_id, {_FOLD} AS phash FROM (SELECT item_id, {_BITS} FROM (
      SELECT item_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(t), 9, 8))::BIGINT AS lo
      FROM (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{Nd}}]+')) AS t FROM benchmark) WHERE length(t) >= 2)
      GROUP BY item_id)),
  q AS (SELECT id AS query_id, library_id, phash FROM clips_h UNION ALL SELECT id, library_id, CASE WHEN phash = 0 THEN 0 ELSE xor(phash, 32769) END FROM clips_h
    UNION ALL SELECT item_id + 10000000, 'en', phash FROM bh),
  lib AS (SELECT library_id, id, phash, folder_name, date_added_sec, 'clip' AS kind FROM clips_h
    UNION ALL SELECT library_id, id, phash, folder_name, date_added_sec, 'photo' FROM photos),
  hits AS (SELECT query_id, q.library_id, kind, lib.id, any_value(folder_name) AS folder_name, any_value(date_added_sec) AS date_added_sec,
      min({hd('q.phash', 'lib.phash')})::BIGINT AS distance
    FROM q JOIN lib ON lib.library_id = q.library_id AND q.phash <> 0 AND lib.phash <> 0 AND {hd('q.phash', 'lib.phash')} <= 6 GROUP BY 1, 2, 3, 4),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, library_id ORDER BY distance, id, kind) AS rank FROM hits)
"""

SUPPRESSED = f""", seeds AS (SELECT c.* FROM clips_h c JOIN dismissals d ON d.library_id = c.library_id AND d.video_id = c.id WHERE phash <> 0),
  suppressed AS (SELECT library_id, video_id AS id FROM dismissals
    UNION SELECT c.library_id, c.id FROM clips_h c JOIN seeds s ON s.library_id = c.library_id AND c.phash <> 0
      AND {hd('s.phash', 'c.phash')} <= 6)"""


def chained(extra: str, body: str, *views: str, recursive: bool = False) -> str:
    """Views, then further CTEs beginning with a comma, then the statement."""
    sql = with_views(extra.strip() + "\n" + body, *views)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else sql


SQL = {
    "hamming_pairs": chained(pairs(6), "SELECT * FROM fp WHERE pairs > 0", "clips_h"),
    "hamming_pairs_wide": chained(pairs(10), "SELECT library_id, phash_a, phash_b, distance, pairs FROM fp WHERE pairs > 0", "clips_h"),
    "dup_pairs": chained(EDGES, "SELECT * EXCLUDE (t) FROM edges", "clips_h"),
    "dup_sets": chained(SETS, "SELECT library_id, set_id, id FROM members", "clips_h", "clips_w", recursive=True),
    "dup_keepers": chained(SETS, "SELECT library_id, set_id, keeper_id, members, savings_bytes FROM sets",
                           "clips_h", "clips_w", recursive=True),
    "keeper_reason": chained(SETS, """SELECT library_id, set_id, keeper_id, CASE
      WHEN os = 0 AND NOT coalesce(osh > ksh, false) THEN 'The only one of its kind' WHEN os > 0 AND ks >= os THEN 'Everyone in it is smiling'
      WHEN NOT coalesce(osh > ksh, false) THEN 'The sharpest frame' WHEN kc > 0.6 THEN 'The one you actually finished'
      ELSE 'Best overall quality' END AS reason FROM sets""", "clips_h", "clips_w", recursive=True),
    "content_match": chained(_LOOKUP, "SELECT query_id, library_id, kind, id, distance, rank FROM ranked WHERE rank <= 12",
                             "clips_h", "photos"),
    "content_verdict": chained(_LOOKUP, """SELECT q.query_id, q.library_id, r.id, r.distance, CASE
      WHEN NOT bool_or(q.phash <> 0) THEN 'Couldn''t read that file''s frames — nothing to match against'
      WHEN r.id IS NULL THEN 'Not in your library yet — this file is new to you'
      ELSE 'This is ' || CASE WHEN r.distance <= 3 THEN 'an almost-exact copy of' ELSE 'looks like' END || ' your ' || r.kind || ' in "'
        || r.folder_name || '" — ' || strftime(make_timestamp(r.date_added_sec * 1000000), '%b %-d, %Y') END AS verdict
      FROM q LEFT JOIN ranked r ON r.query_id = q.query_id AND r.library_id = q.library_id AND r.rank = 1
      GROUP BY q.query_id, q.library_id, r.id, r.distance, r.kind, r.folder_name, r.date_added_sec""", "clips_h", "photos"),
    "suppression": chained(SUPPRESSED, "SELECT library_id, id FROM suppressed", "clips_h", "dismissals"),
}
