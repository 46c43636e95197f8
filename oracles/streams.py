"""End states of the streams, computed in one go."""

from oracles import feed
from oracles.dups import SUPPRESSED, chained
from oracles.views import with_views

_WHO = "viewer_id, library_id"


def _fold(k: int) -> str:
    """State s and stamp l after delivery k, from those after the one before."""
    idle = "coalesce(a.now_ms - o.learned_at_ms, 0) / (21 * 86400000.0)"
    return f""", idle{k} AS (SELECT o.*, {idle} AS h FROM l{k - 1} o LEFT JOIN act a ON a.viewer_id = o.viewer_id AND a.library_id = o.library_id AND a.k = {k}),
  faded{k} AS (SELECT {_WHO}, key, likes * CASE WHEN h >= 0.5 THEN pow(0.5, h) ELSE 1 END AS likes,
    dislikes * CASE WHEN h >= 0.5 THEN pow(0.5, h) ELSE 1 END AS dislikes, last_seen_ms, h FROM s{k - 1} JOIN idle{k} USING ({_WHO})),
  s{k} AS (SELECT {_WHO}, key, sum(likes) AS likes, sum(dislikes) AS dislikes, max(last_seen_ms) AS last_seen_ms FROM (
    SELECT {_WHO}, key, likes, dislikes, last_seen_ms FROM faded{k} WHERE h < 0.5 OR likes + dislikes >= 1
    UNION ALL SELECT {_WHO}, key, likes, dislikes, last_seen_ms FROM votes WHERE k = {k}) GROUP BY ALL),
  l{k} AS (SELECT coalesce(o.viewer_id, a.viewer_id) AS viewer_id, coalesce(o.library_id, a.library_id) AS library_id,
    CASE WHEN a.k IS NULL THEN o.learned_at_ms ELSE greatest(coalesce(o.learned_at_ms, a.now_ms), a.newest) END AS learned_at_ms
    FROM l{k - 1} o FULL OUTER JOIN (SELECT * FROM act WHERE k = {k}) a ON a.viewer_id = o.viewer_id AND a.library_id = o.library_id)"""


_FADING = f""", {feed._KEYS}, ev AS (SELECT *, epoch_us("at") // 1000 AS ms, completion >= 0.7 AS liked, completion < 0.2 AS disliked,
    CASE WHEN day("at") < 11 THEN 1 WHEN day("at") < 21 THEN 2 ELSE 3 END AS k,
    epoch_ms(date_trunc('month', "at")) + CASE WHEN day("at") < 11 THEN 12 WHEN day("at") < 21 THEN 40 ELSE 76 END * 86400000::BIGINT AS now_ms
    FROM watch_events),
  votes AS (SELECT {_WHO}, key, k, count(*) FILTER (WHERE liked)::DOUBLE AS likes, count(*) FILTER (WHERE disliked)::DOUBLE AS dislikes,
    max(ms) AS last_seen_ms FROM (SELECT ev.*, c.key FROM ev JOIN clipkeys c ON c.library_id = ev.library_id AND c.id = ev.video_id
    WHERE liked OR disliked) GROUP BY ALL),
  act AS (SELECT {_WHO}, k, max(now_ms) AS now_ms, coalesce(max(ms) FILTER (WHERE liked OR disliked), 0) AS newest FROM ev GROUP BY ALL),
  s1 AS (SELECT {_WHO}, key, likes, dislikes, last_seen_ms FROM votes WHERE k = 1),
  l1 AS (SELECT {_WHO}, greatest(now_ms, newest) AS learned_at_ms FROM act WHERE k = 1)""" + _fold(2) + _fold(3) + "\n"

SQL = {
    "stream_taste": feed.SQL["taste_buckets"],
    "stream_taste_fading": with_views(_FADING + """SELECT viewer_id, library_id, key, round(likes, 6) AS likes, round(dislikes, 6) AS dislikes,
      last_seen_ms, learned_at_ms FROM s3 JOIN l3 USING (viewer_id, library_id)""", "clips", "watch_events"),
    "stream_events": with_views("""SELECT strftime("at", '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT viewer_id) AS viewers,
      sum(row_id)::BIGINT AS row_sum, round(sum(completion), 6) AS completion_sum FROM watch_events GROUP BY 1""", "watch_events"),
    "stream_counters": with_views("""
      , fav AS (SELECT library_id, id AS video_id FROM clips WHERE is_favorite)
      SELECT library_id, video_id, coalesce(e.watch_count, 0) AS watch_count, coalesce(e.skip_count, 0) AS skip_count,
      coalesce(e.last_watched_ms, 0) AS last_watched_ms, round(coalesce(e.completion_sum, 0), 6) AS completion_sum,
      round(least(3.0, coalesce(e.watch_count - e.skip_count, 0) + CASE WHEN f.video_id IS NULL THEN 0 ELSE 1.5 END), 6)::DOUBLE AS attention
      FROM engagement e FULL OUTER JOIN fav f USING (library_id, video_id)""", "engagement", "clips"),
    "library_signatures": chained(SUPPRESSED, """SELECT c.library_id, count(*) AS clips, sum(id)::BIGINT AS id_sum, sum(date_added_sec)::BIGINT AS date_sum,
      any_value(coalesce((SELECT count(*) FROM suppressed s WHERE s.library_id = c.library_id), 0)) AS suppressed FROM clips_h c GROUP BY 1""",
                                  "clips_h", "dismissals"),
    "changed_libraries": with_views("SELECT DISTINCT library_id FROM clips WHERE library_id <> 'de'", "clips"),
}
