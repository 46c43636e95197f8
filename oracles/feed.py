"""Behaviour, taste and feed, clip by clip for every viewer."""

from medialib.operators.feed import PRESETS, Tuning
from oracles.dups import SUPPRESSED, chained
from oracles.shelves import _AGE, _NOW, _THEN
from oracles.views import AS_OF, with_views

HOUR = 9

_KEYS = """keys AS (SELECT library_id, id, unnest([{'key': 'cat:' || category, 'w': 2.0::DOUBLE},
    CASE WHEN person_id >= 0 THEN {'key': 'person:' || person_id, 'w': 2.0::DOUBLE} END,
    {'key': 'folder:' || folder_name, 'w': 1.0::DOUBLE},
    {'key': CASE WHEN duration_ms < 25000 THEN 'dur:short' ELSE 'dur:long' END, 'w': 1.0::DOUBLE}]) AS k FROM clips),
  clipkeys AS (SELECT library_id, id, k.key AS key, k.w AS w FROM keys WHERE k IS NOT NULL),
  buckets AS (SELECT viewer_id, e.library_id, key, count(*) FILTER (WHERE completion >= 0.7)::DOUBLE AS likes,
      count(*) FILTER (WHERE completion < 0.2)::DOUBLE AS dislikes, max(epoch_us("at") // 1000) AS last_seen_ms
    FROM watch_events e JOIN clipkeys c ON c.library_id = e.library_id AND c.id = e.video_id
    WHERE completion >= 0.7 OR completion < 0.2 GROUP BY 1, 2, 3)"""
_AFF = """viewers AS (SELECT DISTINCT viewer_id, library_id FROM watch_events),
  aff AS (SELECT v.viewer_id, v.library_id, c.id,
      sum(coalesce((b.likes + 3) / (b.likes + b.dislikes + 6), 0.5) * c.w) / sum(c.w) AS affinity,
      max(coalesce((b.likes + 3) / (b.likes + b.dislikes + 6), 0.5)) AS strongest, count(b.key) AS known,
      string_agg(c.key, '|' ORDER BY CASE left(c.key, 3) WHEN 'cat' THEN 1 WHEN 'per' THEN 2 WHEN 'fol' THEN 3 ELSE 4 END) AS profile
    FROM viewers v JOIN clipkeys c ON c.library_id = v.library_id LEFT JOIN buckets b ON b.viewer_id = v.viewer_id
      AND b.library_id = v.library_id AND b.key = c.key
    GROUP BY 1, 2, 3)"""
_RECENT = """recent AS (SELECT viewer_id, library_id, video_id AS id, count(*) AS seen FROM (SELECT *, row_number() OVER (
      PARTITION BY viewer_id, library_id ORDER BY "at" DESC, row_id DESC) AS r FROM watch_events) WHERE r <= 40 GROUP BY 1, 2, 3)"""
_OTD = f"(date_added_sec > 0 AND dayofyear({_THEN}) = dayofyear({_NOW}) AND year({_THEN}) <> year({_NOW}))"
_BURIED = f"({_AGE} > 180 AND watch_count = 0 AND junk_score < 0.4)"
_DROPPED = "(watch_count > 0 AND skip_count > 0 AND avg_completion BETWEEN 0.01 AND 0.15)"
_ENERGY = "category IN ('music', 'sport', 'gaming', 'dance', 'celebration')"


def _score(t: Tuning) -> str:
    d = lambda x: f"{float(x)!r}::DOUBLE"
    own = f"""(0.3::DOUBLE + CASE WHEN watch_count > 0 THEN avg_completion * 0.35 * {d(t.completion)}
        + CASE WHEN avg_completion > 0.7 THEN 0.15 * {d(t.completion)} ELSE 0 END
        - CASE WHEN skip_count > 2 THEN 0.2 * {d(t.completion)} ELSE 0 END
        - CASE WHEN {_DROPPED} THEN 0.3 * {d(t.completion)} ELSE 0 END ELSE 0.12 * {d(t.novelty)} END
      + CASE WHEN is_favorite THEN 0.2 * {d(t.favorites)} ELSE 0 END
      + CASE WHEN face_count > 0 THEN 0.08 * {d(t.people)} ELSE 0 END + CASE WHEN smile_count > 0 THEN 0.05 * {d(t.people)} ELSE 0 END
      + CASE WHEN {_BURIED} THEN 0.25 * {d(t.nostalgia)} ELSE 0 END + CASE WHEN {_OTD} THEN 0.2 * {d(t.nostalgia)} ELSE 0 END
      + CASE WHEN duration_ms < 25000 THEN 0.1 * {d(t.time_of_day)} ELSE 0 END
      + CASE WHEN {_ENERGY} THEN 0.2 * {d(t.energy)} WHEN duration_ms < 25000 AND {d(t.energy)} > 1 THEN 0.1 * ({d(t.energy)} - 1) ELSE 0 END
      + CASE WHEN prosody_tags LIKE '%speaking%' THEN 0.12 * {d(t.voice)} ELSE 0 END
      + (affinity - 0.5) * 0.35 * {d(t.taste)})"""
    return f"""round(greatest(0.0, least(1.0, ({own} * (1 + (0.7 + confidence * 0.3 - 1) * {d(min(1, t.quality))})
      * CASE WHEN seen > 0 THEN 1 - {d(t.replay_penalty)} * 0.65 ELSE 1 END
      + CASE WHEN seen > 1 THEN 0.18 * least(seen, 3) * {d(t.completion)} ELSE 0 END) / 1.4))::DOUBLE, 9)"""


_PAIRS = f""", {_KEYS}, {_AFF}, {_RECENT},
  pairs AS (SELECT a.viewer_id, a.affinity, a.strongest, c.*, coalesce(r.seen, 0) AS seen FROM aff a
    JOIN clips_w c ON c.library_id = a.library_id AND c.id = a.id
    LEFT JOIN recent r ON r.viewer_id = a.viewer_id AND r.library_id = a.library_id AND r.id = a.id)"""
_V = ("clips", "clips_w", "watch_events")
_CAND = _PAIRS + SUPPRESSED + f""", cand AS (SELECT *, row_number() OVER (PARTITION BY viewer_id, library_id ORDER BY score DESC, id) AS rank
  FROM (SELECT *, {_score(Tuning())} AS score FROM pairs p WHERE junk_score < 0.85
    AND NOT EXISTS (SELECT 1 FROM suppressed s WHERE s.library_id = p.library_id AND s.id = p.id)))"""
_VC = ("clips", "clips_w", "watch_events", "clips_h", "dismissals")

_REASONS = ", ".join(f"CASE WHEN {cond} THEN {{'r': {rank}, 'i': {i}, 't': {text}}} END" for i, (cond, text, rank) in enumerate([
    ("watch_count > 0 AND avg_completion > 0.7", "'you usually finish these'", 6), (_DROPPED, "'closed fast'", 4),
    ("watch_count = 0", "'never seen'", 8), ("is_favorite", "'a favorite'", 5), ("smile_count > 0", "'all smiles'", 7),
    ("face_count > 0 AND smile_count = 0", "'with people'", 12),
    (_BURIED, f"'buried ' || greatest(6, floor({_AGE} / 30)::BIGINT) || ' months'", 99), (_OTD, "'from this day'", 2),
    ("duration_ms < 25000", "'fits the morning'", 11), (_ENERGY, "'high energy'", 10),
    ("prosody_tags LIKE '%speaking%'", "'someone talking'", 9), ("strongest > 0.68", "'matches what you keep watching'", 1),
    ("seen > 0", "'you saw this recently'", 13), ("seen > 1", "'you came back to it'", 0)]))

SQL = {
    "engagement": with_views("""SELECT library_id, video_id, watch_count, skip_count, last_watched_ms,
      round(completion_sum, 6) AS completion_sum FROM engagement""", "engagement"),
    "attention": with_views("""SELECT library_id, video_id, round(least(3.0, sum(s)), 6)::DOUBLE AS attention, least(3.0, sum(s)) >= 0.25 AS pulls_queue FROM (
      SELECT library_id, video_id, 1.0::DOUBLE AS s FROM watch_events WHERE NOT skipped
      UNION ALL SELECT library_id, id, 1.5 FROM clips WHERE is_favorite) GROUP BY 1, 2""", "watch_events", "clips"),
    "taste_buckets": chained(", " + _KEYS, "SELECT viewer_id, library_id, key, likes, dislikes, last_seen_ms FROM buckets", "clips", "watch_events"),
    "taste_decayed": chained(", " + _KEYS, f"""SELECT viewer_id, library_id, key, round(likes * f, 6) AS likes, round(dislikes * f, 6) AS dislikes FROM (
      SELECT *, CASE WHEN h >= 0.5 THEN pow(0.5, h) ELSE 1 END AS f FROM (SELECT *, ({AS_OF}000 - last_seen_ms) / (21.0::DOUBLE * 86400000) AS h FROM buckets))
      WHERE h < 0.5 OR (likes + dislikes) * f >= 1""", "clips", "watch_events"),
    "taste_affinity": chained(f", {_KEYS}, {_AFF}", """SELECT DISTINCT viewer_id, library_id, profile, round(affinity, 6) AS affinity,
      round(strongest, 6) AS strongest FROM aff WHERE known > 0""", "clips", "watch_events"),
    "feed_scores": chained(_PAIRS, f"SELECT viewer_id, library_id, id, {_score(Tuning())} AS score FROM pairs", *_V),
    "feed_reasons": chained(_CAND, f"""SELECT viewer_id, id, CASE WHEN len(r) = 0 THEN 'picked for balance' ELSE array_to_string(
        list_transform(list_sort(r)[1:2], lambda x: x.t), ' · ') END AS reason
      FROM (SELECT viewer_id, id, list_filter([{_REASONS}], lambda x: x IS NOT NULL) AS r FROM cand WHERE rank <= 120)""", *_VC),
    "replay_signals": chained(", " + _RECENT, "SELECT * FROM recent", "watch_events"),
    "feed_candidates": chained(_CAND, "SELECT viewer_id, library_id, id, rank, score FROM cand WHERE rank <= 120", *_VC),
    "preset_scores": chained(_PAIRS, "SELECT viewer_id, library_id, id, " + ", ".join(
        f"{_score(t)} AS score_{n.lower()}" for n, t in PRESETS.items()) + " FROM pairs", *_V),
    "reel_refresh": chained(_CAND, """SELECT c.viewer_id, c.library_id, c.id, c.rank, k.display_name, k.is_favorite FROM cand c
      JOIN clips k ON k.library_id = c.library_id AND k.id = c.id WHERE rank <= 120 AND c.id % 7 <> 3""", *_VC),
}
