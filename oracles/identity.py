"""Identity, comparing every vector with every other of its library."""

from oracles.dups import chained
from oracles.views import with_views

_SIM = """, u AS (SELECT library_id, id, video_id, person_id, quality, list_transform(vec, lambda x: x::DOUBLE) AS vec FROM vectors),
  sims AS (SELECT a.library_id, a.id AS a, b.id AS b, a.person_id AS pa, b.person_id AS pb, a.video_id AS va,
    greatest(-1.0, least(1.0, list_cosine_similarity(a.vec, b.vec))) AS sim FROM u a JOIN u b ON a.library_id = b.library_id AND a.id <> b.id)"""


def _components(edges: str) -> str:
    return f""", und AS (SELECT DISTINCT library_id, x, y FROM (SELECT library_id, a AS x, b AS y FROM {edges} UNION ALL SELECT library_id, b, a FROM {edges})),
  reach(library_id, x, y) AS (SELECT library_id, x, y FROM und UNION SELECT r.library_id, r.x, u.y FROM reach r JOIN und u ON u.library_id = r.library_id AND u.x = r.y),
  comp AS (SELECT library_id, x AS node, least(x, min(y)) AS comp FROM reach GROUP BY library_id, x)"""


def _match(deny: bool) -> str:
    no = "WHERE NOT EXISTS (SELECT 1 FROM denials d WHERE d.library_id = sims.library_id AND d.video_id = sims.va AND d.person_id = sims.pb)" if deny else "WHERE true"
    return f""", per AS (SELECT library_id, a AS id, pb, max(sim) AS sim FROM sims {no} AND pa < 0 AND pb >= 0 GROUP BY 1, 2, 3),
  rk AS (SELECT *, row_number() OVER (PARTITION BY library_id, id ORDER BY sim DESC, pb) AS r FROM per),
  dec AS (SELECT u.library_id, u.id, max(pb) FILTER (WHERE r = 1) AS p, coalesce(max(sim) FILTER (WHERE r = 1), 0) AS best,
    coalesce(max(sim) FILTER (WHERE r = 1) - coalesce(max(sim) FILTER (WHERE r = 2), 0), 0) AS margin
    FROM u LEFT JOIN rk USING (library_id, id) WHERE person_id < 0 GROUP BY 1, 2)"""


_DEC = """SELECT library_id, id, CASE WHEN best >= 0.3 AND margin >= 0.02 THEN p ELSE -1 END::BIGINT AS person_id,
  best >= 0.3 AND margin < 0.02 AS ambiguous, round(best, 6)::DOUBLE AS best, round(margin, 6)::DOUBLE AS margin FROM dec"""
_WORDS = r"""list_filter(list_distinct(string_split_regex(lower(regexp_replace(display_name, '\.[^.]*$', '') || ' ' || folder_name), '[^a-z]+')),
  lambda w: length(w) > 2 AND w NOT IN ('video','videos','vid','img','image','images','photo','photos','camera','whatsapp','telegram','instagram','tiktok',
  'snapchat','download','downloads','screenrec','screenrecordings','screenshot','screenshots','movie','movies','clip','clips','media','dcim','final','new','temp','cache','android'))"""



def _assigned(k: int, asks: str, stored: str) -> str:
    """out{k}: what becomes of the vectors ``asks`` selects from u when the vectors ``stored`` are held already."""
    und = f"SELECT library_id, x, y FROM und{k}"
    return f""", ask{k} AS (SELECT * FROM u WHERE {asks}), st{k} AS ({stored}),
  per{k} AS (SELECT s.library_id, s.a AS id, t.person_id AS pb, max(s.sim) AS sim FROM sims s JOIN ask{k} q ON q.library_id = s.library_id AND q.id = s.a
    JOIN st{k} t ON t.library_id = s.library_id AND t.id = s.b WHERE t.person_id >= 0 AND NOT EXISTS (SELECT 1 FROM denials d
      WHERE d.library_id = s.library_id AND d.video_id = s.va AND d.person_id = t.person_id) GROUP BY 1, 2, 3),
  rk{k} AS (SELECT *, row_number() OVER (PARTITION BY library_id, id ORDER BY sim DESC, pb) AS r FROM per{k}),
  dec{k} AS (SELECT q.library_id, q.id, max(pb) FILTER (WHERE r = 1) AS p, coalesce(max(sim) FILTER (WHERE r = 1), 0) AS best,
    coalesce(max(sim) FILTER (WHERE r = 1) - coalesce(max(sim) FILTER (WHERE r = 2), 0), 0) AS margin
    FROM ask{k} q LEFT JOIN rk{k} USING (library_id, id) GROUP BY 1, 2),
  left{k} AS (SELECT library_id, id FROM dec{k} WHERE best < 0.3),
  e{k} AS (SELECT s.library_id, s.a AS x, s.b AS y FROM sims s JOIN left{k} l ON l.library_id = s.library_id AND l.id = s.a
    JOIN left{k} m ON m.library_id = s.library_id AND m.id = s.b WHERE s.sim >= 0.3),
  und{k} AS (SELECT DISTINCT library_id, x, y FROM (SELECT * FROM e{k} UNION ALL SELECT library_id, y, x FROM e{k})),
  reach{k}(library_id, x, y) AS ({und} UNION SELECT r.library_id, r.x, n.y FROM reach{k} r JOIN und{k} n ON n.library_id = r.library_id AND n.x = r.y),
  head{k} AS (SELECT l.library_id, l.id, least(l.id, coalesce(min(r.y), l.id)) AS head FROM left{k} l
    LEFT JOIN reach{k} r ON r.library_id = l.library_id AND r.x = l.id GROUP BY 1, 2),
  last{k} AS (SELECT library_id, max(id) AS last FROM (SELECT library_id, id FROM persons
    UNION ALL SELECT library_id, person_id FROM st{k} WHERE person_id >= 0) GROUP BY 1),
  out{k} AS (SELECT library_id, id, CASE WHEN margin >= 0.02 THEN p ELSE -1 END::BIGINT AS person_id, false AS created FROM dec{k} WHERE best >= 0.3
    UNION ALL SELECT h.library_id, h.id, (coalesce(z.last, -1) + dense_rank() OVER (PARTITION BY h.library_id ORDER BY h.head))::BIGINT, true
    FROM head{k} h LEFT JOIN last{k} z ON z.library_id = h.library_id)"""


_HELD = "SELECT library_id, id, person_id::BIGINT AS person_id FROM u WHERE person_id >= 0"

SQL = {
    "assign_or_create": chained(_SIM + _assigned(1, "person_id < 0", _HELD), "SELECT * FROM out1", "vectors", "persons", "denials", recursive=True),
    "vector_feed": chained(
        _SIM + _assigned(1, "person_id < 0 AND id % 2 = 0", _HELD)
        + _assigned(2, "person_id < 0 AND id % 2 = 1", "SELECT * FROM st1 UNION ALL SELECT library_id, id, person_id FROM out1"),
        """SELECT library_id, id, u.video_id, coalesce(o.person_id, u.person_id)::BIGINT AS person_id FROM u
           LEFT JOIN (SELECT * FROM out1 UNION ALL SELECT * FROM out2) o USING (library_id, id)""", "vectors", "persons", "denials", recursive=True),
    "cosine_pairs": chained(_SIM, "SELECT library_id, a, b, round(sim, 6)::DOUBLE AS sim FROM sims WHERE a < b AND sim >= 0.3", "vectors"),
    "cosine_bucket_recall": chained(_SIM, """SELECT library_id, count(*) AS pairs, 0::BIGINT AS untrue, true AS reached FROM sims
      WHERE a < b AND sim >= 0.3 GROUP BY library_id""", "vectors"),
    "cosine_clusters": chained(_SIM + ", e AS (SELECT * FROM sims WHERE a < b AND sim >= 0.35)" + _components("e"),
                               "SELECT u.library_id, u.id, coalesce(comp, -1) AS cluster FROM u LEFT JOIN comp c ON c.library_id = u.library_id AND c.node = u.id",
                               "vectors", recursive=True),
    "match_gate": chained(_SIM + _match(False), _DEC, "vectors"),
    "match_gate_denied": chained(_SIM + _match(True), _DEC, "vectors", "denials"),
    "consolidate_persons": chained(_SIM + """, e AS (SELECT library_id, pa AS a, pb AS b FROM sims WHERE pa >= 0 AND pb >= 0 AND pa < pb AND sim > 0.42)""" + _components("e") + """,
      n AS (SELECT library_id, person_id, count(*) AS n FROM u WHERE person_id >= 0 GROUP BY 1, 2),
      g AS (SELECT c.*, n.n FROM comp c JOIN n ON n.library_id = c.library_id AND n.person_id = c.node)""",
                                   """SELECT library_id, node::BIGINT AS person_id, (first_value(node) OVER (PARTITION BY library_id, comp ORDER BY n DESC, node))::BIGINT AS survivor FROM g""",
                                   "vectors", recursive=True),
    "adopt_unassigned": chained(_SIM + _match(True), "SELECT library_id, id, p::BIGINT AS person_id FROM dec WHERE best >= 0.3 AND margin >= 0.02",
                                "vectors", "denials"),
    "person_centroids": chained(_SIM.split("\n  sims")[0].rstrip(",") + """,
      unit AS (SELECT library_id, person_id, id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM u WHERE person_id >= 0),
      s AS (SELECT library_id, person_id, pos, sum(v) AS v FROM (SELECT library_id, person_id, unnest(vec) AS v, generate_subscripts(vec, 1) AS pos FROM unit) GROUP BY 1, 2, 3),
      m AS (SELECT library_id, person_id, list(v ORDER BY pos) AS c FROM s GROUP BY 1, 2),
      c AS (SELECT library_id, person_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM m)""",
                                """SELECT library_id, person_id::BIGINT AS person_id, count(*) AS vectors, round(avg(list_dot_product(vec, c)), 6) AS mean_similarity,
      round(any_value(c[1]), 6) AS c_first, round(any_value(c[64]), 6) AS c_last FROM unit JOIN c USING (library_id, person_id) GROUP BY 1, 2""", "vectors"),
    "suggest_names": with_views(f"""
      , w AS (SELECT c.library_id, c.person_id, unnest({_WORDS}) AS word FROM clips c JOIN persons p ON p.library_id = c.library_id AND p.id = c.person_id
        WHERE p.name = '' AND NOT p.verified),
      n AS (SELECT library_id, person_id, word, count(*) AS clips FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 2)
      SELECT library_id, person_id::BIGINT AS person_id, clips, upper(left(word, 1)) || substr(word, 2) AS suggestion FROM (
        SELECT *, row_number() OVER (PARTITION BY library_id, person_id ORDER BY clips DESC, word) AS r FROM n) WHERE r = 1""", "clips", "persons"),
    "primary_person": with_views("""SELECT c.library_id, c.id, coalesce(CASE WHEN b.p <> 3 THEN b.p END, -1)::BIGINT AS person_id FROM clips c LEFT JOIN (
      SELECT library_id, video_id, arg_min(person_id, (-quality, id)) AS p FROM vectors WHERE person_id >= 0 GROUP BY 1, 2) b
      ON b.library_id = c.library_id AND b.video_id = c.id""", "clips", "vectors"),
    "apply_merges": with_views("""
      , v AS (SELECT library_id, CASE WHEN person_id IN (1, 2) THEN 3 ELSE person_id END AS id, count(*) AS vectors FROM vectors GROUP BY 1, 2)
      SELECT p.library_id, p.id::BIGINT AS id, v.vectors, p.split_suggested AND p.id <> 4 AS split_suggested, p.split_silenced OR p.id = 4 AS split_silenced
      FROM persons p JOIN v ON v.library_id = p.library_id AND v.id = p.id""", "persons", "vectors"),
    "merge_named": with_views("""
      , h AS (SELECT p.library_id, p.id, (SELECT count(*) FROM vectors v WHERE v.library_id = p.library_id AND v.person_id = p.id) AS n
        FROM persons p WHERE lower(name) = 'sara' OR lower(suggested_name) = 'sara')
      SELECT library_id, id::BIGINT AS person_id, (first_value(id) OVER (PARTITION BY library_id ORDER BY n DESC, id))::BIGINT AS survivor FROM h""",
                              "persons", "vectors"),
    "split_out": with_views("""SELECT 'vector' AS "table", v.library_id, v.id, CASE WHEN EXISTS (SELECT 1 FROM denials d WHERE d.library_id = v.library_id
        AND d.video_id = v.video_id AND d.person_id = v.person_id) THEN -1 ELSE v.person_id END::BIGINT AS person_id FROM vectors v
      UNION ALL SELECT 'clip', c.library_id, c.id, CASE WHEN EXISTS (SELECT 1 FROM denials d WHERE d.library_id = c.library_id AND d.video_id = c.id)
        THEN -1 ELSE c.person_id END FROM clips c
      UNION ALL SELECT DISTINCT 'denial', library_id, video_id, person_id FROM denials""", "vectors", "clips", "denials"),
    "move_clips": with_views("""SELECT 'vector' AS "table", v.library_id, v.id, CASE WHEN d.video_id IS NOT NULL THEN 6 ELSE v.person_id END::BIGINT AS person_id
      FROM vectors v LEFT JOIN dismissals d ON d.library_id = v.library_id AND d.video_id = v.video_id
      UNION ALL SELECT 'clip', c.library_id, c.id, CASE WHEN d.video_id IS NOT NULL THEN 6 ELSE c.person_id END FROM clips c
        LEFT JOIN dismissals d ON d.library_id = c.library_id AND d.video_id = c.id
      UNION ALL SELECT 'verified', library_id, id, (verified OR (id = 6 AND library_id IN (SELECT library_id FROM dismissals)))::BIGINT FROM persons""",
                             "vectors", "clips", "dismissals", "persons"),
    "nonempty_persons": with_views("""SELECT library_id, id::BIGINT AS id FROM persons p WHERE EXISTS (SELECT 1 FROM vectors v
      WHERE v.library_id = p.library_id AND v.person_id = p.id AND v.person_id <> 5)""", "persons", "vectors"),
    "name_collisions": with_views("""SELECT library_id, lower(suggested_name) AS name_key, count(*) AS persons FROM persons
      WHERE name = '' AND suggested_name <> '' GROUP BY 1, 2 HAVING count(*) > 1""", "persons"),
}
