"""Search: every query held against every item of its library."""

from oracles.classify import _LINE
from oracles.dups import chained
from oracles.views import AS_OF, with_views

_YM = "strftime(make_timestamp(date_added_sec * 1000000), '%Y-%m')"
_DOCS = f"""
  , docs AS (SELECT c.library_id, 'clip' AS kind, c.id, lower(concat_ws(' ', display_name, folder_name, category, tags, about, prosody_tags,
      coalesce(transcript, ''), coalesce(trim(p.suggested_name || ' ' || p.name), ''), {_YM})) AS text
    FROM clips c LEFT JOIN persons p ON p.library_id = c.library_id AND p.id = c.person_id
    UNION ALL SELECT library_id, 'photo', id, lower(concat_ws(' ', display_name, folder_name, category, tags, about, {_YM})) FROM photos)"""
_TERMS = r"list_filter(list_distinct(string_split_regex(text, '[^\p{L}\p{Nd}]+')), lambda t: length(t) >= 2)"
_POST = f""", post AS (SELECT library_id, kind, id, term, left(term, 2) AS p2 FROM (SELECT library_id, kind, id, unnest({_TERMS}) AS term FROM docs))"""


def _qterms(src: str) -> str:
    toks = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{Nd}]+'), lambda t: length(t) >= 2)"
    return f""", qt AS (SELECT query_id, library_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM (
      SELECT query_id, library_id, (list_filter({toks}, lambda x, i: list_position({toks}, x) = i))[1:8] AS toks FROM {src}))"""


_PREFIX = """, prefix AS (SELECT q.query_id, q.library_id, p.kind, p.id, count(DISTINCT q.term) AS matched FROM qt q
    JOIN post p ON p.library_id = q.library_id AND starts_with(p.term, q.term) GROUP BY 1, 2, 3, 4)"""
_NETQ = """, netq AS (SELECT query_id, library_id, text FROM search_queries UNION ALL
    SELECT ('0x' || substr(md5(library_id || '|' || text), 1, 12))::BIGINT + 1000000000, library_id, text FROM (
      SELECT library_id, category AS text FROM clips UNION SELECT library_id, lower(folder_name) FROM clips
      UNION SELECT library_id, unnest(string_split(tags, ',')) FROM photos))"""
_NET = """, hay AS (SELECT library_id, 'clip' AS kind, id, lower(concat_ws(chr(1), display_name, tags, category, folder_name, coalesce(transcript, ''))) AS hay FROM clips
    UNION ALL SELECT library_id, 'photo', id, lower(concat_ws(chr(1), display_name, tags, category, folder_name)) FROM photos),
  net AS (SELECT q.query_id, q.library_id, h.kind, h.id FROM netq q JOIN hay h ON h.library_id = q.library_id
      AND length(q.text) >= 2 AND contains(h.hay, lower(q.text)))"""
_PIECES = """, cut AS (SELECT library_id, kind, id, list_transform(string_split(hay, ''), lambda c: unicode(c)::BIGINT) AS u FROM hay),
  piece AS (SELECT DISTINCT library_id, kind, id, unnest(list_concat(
      list_transform(range(1, len(u)), lambda i: u[i] * 2097152 + u[i + 1]),
      list_transform(range(1, len(u) - 1), lambda i: (u[i] * 2097152 + u[i + 1]) * 2097152 + u[i + 2]))) AS gram FROM cut)"""
_PIECE_COUNTS = "SELECT library_id, kind, gram, count(*) AS items, sum(id)::BIGINT AS id_sum FROM piece GROUP BY 1, 2, 3"
_M = "year(make_timestamp(date_added_sec * 1000000)) || '-' || month(make_timestamp(date_added_sec * 1000000))"
_JOIN = lambda *p: "array_to_string(list_filter([" + ", ".join(p) + "], lambda x: x IS NOT NULL AND trim(x) <> ''), ' ')"
_WHAT = _JOIN("CASE WHEN category <> 'unknown' THEN category END", "replace(tags, ',', ' ')", "about")
_FACE = ("CASE WHEN face_count > 0 THEN face_count || ' faces' END", "CASE WHEN smile_count > 0 THEN 'smiling' END",
         "CASE WHEN is_favorite THEN 'favorite' END")
_SHAPED = """CASE WHEN length(line) <= 240 THEN line WHEN instr(reverse(line[1:241]), ' ') BETWEEN 1 AND 240
  THEN trim(line[1:241 - instr(reverse(line[1:241]), ' ')]) ELSE line[1:240] END"""
_WHO = "CASE WHEN person_id < 0 THEN '' ELSE 'Person ' || chr((65 + person_id % 26)::INT) || CASE WHEN person_id >= 26 THEN (person_id // 26 + 1)::VARCHAR ELSE '' END END"
_MEM = f""", mem AS (SELECT library_id, 'clip' AS kind, id, lower({_JOIN(_WHO, _WHAT, 'folder_name', _M,
      _JOIN(*_FACE, "CASE WHEN watch_count > 2 THEN 'rewatched' END"), _SHAPED)}) AS text FROM (SELECT *, {_LINE} AS line FROM clips_w)
    UNION ALL SELECT library_id, 'photo', id, lower({_JOIN(_WHAT, 'folder_name', _M, _JOIN(*_FACE), 'display_name')}) FROM photos)"""


def _score(q: str, doc: str) -> str:
    toks = f"list_filter(string_split_regex(lower({q}), '[^a-z0-9]+'), lambda t: length(t) > 1)"
    return (f"CASE WHEN len({toks}) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({toks}, lambda t: contains({doc}, t)))::DOUBLE / len({toks}) END")


_RANKED = _DOCS + _POST + _NETQ + _qterms("netq") + _PREFIX + _NET + _MEM + f"""
  , pool AS (SELECT query_id, library_id, kind, id, bool_or(net) AS net FROM (
      SELECT query_id, library_id, kind, id, true AS net FROM net UNION ALL SELECT query_id, library_id, kind, id, false FROM prefix) GROUP BY 1, 2, 3, 4),
  scored AS (SELECT p.*, {_score('q.text', 'm.text')} AS score,
      CASE p.kind WHEN 'clip' THEN c.watch_count ELSE f.date_added_sec END AS tie
    FROM pool p JOIN netq q ON q.query_id = p.query_id JOIN mem m ON m.library_id = p.library_id AND m.kind = p.kind AND m.id = p.id
    LEFT JOIN clips_w c ON p.kind = 'clip' AND c.library_id = p.library_id AND c.id = p.id
    LEFT JOIN photos f ON p.kind = 'photo' AND f.library_id = p.library_id AND f.id = p.id),
  ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie DESC, kind, id) AS rank
    FROM scored WHERE score > 0 OR net) WHERE rank <= 60),
  hits AS (SELECT r.*, coalesce(c.face_count, f.face_count) AS face_count, coalesce(c.is_favorite, f.is_favorite) AS is_favorite,
      coalesce(c.date_added_sec, f.date_added_sec) AS date_added_sec, coalesce(c.category, f.category) AS category,
      coalesce(c.folder_name, f.folder_name) AS folder_name, coalesce(c.prosody_tags, '') AS prosody_tags, coalesce(c.person_id, -1) AS person_id
    FROM ranked r LEFT JOIN clips_w c ON r.kind = 'clip' AND c.library_id = r.library_id AND c.id = r.id
    LEFT JOIN photos f ON r.kind = 'photo' AND f.library_id = r.library_id AND f.id = r.id)"""
_VR = ("clips", "photos", "persons", "clips_w", "search_queries")
_ROUTE = """CASE WHEN said IN ('people','person','faces','face','smiles','smiling','selfie','selfies') THEN 'people'
  WHEN said IN ('talking','voice','speech','someone talking','speaking') THEN 'voice' WHEN pid IS NOT NULL THEN 'person' ELSE 'general' END"""
_SECTIONS = """
  , b AS (SELECT h.query_id, CASE WHEN h.kind = 'photo' THEN 1 WHEN person_id >= 0 THEN 0 ELSE 2 END AS block,
      CASE WHEN h.kind = 'clip' AND person_id >= 0 THEN person_id ELSE -1 END AS who,
      CASE WHEN h.kind = 'photo' THEN 'Photos' WHEN person_id < 0 THEN 'No faces yet'
        ELSE coalesce(nullif(trim(p.name), ''), nullif(trim(p.suggested_name), ''), 'Someone in particular') END AS title,
      h.rank, h.kind, h.id
    FROM hits h LEFT JOIN persons p ON p.library_id = h.library_id AND p.id = h.person_id),
  s AS (SELECT query_id, block, who, title, count(*) AS size, min(rank) AS first_rank FROM b GROUP BY 1, 2, 3, 4),
  placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY block, size DESC, title = 'Someone in particular', first_rank) AS section FROM s)"""

SQL = {
    "clip_documents": chained(_DOCS, "SELECT library_id, id, text FROM docs WHERE kind = 'clip'", "clips", "photos", "persons"),
    "photo_documents": chained(_DOCS, "SELECT library_id, id, text FROM docs WHERE kind = 'photo'", "clips", "photos", "persons"),
    "memory_docs": chained(_MEM, "SELECT library_id, kind, id, text FROM mem", "clips_w", "photos"),
    "query_terms": chained(_qterms("search_queries"), "SELECT query_id, library_id, pos, term FROM qt", "search_queries"),
    "postings": chained(_DOCS + _POST, """SELECT library_id, kind, p2, term, count(*) AS items, sum(id)::BIGINT AS id_sum FROM post
      GROUP BY 1, 2, 3, 4""", "clips", "photos", "persons"),
    "postings_reindexed": chained((_DOCS + _POST).replace("p.suggested_name || ' ' || p.name", "p.suggested_name || ' ' || CASE WHEN p.id = 0 THEN 'Zoe' ELSE p.name END"),
                                  "SELECT library_id, kind, term, count(*) AS items, sum(id)::BIGINT AS id_sum FROM post GROUP BY 1, 2, 3",
                                  "clips", "photos", "persons"),
    "index_freshness": with_views("""SELECT library_id, kind, media, indexed, media = indexed AS fresh FROM (
      SELECT library_id, 'clip' AS kind, count(*) AS media FROM listing_new GROUP BY 1 UNION ALL SELECT library_id, 'photo', count(*) FROM photos GROUP BY 1)
      JOIN (SELECT library_id, 'clip' AS kind, count(*) AS indexed FROM clips GROUP BY 1 UNION ALL SELECT library_id, 'photo', count(*) FROM photos GROUP BY 1)
      USING (library_id, kind)""", "listing_new", "clips", "photos"),
    "prefix_candidates": chained(_DOCS + _POST + _qterms("search_queries") + _PREFIX, "SELECT query_id, library_id, kind, id, matched FROM prefix",
                                 "clips", "photos", "persons", "search_queries"),
    "gram_index": chained(_NETQ + _NET + _PIECES, _PIECE_COUNTS, "clips", "photos", "search_queries"),
    "gram_index_reindexed": chained((_NETQ + _NET + _PIECES).replace(
        "category, folder_name, coalesce(transcript", "category, CASE WHEN id % 10 = 0 THEN 'Ärchive 7' ELSE folder_name END, coalesce(transcript")
        .replace("folder_name)) FROM photos)", "folder_name)) FROM photos WHERE id % 7 <> 0)"),
        _PIECE_COUNTS, "clips", "photos", "search_queries"),
    "substring_indexed": chained(_NETQ + _NET, "SELECT query_id, kind, id FROM net", "clips", "photos", "search_queries"),
    "substring_candidates": chained(_NETQ + _NET, "SELECT query_id, kind, id FROM net", "clips", "photos", "search_queries"),
    "search_routes": with_views(f"""
      , q AS (SELECT query_id, library_id, text FROM search_queries UNION ALL SELECT 900000000 + w.i, l.library_id, w.t FROM (SELECT DISTINCT library_id FROM clips) l,
        (VALUES (0, ' People'), (1, 'talking'), (2, 'ANNA'), (3, 'omar '), (4, 'Sara'), (5, 'a')) w(i, t)),
      j AS (SELECT query_id, library_id, lower(trim(text)) AS said, (SELECT min(id) FROM persons p WHERE p.library_id = q.library_id AND trim(q.text) <> ''
        AND (lower(p.name) = lower(trim(q.text)) OR lower(p.suggested_name) = lower(trim(q.text)))) AS pid FROM q WHERE length(text) >= 2)
      SELECT query_id, library_id, {_ROUTE} AS route, CASE WHEN {_ROUTE} = 'person' THEN pid END::BIGINT AS person_id FROM j""",
                                "search_queries", "clips", "persons"),
    "route_results": with_views("""
      , named AS (SELECT library_id, min(id) AS pid FROM persons WHERE lower(name) = 'anna' GROUP BY 1
        UNION ALL SELECT library_id, min(id) FROM persons WHERE lower(suggested_name) = 'omar' GROUP BY 1
        UNION ALL SELECT library_id, min(id) FROM persons WHERE lower(suggested_name) = 'sara' GROUP BY 1)
      SELECT library_id, 'people' AS route, (-1)::BIGINT AS person_id, id FROM clips WHERE face_count > 0
      UNION ALL SELECT library_id, 'voice', -1, id FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY date_added_sec DESC, id) AS r
        FROM clips WHERE prosody_tags LIKE '%speaking%') WHERE r <= 200
      UNION ALL SELECT c.library_id, 'person', pid, c.id FROM clips c JOIN named n ON n.library_id = c.library_id AND n.pid = c.person_id""",
                                "clips", "persons"),
    "match_scores": chained(_DOCS + _POST + _qterms("search_queries") + _PREFIX + _MEM, f"""SELECT p.query_id, p.kind, p.id,
      round({_score('q.text', 'm.text')}, 6) AS score FROM prefix p JOIN search_queries q USING (query_id)
      JOIN mem m ON m.library_id = p.library_id AND m.kind = p.kind AND m.id = p.id""", "clips", "photos", "persons", "clips_w", "search_queries"),
    "search_ranked": chained(_RANKED, "SELECT query_id, library_id, kind, id, rank, tie, round(score, 6) AS score FROM ranked", *_VR),
    "search_lens": chained(_RANKED, f"""SELECT 'people' AS lens, query_id, kind, id FROM hits WHERE face_count > 0 AND date_added_sec >= {AS_OF} - 365 * 86400
      UNION ALL SELECT 'talking', query_id, kind, id FROM hits WHERE prosody_tags LIKE '%speaking%' AND lower(folder_name) = 'camera'
      UNION ALL SELECT 'music', query_id, kind, id FROM hits WHERE is_favorite AND category = 'music'""", *_VR),
    "search_sections": chained(_RANKED + _SECTIONS, """SELECT query_id, section, size, first_rank,
      CASE WHEN count(*) OVER (PARTITION BY query_id) > 1 THEN title END AS title FROM placed""", *_VR),
    "search_section_hits": chained(_RANKED + _SECTIONS, """SELECT b.query_id, section, row_number() OVER (
        PARTITION BY b.query_id, section ORDER BY rank) AS pos, kind, id
      FROM b JOIN placed p ON p.query_id = b.query_id AND p.block = b.block AND p.who = b.who""", *_VR),
    "search_suggestions": with_views("""SELECT library_id, row_number() OVER (PARTITION BY library_id ORDER BY o) AS pos, suggestion FROM (
      SELECT DISTINCT library_id, 0 AS o, 'talking' AS suggestion FROM clips UNION ALL SELECT DISTINCT library_id, 1, 'people' FROM clips
      UNION ALL SELECT library_id, 10 + r, category FROM (SELECT library_id, category, row_number() OVER (PARTITION BY library_id ORDER BY count(*) DESC, category) AS r
        FROM clips WHERE category <> 'unknown' GROUP BY 1, 2 HAVING count(*) >= 3) WHERE r <= 3
      UNION ALL SELECT library_id, 20 + r, folder_name FROM (SELECT library_id, folder_name, row_number() OVER (PARTITION BY library_id ORDER BY count(*) DESC, folder_name) AS r
        FROM clips GROUP BY 1, 2 HAVING count(*) >= 5) WHERE r <= 2)""", "clips"),
    "recent_searches": with_views("""SELECT viewer_id, text, "at", rank FROM (SELECT *, row_number() OVER (PARTITION BY viewer_id ORDER BY "at" DESC, text) AS rank
      FROM (SELECT viewer_id, trim(text) AS text, max("at") AS "at" FROM search_queries WHERE length(trim(text)) >= 2 GROUP BY 1, 2)) WHERE rank <= 6""", "search_queries"),
}
