"""Common table expressions shared by the statements, assembled on demand."""

from medialib.operators import ontology
from medialib.plans import binding

AS_OF = binding.AS_OF
_NAMES = {t: t for t in binding.TABLES}


def _plain(text: str, **extra) -> str:
    return text.format(**_NAMES, **extra)


_DOC_POS = """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
  count(*) OVER (PARTITION BY lang) AS n FROM documents"""
_EVENT_JOIN = """FROM events e JOIN docpos d
 ON d.lang = CASE (e.user_id + CASE WHEN e.event_id % 3 = 0 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END
 AND d.i = (e.event_id * 7919) % d.n"""

_BITS = ", ".join(
    f"sum((({'hi' if b >= 32 else 'lo'} >> {b % 32}) & 1) * 2 - 1) AS b{b}" for b in range(64))
_FOLD = " + ".join(
    f"CASE WHEN b{b} > 0 THEN {'(-9223372036854775807 - 1)' if b == 63 else f'{1 << b}::BIGINT'} ELSE 0 END"
    for b in range(63)) + " + CASE WHEN b63 > 0 THEN (-9223372036854775807 - 1) ELSE 0 END"

# name -> (views it needs, text)
VIEWS = {
    "clips": ((), _plain(binding.CLIPS_BASE)),
    "docpos": ((), _DOC_POS),
    "watch_events": (("docpos",), f"""SELECT e.event_id AS row_id, e.user_id AS viewer_id, d.lang AS library_id,
      d.doc_id AS video_id, e.ts AS "at", CAST(least(e.value / 100.0, 1.0) AS DOUBLE) AS completion,
      e.value / 100.0 < 0.15 AS skipped, hour(e.ts) AS hour_of_day {_EVENT_JOIN}
      WHERE e.event_type IN ('view', 'click')"""),
    "dismissals": (("docpos",), f"""SELECT DISTINCT d.lang AS library_id, d.doc_id AS video_id {_EVENT_JOIN}
      WHERE e.event_type = 'error' AND e.event_id % 20 = 0"""),
    "photos": ((), "SELECT * EXCLUDE (phash_src, phash_flip), xor(('0x' || substr(phash_src, 2, 15))::BIGINT, "
                   "(1::BIGINT << phash_flip::INT)) AS phash FROM (" + _plain(binding.PHOTOS_BASE) + ")"),
    "vectors": ((), _plain(binding.VECTORS)),
    "persons": ((), _plain(binding.PERSONS)),
    "denials": ((), _plain(binding.DENIALS)),
    "detections": ((), _plain(binding.DETECTIONS)),
    "acoustic_windows": ((), _plain(binding.ACOUSTIC_WINDOWS)),
    "label_rows": ((), _plain(binding.LABEL_ROWS, words="unnest(range(len(string_split(p_name, ' ')))) AS pos, unnest(string_split(p_name, ' ')) AS label")),
    "listing_new": ((), binding.LISTING_NEW.replace("{clips_base}", _plain(binding.CLIPS_BASE))),
    "hashes": ((), rf"""SELECT doc_id AS id, {_FOLD} AS phash FROM (
      SELECT doc_id, {_BITS} FROM (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS hi,
        ('0x' || substr(md5(t), 9, 8))::BIGINT AS lo
        FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{Nd}}]+')) AS t FROM documents)
        WHERE length(t) >= 2) GROUP BY doc_id)"""),
    "clips_h": (("clips", "hashes"),
                "SELECT c.*, coalesce(h.phash, 0) AS phash FROM clips c LEFT JOIN hashes h USING (id)"),
    "engagement": (("watch_events",), """SELECT library_id, video_id, count(*) AS watch_count,
      sum(completion) AS completion_sum, count(*) FILTER (WHERE skipped) AS skip_count,
      max(epoch_us("at") // 1000) AS last_watched_ms FROM watch_events GROUP BY 1, 2"""),
    "clips_w": (("clips", "engagement"), """SELECT c.*, coalesce(e.watch_count, 0) AS watch_count,
      coalesce(e.completion_sum, 0.0) AS completion_sum, coalesce(e.skip_count, 0) AS skip_count,
      coalesce(e.completion_sum / e.watch_count, 0.0) AS avg_completion,
      coalesce(nullif(trim(c.manual_group), ''), c.category) AS effective_group
      FROM clips c LEFT JOIN engagement e ON e.library_id = c.library_id AND e.video_id = c.id"""),
    "search_queries": ((), """SELECT conv_id * 1000 + turn AS query_id,
      CASE conv_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS library_id,
      text, conv_id % 50 AS viewer_id, turn AS "at"
      FROM conversations WHERE role = 'user'"""),
}


def with_views(body: str, *names: str) -> str:
    """``body`` behind a WITH clause of the named views and all they need."""
    order: list[str] = []

    def add(name):
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    joint = "" if body.lstrip().startswith(",") else "\n"
    return f"WITH {ctes}{joint}{body.lstrip()}"


def category_case(expr: str) -> str:
    """Ordered keyword lookup as SQL; the word lists are the shared fixed values."""
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({expr}), '{w}')" for w in ws) + f" THEN '{cat}'"
        for cat, ws in ontology.CATEGORIES.items())
    return f"CASE {whens} END"


def any_of(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def any_prefix(expr: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({expr}, '{w}')" for w in words) + ")"


def title(expr: str) -> str:
    return f"(upper(substr({expr}, 1, 1)) || substr({expr}, 2))"


def clip_junk(folder="folder_name", name="display_name") -> str:
    f, n = f"lower(trim({folder}))", f"lower({name})"
    return (f"greatest(0.0, least(1.0, CASE WHEN {any_of(f, ontology.JUNK_FOLDERS)} THEN 0.75 ELSE 0 END"
            f" + CASE WHEN {any_of(n, ontology.JUNK_NAMES)} THEN 0.45 ELSE 0 END"
            f" - CASE WHEN {any_of(f, ontology.MEMORY_FOLDERS)} THEN 0.55 ELSE 0 END"
            f" - CASE WHEN {any_prefix(n, ontology.CLIP_CAMERA_PREFIXES)} THEN 0.45 ELSE 0 END))::DOUBLE")


def photo_junk(folder="folder_name", name="display_name") -> str:
    tokens = lambda c: rf"string_split_regex(regexp_replace(lower({c}), '\.[^.]*$', ''), '[^\p{{L}}\p{{N}}]+')"
    util = "[" + ",".join(f"'{w}'" for w in ontology.UTILITY_WORDS) + "]"
    long, short = "greatest(width, height)", "least(width, height)"
    ratio = f"({long}::DOUBLE / {short})"
    inl = lambda c, xs: f"{c} IN ({','.join(map(str, xs))})"
    shape = (f"CASE WHEN width <= 0 OR height <= 0 OR {any_prefix(f'lower({name})', ontology.PHOTO_CAMERA_PREFIXES)} THEN 0.0"
             f" WHEN {inl(short, ontology.SCREEN_SHORT)} AND {inl(long, ontology.SCREEN_LONG)}"
             f" AND {ratio} BETWEEN 1.6 AND 2.5 THEN 0.9"
             f" WHEN {ratio} BETWEEN 1.9 AND 2.45 AND {short} BETWEEN 600 AND 1600 THEN 0.7 ELSE 0.0 END")
    return (f"greatest({clip_junk(folder, name)}, CASE WHEN list_has_any({tokens(name)}, {util})"
            f" OR list_has_any({tokens(folder)}, {util}) THEN 0.75 ELSE 0.0 END, {shape})::DOUBLE")


def in_order(lst: str) -> str:
    """Distinct list entries in order of first appearance."""
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"
