"""Smart shelves: which groups a library shows, what is in them, and what they are called.

Groups are ``(library_id, group_id, kind, title, subtitle, size)``, members
``(library_id, group_id, kind, id, date_added_sec)``; a reader orders members by
date, newest first, except gems (oldest first).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialib.functions.ranking import top_k
from medialib.functions.text import blank, blank_to_null, first_upper, tag_list
from medialib.functions.when import DAY, age_days, on_this_day, ts
from medialib.operators.taste import effective_group

RECENT_DAYS, GEM_DAYS = 120, 180
EVENT_GAP, EVENT_SHELVES = 3 * DAY, 4
CATEGORY_MIN, CATEGORY_SURE, CATEGORY_SHARE, CATEGORY_SHELVES = 8, 0.5, 0.6, 4
SOLID_AGREEMENT = 0.6
GROUP_COLUMNS = ["library_id", "group_id", "kind", "title", "subtitle", "size"]


def _n(fmt: str, n="size") -> Column:
    return F.format_string(fmt, F.col(n))


def is_memory(threshold: float) -> Column:
    return F.col("junk_score") < threshold


def in_memories(as_of: int, threshold: float) -> Column:
    """A memory that is a favourite, recent or smiling."""
    return is_memory(threshold) & (F.col("is_favorite") | (F.col("smile_count") > 0)
                                   | (age_days("date_added_sec", as_of) <= RECENT_DAYS))


def is_gem(as_of: int, threshold: float) -> Column:
    """An unwatched memory more than half a year old; expects ``watch_count``."""
    return is_memory(threshold) & (F.col("watch_count") == 0) \
        & (age_days("date_added_sec", as_of) > GEM_DAYS)


def basic_members(clips: DataFrame, as_of: int, threshold: float = 0.5) -> DataFrame:
    """Members of every shelf a clip can claim on its own, in one pass over the clips."""
    claim = lambda cond, gid, kind: F.when(cond, F.struct(
        F.lit(gid).alias("group_id"), F.lit(kind).alias("kind")))
    memory = is_memory(threshold)
    claims = F.array(
        claim(F.lit(True), "all", "ALL"),
        claim(in_memories(as_of, threshold), "memories", "MEMORIES"),
        claim(is_gem(as_of, threshold), "gems", "GEMS"),
        claim(memory & on_this_day("date_added_sec", as_of), "otd", "ON_THIS_DAY"),
        claim(F.col("is_favorite"), "favs", "FAVORITES"),
        claim(F.col("brain_level") < 1, "unreviewed", "UNREVIEWED"),
        claim(~memory, "junk", "JUNK"))
    return clips.select("library_id", "id", "date_added_sec",
                        F.inline(F.filter(claims, lambda c: c.isNotNull())))


def basic_groups(members: DataFrame) -> DataFrame:
    """Titles and counts of the shelves from :func:`basic_members`."""
    n = members.groupBy("library_id", "group_id", "kind").agg(F.count("*").alias("size"))
    label = lambda *rows: [x for gid, t, s in rows for x in (F.lit(gid), F.struct(
        F.lit(t).alias("title"), _n(s).alias("subtitle")))]
    texts = F.create_map(*label(
        ("all", "Everything", "all %d videos on this device · nothing hidden"),
        ("memories", "Memories", "%d favorites, recent and smiles"),
        ("gems", "Buried gems", "%d unseen for 6+ months"),
        ("otd", "On this day", "From years past, today"),
        ("favs", "Favorites", "%d hand-picked"),
        ("unreviewed", "Needs a look", "%d not understood yet"),
        ("junk", "Clutter drawer", "%d memes, screenshots, downloads")))
    return n.withColumn("_t", texts[F.col("group_id")]).select(
        "library_id", "group_id", "kind", F.col("_t.title").alias("title"),
        F.col("_t.subtitle").alias("subtitle"), "size")


def name_collisions(persons: DataFrame) -> DataFrame:
    """``(library_id, name_key, persons)``: one suggested name on several unnamed persons."""
    return (persons.where(blank("name") & ~blank("suggested_name"))
            .groupBy("library_id", F.lower("suggested_name").alias("name_key"))
            .agg(F.count("*").alias("persons")).where("persons > 1"))


def people_groups(clips: DataFrame, persons: DataFrame) -> DataFrame:
    """One shelf per person with two clips or more, with its note and name collision."""
    seen = (clips.where("person_id >= 0").groupBy("library_id", "person_id")
            .agg(F.count("*").alias("size"), F.sum("smile_count").alias("smiles")).where("size >= 2"))
    p = persons.select("library_id", F.col("id").alias("person_id"), "name", "suggested_name", "split_suggested")
    clash = name_collisions(persons).select("library_id", F.col("name_key").alias("_k"), F.lit(True).alias("_clash"))
    g = seen.join(p, ["library_id", "person_id"], "left").withColumn("_k", F.lower("suggested_name"))
    g = g.join(clash, ["library_id", "_k"], "left")
    unnamed = blank("name")
    plain = F.concat(_n("%d videos"), F.when(F.col("smiles") > 0, _n(" • %d smiles", "smiles")).otherwise(""))
    return g.select(
        "library_id", F.concat(F.lit("person_"), F.col("person_id").cast("string")).alias("group_id"),
        F.lit("PEOPLE").alias("kind"),
        F.coalesce(blank_to_null("name"), blank_to_null("suggested_name"), F.lit("Unknown person")).alias("title"),
        F.when(F.coalesce("split_suggested", F.lit(False)), "might be two people")
        .when(~blank("suggested_name") & unnamed, F.format_string('named "%s" by context', F.col("suggested_name")))
        .otherwise(plain).alias("subtitle"), "size", "person_id",
        F.when(unnamed & F.coalesce("_clash", F.lit(False)), F.col("suggested_name")).alias("name_collision"))


def people_members(clips: DataFrame, groups: DataFrame) -> DataFrame:
    return clips.join(groups.select("library_id", "person_id", "group_id", "kind"),
                      ["library_id", "person_id"]).select(
        "library_id", "group_id", "kind", "id", "date_added_sec")


def people_fallback(clips: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Members of the plain "People" shelf, for libraries where nobody has been told apart."""
    known = clips.where("person_id >= 0").select("library_id").distinct()
    return (clips.where(is_memory(threshold) & (F.col("face_count") > 0))
            .join(known, "library_id", "left_anti")
            .select("library_id", F.lit("people").alias("group_id"), F.lit("PEOPLE").alias("kind"), "id",
                    "date_added_sec", "smile_count", "face_count"))


def event_days(clips: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Burst number of every (library, folder, day).

    Clips of one day are always within three days of each other, so gaps need only
    be looked for between days; the ordered pass sees one row per day.
    """
    days = (clips.where(is_memory(threshold))
            .groupBy("library_id", F.lower("folder_name").alias("folder"),
                     F.floor(F.col("date_added_sec") / DAY).alias("day"))
            .agg(F.count("*").alias("n"), F.min("date_added_sec").alias("first"),
                 F.max("date_added_sec").alias("last"),
                 F.min_by("category", F.struct("date_added_sec", "id")).alias("lead")))
    in_time = Window.partitionBy("library_id", "folder").orderBy("day")
    gap = F.col("first") - F.lag("last").over(in_time)
    starts = F.when(gap < EVENT_GAP, 0).otherwise(1)
    return days.withColumn("_s", starts).withColumn("burst", F.sum("_s").over(in_time)).drop("_s")


def event_bursts(clips: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Bursts of two memories or more: folder, span, size, label and shelf id."""
    b = event_days(clips, threshold).groupBy("library_id", "folder", "burst").agg(
        F.sum("n").alias("size"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.min_by("lead", "day").alias("lead")).where("size >= 2")
    return b.select(
        "library_id", "folder", "burst", "first", "last", "size",
        F.format_string("event_%s_%d", F.col("folder"), F.col("first")).alias("group_id"),
        F.when(F.col("lead") != "unknown", first_upper("lead")).otherwise(first_upper("folder")).alias("title"),
        F.format_string("%d clips • %s", F.col("size"), F.col("folder")).alias("subtitle"))


def event_groups(bursts: DataFrame, shelves: int = EVENT_SHELVES) -> DataFrame:
    """The largest bursts of a library."""
    return top_k(bursts, ["library_id"], [F.desc("size"), F.asc("first"), F.asc("folder")], shelves) \
        .withColumn("kind", F.lit("EVENT"))


def event_members(clips: DataFrame, groups: DataFrame, threshold: float = 0.5) -> DataFrame:
    days = event_days(clips, threshold).select("library_id", "folder", "day", "burst")
    named = days.join(groups.select("library_id", "folder", "burst", "group_id", "kind"),
                      ["library_id", "folder", "burst"])
    c = clips.where(is_memory(threshold)).select(
        "library_id", "id", "date_added_sec", F.lower("folder_name").alias("folder"),
        F.floor(F.col("date_added_sec") / DAY).alias("day"))
    return c.join(named, ["library_id", "folder", "day"]).select(
        "library_id", "group_id", "kind", "id", "date_added_sec")


def category_groups(clips: DataFrame, shelves: int = CATEGORY_SHELVES) -> DataFrame:
    """Category shelves that the evidence supports, largest and most agreed first.

    A group a person put a clip into by hand is taken as given.
    """
    by_hand = ~blank("manual_group")
    c = clips.withColumn("cat", effective_group()).where("cat <> 'unknown'")
    agg = c.groupBy("library_id", "cat").agg(
        F.count("*").alias("size"), F.max(by_hand).alias("by_hand"),
        F.count_if(F.col("confidence") >= CATEGORY_SURE).alias("_sure"),
        F.count_if(F.array_contains(tag_list("tags"), F.col("cat")) | by_hand).alias("_agree"))
    ok = agg.where((F.col("size") >= CATEGORY_MIN)
                   & (F.col("by_hand") | (F.col("_sure") / F.col("size") >= CATEGORY_SHARE)))
    ok = ok.withColumn("agreement", F.when(F.col("by_hand"), 1.0).otherwise(F.col("_agree") / F.col("size")))
    best = top_k(ok, ["library_id"], [F.desc(F.col("size") * (0.5 + F.col("agreement"))), F.asc("cat")], shelves)
    return best.select(
        "library_id", F.concat(F.lit("cat_"), "cat").alias("group_id"), F.lit("CATEGORY").alias("kind"),
        first_upper("cat").alias("title"),
        F.concat(_n("%d videos"), F.when(F.col("agreement") >= SOLID_AGREEMENT, "").otherwise(" • still learning"))
        .alias("subtitle"), "size", "agreement", "rank", "cat")


def category_members(clips: DataFrame, groups: DataFrame) -> DataFrame:
    return clips.withColumn("cat", effective_group()).join(
        groups.select("library_id", "cat", "group_id", "kind"), ["library_id", "cat"]).select(
        "library_id", "group_id", "kind", "id", "date_added_sec")


def album_groups(clips: DataFrame, albums: DataFrame) -> DataFrame:
    """Every album, empty ones as well."""
    n = clips.where("album_id >= 0").groupBy("library_id", "album_id").agg(F.count("*").alias("size"))
    a = albums.select("library_id", F.col("id").alias("album_id"), "name", "created_at")
    return a.join(n, ["library_id", "album_id"], "left").na.fill(0, ["size"]).select(
        "library_id", F.concat(F.lit("album_"), F.col("album_id").cast("string")).alias("group_id"),
        F.lit("ALBUM").alias("kind"), F.col("name").alias("title"),
        F.when(F.col("size") == 0, "empty — tick clips and add them").otherwise(_n("%d clips")).alias("subtitle"),
        "size", "created_at", "album_id")


def album_members(clips: DataFrame, groups: DataFrame) -> DataFrame:
    return clips.join(groups.select("library_id", "album_id", "group_id", "kind"),
                      ["library_id", "album_id"]).select(
        "library_id", "group_id", "kind", "id", "date_added_sec")


def assign_album(clips: DataFrame, ids: DataFrame, album_id: int) -> DataFrame:
    """Put clips on an album; deleting an album is the same with -1 and its members."""
    named = ids.select("library_id", "id").distinct().withColumn("_in", F.lit(True))
    return (clips.join(named, ["library_id", "id"], "left")
            .withColumn("album_id", F.when(F.col("_in"), F.lit(album_id).cast("bigint"))
                        .otherwise(F.col("album_id"))).drop("_in"))


def assign_group(clips: DataFrame, ids: DataFrame, group: str) -> DataFrame:
    """Place clips in a group by hand; an empty name hands them back to the engine."""
    named = ids.select("library_id", "id").distinct().withColumn("_in", F.lit(True))
    return (clips.join(named, ["library_id", "id"], "left")
            .withColumn("manual_group", F.when(F.col("_in"), F.lit(group.strip()))
                        .otherwise(F.col("manual_group"))).drop("_in"))


def duplicate_group(sets: DataFrame) -> DataFrame:
    """The duplicates shelf of a library from its sets (see ``dups.keepers``)."""
    return sets.groupBy("library_id").agg(
        F.sum("members").alias("size"), F.count("*").alias("sets"),
        (F.sum("members") - F.count("*")).alias("redundant"),
        F.sum("savings_bytes").alias("savings_bytes")).select(
        "library_id", F.lit("dups").alias("group_id"), F.lit("DUPLICATES").alias("kind"),
        F.lit("Duplicates").alias("title"), F.format_string("%d sets", F.col("sets")).alias("subtitle"),
        "size", "redundant", "savings_bytes")


def groups(clips: DataFrame, persons: DataFrame, albums: DataFrame, as_of: int, threshold: float = 0.5,
           dup_sets: DataFrame | None = None) -> DataFrame:
    """All shelves of all libraries. Expects engagement columns on the clips."""
    fallback = people_fallback(clips, threshold).groupBy("library_id", "group_id", "kind").agg(
        F.count("*").alias("size"), F.sum("smile_count").alias("_s")).select(
        "library_id", "group_id", "kind", F.lit("People").alias("title"),
        F.format_string("%d videos • %d smiles", F.col("size"), F.col("_s")).alias("subtitle"), "size")
    parts = [people_groups(clips, persons), fallback, event_groups(event_bursts(clips, threshold)),
             category_groups(clips), album_groups(clips, albums)]
    if dup_sets is not None:
        parts.append(duplicate_group(dup_sets))
    out = basic_groups(basic_members(clips, as_of, threshold)).select(*GROUP_COLUMNS)
    for p in parts:
        out = out.unionByName(p.select(*GROUP_COLUMNS))
    return out


def titled(all_groups: DataFrame, names: DataFrame) -> DataFrame:
    """A name the user chose beats any title of ours."""
    chosen = names.select("library_id", "group_id", blank_to_null("name").alias("_name"))
    return (all_groups.join(chosen, ["library_id", "group_id"], "left")
            .withColumn("title", F.coalesce("_name", "title")).drop("_name"))


def featured(all_groups: DataFrame, albums: DataFrame, most: int = 8) -> DataFrame:
    """Memories, gems, favourites, the two largest persons and the oldest album, at most eight."""
    age = albums.select("library_id", F.concat(F.lit("album_"), F.col("id").cast("string")).alias("group_id"),
                        F.col("created_at").alias("_age"))
    order = {"MEMORIES": (0, 1), "GEMS": (1, 1), "FAVORITES": (2, 1), "PEOPLE": (3, 2), "ALBUM": (4, 1)}
    place = F.create_map(*[F.lit(x) for k, (p, _) in order.items() for x in (k, p)])
    room = F.create_map(*[F.lit(x) for k, (_, n) in order.items() for x in (k, n)])
    g = all_groups.where(F.col("kind").isin(list(order))).join(age, ["library_id", "group_id"], "left")
    g = top_k(g, ["library_id", "kind"],
              [F.asc_nulls_last("_age"), F.desc("size"), F.asc("group_id")], 2, "_in_kind", salt="group_id")
    g = g.where(F.col("_in_kind") <= room[F.col("kind")])
    return top_k(g.withColumn("_place", place[F.col("kind")]), ["library_id"],
                 [F.asc("_place"), F.asc("_in_kind")], most, salt="group_id")


def hide_group(members: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Dismissals after hiding the groups whose members are given."""
    return dismissals.select("library_id", "video_id").unionByName(
        members.select("library_id", F.col("id").alias("video_id"))).distinct()


def photo_groups(photos: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Photo shelves that have enough in them to be worth a card."""
    claim = lambda cond, gid, kind: F.when(cond, F.struct(
        F.lit(gid).alias("group_id"), F.lit(kind).alias("kind")))
    claims = F.array(claim(F.col("face_count") > 0, "faces", "FACES"),
                     claim(F.col("smile_count") > 0, "smiles", "FACES"),
                     claim(F.col("brain_level") < 1, "learning", "LEARNING"),
                     claim(F.col("junk_score") >= threshold, "clutter", "CLUTTER"))
    n = photos.select("library_id", F.inline(F.filter(claims, lambda c: c.isNotNull()))) \
        .groupBy("library_id", "group_id", "kind").agg(F.count("*").alias("size"))
    least = F.when(F.col("group_id") == "learning", 1).otherwise(3)
    text = lambda a, b, c, d: (F.when(F.col("group_id") == "faces", a).when(F.col("group_id") == "smiles", b)
                               .when(F.col("group_id") == "learning", c).otherwise(d))
    fixed = n.where(F.col("size") >= least).select(
        "library_id", "group_id", "kind",
        text("With people", "All smiles", "Being read", "Clutter").alias("title"),
        text(_n("%d photos with faces in them"), _n("%d caught smiling"), _n("%d still being understood"),
             _n("%d screenshots and downloads")).alias("subtitle"), "size")
    cats = photos.where("category <> 'unknown'").groupBy("library_id", "category").agg(
        F.count("*").alias("size")).where("size >= 4")
    shelves = top_k(cats, ["library_id"], [F.desc("size"), F.asc("category")], 4, salt="category").select(
        "library_id", F.concat(F.lit("cat_"), "category").alias("group_id"), F.lit("CATEGORY").alias("kind"),
        first_upper("category").alias("title"), _n("%d photos").alias("subtitle"), "size")
    return fixed.unionByName(shelves)


def month_sections(photos: DataFrame) -> DataFrame:
    return photos.groupBy("library_id", F.date_format(ts("date_added_sec"), "yyyy-MM").alias("month")).agg(
        F.count("*").alias("size"), F.max("date_added_sec").alias("newest"))


def folder_facet(photos: DataFrame, most: int = 6) -> DataFrame:
    folder = F.when(F.col("folder_name") == "", "Other").otherwise(F.col("folder_name"))
    n = photos.groupBy("library_id", folder.alias("folder")).agg(F.count("*").alias("size"))
    return top_k(n, ["library_id"], [F.desc("size"), F.asc("folder")], most, salt="folder")


def group_choices(clips: DataFrame) -> DataFrame:
    """Group names in use, with how many clips bear each."""
    return (clips.withColumn("choice", effective_group())
            .where(~blank("choice") & (F.col("choice") != "unknown"))
            .groupBy("library_id", "choice").agg(F.count("*").alias("size")))


def positions(members: DataFrame, oldest_first: Column) -> DataFrame:
    """Adds ``pos`` within each group: by ``lead``, largest first, then by date as ``oldest_first`` says, then by id.

    Rows are numbered inside one day of a group and shifted by the count of the days before, so the shelf of a whole
    library is never sorted in one task.
    """
    key = ["library_id", "group_id"]
    at = F.when(oldest_first, F.col("date_added_sec")).otherwise(-F.col("date_added_sec"))
    lead = F.coalesce("lead", F.lit(0))
    m = members.withColumn("_lead", -lead).withColumn("_at", at).withColumn("_slice", F.floor(F.col("_at") / DAY))
    cell = [*key, "_lead", "_slice"]
    before = Window.partitionBy(*key).orderBy("_lead", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = m.groupBy(*cell).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("_at", "id"))
    return m.withColumn("_in", inside).join(starts.drop("_n"), cell).select(
        *key, "kind", "id", (F.col("_start") + F.col("_in")).alias("pos"))


def group_members(clips: DataFrame, persons: DataFrame, albums: DataFrame, as_of: int, threshold: float = 0.5) -> DataFrame:
    """``(library_id, group_id, kind, id, pos)``: the ordered clips of every shelf of :func:`groups` but the duplicates'.

    Newest first, gems oldest first, the plain people shelf by smiles, then faces. Expects engagement columns. For duplicates see :func:`duplicate_members`.
    """
    bursts = event_groups(event_bursts(clips, threshold))
    plain = [basic_members(clips, as_of, threshold), people_members(clips, people_groups(clips, persons)),
             event_members(clips, bursts, threshold), category_members(clips, category_groups(clips)),
             album_members(clips, album_groups(clips, albums))]
    columns = ["library_id", "group_id", "kind", "id", "date_added_sec"]
    out = people_fallback(clips, threshold).select(*columns, (F.col("smile_count") * 1_000_000 + F.col("face_count")).alias("lead"))
    for p in plain:
        out = out.unionByName(p.select(*columns), allowMissingColumns=True)
    return positions(out, F.col("kind") == "GEMS")


def duplicate_members(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(library_id, set_id, id, pos, redundant)``: each duplicate set with its keeper first, then by date."""
    kept = sets.select("library_id", "set_id", "keeper_id")
    m = members.select("library_id", "set_id", "id", "date_added_sec").join(kept, ["library_id", "set_id"])
    m = m.withColumn("lead", (F.col("id") == F.col("keeper_id")).cast("bigint"))
    placed = positions(m.select("library_id", F.col("set_id").alias("group_id"), F.lit("DUPLICATES").alias("kind"), "id",
                                "date_added_sec", "lead"), F.lit(True))
    return placed.select("library_id", F.col("group_id").alias("set_id"), "id", "pos", (F.col("pos") > 1).alias("redundant"))
