"""Shelf queries over the test tables."""

from pyspark.sql import functions as F

from medialib.operators import dups, shelves, taste
from medialib.plans.binding import AS_OF
from medialib.plans.dup_queries import watched
from medialib.plans.registry import as_long, query, r6


def _of_kind(b, kind):
    return shelves.basic_members(watched(b), AS_OF).where(F.col("kind") == kind).select("library_id", "id")


def all_groups(b, dup=False):
    clips = watched(b)
    sets = dups.keepers(watched(b, dups.duplicate_sets(b.clips_hashed()))) if dup else None
    return shelves.groups(clips, b.persons(), b.albums(), AS_OF, dup_sets=sets)


@query
def shelf_sizes(b):
    return all_groups(b).select("library_id", "group_id", "kind", "subtitle", *as_long("size"))


@query
def shelf_members(b):
    """Every clip of every shelf at its place; nobody is known in 'fr', so that it shows the plain people shelf."""
    clips = watched(b).withColumn("person_id", F.when(F.col("library_id") == "fr", -1).otherwise(F.col("person_id")))
    return shelves.group_members(clips, b.persons(), b.albums(), AS_OF).select(
        "library_id", "group_id", "kind", "id", *as_long("pos"))


@query
def shelf_duplicate_members(b):
    members = watched(b, dups.duplicate_sets(b.clips_hashed()))
    return shelves.duplicate_members(members, dups.keepers(members)).select(
        "library_id", *as_long("set_id", "id", "pos"), "redundant")


@query
def shelf_memories(b):
    return _of_kind(b, "MEMORIES")


@query
def shelf_gems(b):
    return _of_kind(b, "GEMS")


@query
def shelf_on_this_day(b):
    return _of_kind(b, "ON_THIS_DAY")


@query
def shelf_favorites(b):
    return _of_kind(b, "FAVORITES")


@query
def shelf_clutter(b):
    m = shelves.basic_members(watched(b), AS_OF).where(F.col("kind").isin("JUNK", "UNREVIEWED"))
    return m.select("library_id", "kind", "id")


@query
def shelf_people(b):
    return shelves.people_groups(b.clips(), b.persons()).select(
        "library_id", "group_id", "title", "subtitle", *as_long("size"), "name_collision")


@query
def shelf_people_fallback(b):
    clips = b.clips().withColumn("person_id", F.when(F.col("library_id") == "fr", -1).otherwise(F.col("person_id")))
    return shelves.people_fallback(clips).select("library_id", "id")


@query
def shelf_duplicates(b):
    sets = dups.keepers(watched(b, dups.duplicate_sets(b.clips_hashed())))
    return shelves.duplicate_group(sets).select(
        "library_id", "subtitle", *as_long("size", "redundant", "savings_bytes"))


@query
def event_bursts(b):
    return shelves.event_bursts(b.clips()).select(
        "library_id", "group_id", "title", "subtitle", *as_long("first", "last", "size"))


@query
def shelf_events(b):
    clips = b.clips()
    groups = shelves.event_groups(shelves.event_bursts(clips))
    return shelves.event_members(clips, groups).select("library_id", "group_id", "id")


@query
def shelf_categories(b):
    return shelves.category_groups(b.clips()).select(
        "library_id", "group_id", "title", "subtitle", *as_long("size", "rank"), r6("agreement").alias("agreement"))


@query
def shelf_albums(b):
    return shelves.album_groups(b.clips(), b.albums()).select(
        "library_id", "group_id", "title", "subtitle", *as_long("size"))


@query
def shelf_titles(b):
    groups = all_groups(b)
    names = groups.where("group_id IN ('gems', 'person_0', 'album_2')").select(
        "library_id", "group_id", F.when(F.col("group_id") == "album_2", "  ").otherwise(
            F.concat(F.lit("Mine: "), "group_id")).alias("name"))
    return shelves.titled(groups, names).select("library_id", "group_id", "title")


@query
def photo_shelves(b):
    return shelves.photo_groups(b.photos()).select(
        "library_id", "group_id", "kind", "title", "subtitle", *as_long("size"))


@query
def month_sections(b):
    return shelves.month_sections(b.photos()).select("library_id", "month", *as_long("size", "newest"))


@query
def folder_facet(b):
    return shelves.folder_facet(b.photos()).select("library_id", "folder", *as_long("size", "rank"))


@query
def group_choices(b):
    return shelves.group_choices(b.clips()).select("library_id", "choice", *as_long("size"))


@query
def featured_shelf(b):
    return shelves.featured(all_groups(b), b.albums()).select("library_id", "group_id", *as_long("rank"))


@query
def hide_group(b):
    members = shelves.basic_members(watched(b), AS_OF).where("group_id = 'gems'")
    return shelves.hide_group(members, b.dismissals())


@query
def album_changes(b):
    """Clips put on the empty album, then the first album deleted: its members are on none."""
    clips = b.clips()
    moved = shelves.assign_album(clips, clips.where("id % 12 = 5").select("library_id", "id"), 2)
    left = shelves.assign_album(moved, moved.where("album_id = 1").select("library_id", "id"), -1)
    return left.select("library_id", "id", "album_id")


@query
def hand_placement(b):
    """Clips placed in a group by hand, and some of the placed ones handed back."""
    clips = b.clips()
    placed = shelves.assign_group(clips, clips.where("id % 10 = 3").select("library_id", "id"), " Best of ")
    back = shelves.assign_group(placed, placed.where("id % 97 = 0 OR id % 20 = 3").select("library_id", "id"), "  ")
    return back.select("library_id", "id", "manual_group", taste.effective_group().alias("effective_group"))
