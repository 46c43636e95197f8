"""The four jobs a library runs: index, search, feed, shelves. Each is a chain of operators."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialib.operators import classify, dups, feed, identity, reconcile, search, shelves, taste
from medialib.session import settle


@dataclass
class Library:
    """The stored tables of all libraries."""

    clips: DataFrame
    photos: DataFrame
    events: DataFrame
    vectors: DataFrame
    persons: DataFrame
    denials: DataFrame
    dismissals: DataFrame
    albums: DataFrame
    group_names: DataFrame

    def watched(self) -> DataFrame:
        return taste.with_engagement(self.clips, taste.engagement(self.events))


def index_run(lib: Library, clip_listing: DataFrame, photo_listing: DataFrame,
              clip_labels: DataFrame | None = None, photo_labels: DataFrame | None = None,
              report: reconcile.RunReport | None = None) -> Library:
    """Reconcile with new listings, classify, repair identities, prune events.

    Every table is written before the next stage reads it, so a lost executor costs
    one stage. ``report`` takes down what each stage wrote.
    """
    settle = (report or reconcile.RunReport("index")).settle
    clips = settle(reconcile.reconcile_clips(lib.clips, clip_listing), "clips")
    if clip_labels is not None:
        read = classify.merge_labels(clips, clip_labels, key=("library_id", "id"))
        clips = read.withColumns({c: F.col(f"merged_{c}") for c in ("category", "tags", "about", "confidence")}) \
            .select(*clips.columns)
    photos = reconcile.settle_junk(reconcile.reconcile_photos(lib.photos, photo_listing))
    if photo_labels is not None:
        read = classify.fuse_labels(photos, photo_labels, key=("library_id", "id"))
        photos = read.withColumns({c: F.col(f"fused_{c}") for c in ("category", "tags", "about", "confidence")}) \
            .select(*photos.columns)
    vectors = settle(identity.repoint(lib.vectors, identity.consolidate(lib.vectors)), "vectors")
    persons = identity.nonempty_persons(lib.persons, vectors)
    adopted = identity.adopt_unassigned(vectors, lib.denials).withColumnRenamed("person_id", "_to")
    vectors = settle(vectors.join(adopted, ["library_id", "id"], "left").withColumn(
        "person_id", F.coalesce("_to", "person_id")).drop("_to"), "vectors")
    clips = settle(identity.primary_person(clips, vectors, persons), "clips")
    persons = identity.split_scan(vectors, persons)
    named = identity.suggest_names(clips, persons).select("library_id", F.col("person_id").alias("id"), "suggestion")
    persons = persons.join(named, ["library_id", "id"], "left").withColumn(
        "suggested_name", F.coalesce("suggestion", "suggested_name")).drop("suggestion")
    return Library(clips, settle(photos, "photos"), settle(reconcile.retain_events(lib.events), "events"), vectors,
                   settle(persons, "persons"), lib.denials, lib.dismissals, lib.albums, lib.group_names)


def feed_run(lib: Library, as_of: int, hour: int, tuning: feed.Tuning = feed.Tuning(), seed: int = 0,
             served: DataFrame | None = None) -> DataFrame:
    """A reel per viewer: suppression, taste, scores, candidates, bands."""
    viewers = lib.events.select("viewer_id", "library_id").distinct()
    affinity = taste.taste_affinity(viewers, lib.clips, taste.taste_buckets(lib.events, lib.clips))
    hidden = dups.suppression(lib.dismissals, lib.clips)
    shown = feed.open_clips(lib.watched(), hidden, tuning)
    known = (shown, viewers, affinity, feed.recent_watches(lib.events))
    if served is not None:
        unseen = feed.unseen_counts(viewers, feed.open_clips(lib.clips, hidden), served)
        scores = feed.session_scores(*known, served, as_of, hour, tuning, library=lib.clips)
        return feed.session_walk(scores, served, unseen, tuning, seed)
    return feed.reels(feed.best_candidates(*known, as_of, hour, tuning, library=lib.clips), t=tuning, seed=seed)


def shelf_run(lib: Library, as_of: int, threshold: float = 0.5) -> DataFrame:
    """All shelves with the names people gave them."""
    clips = lib.watched()
    sets = dups.keepers(dups.duplicate_sets(clips))
    return shelves.titled(shelves.groups(clips, lib.persons, lib.albums, as_of, threshold, sets), lib.group_names)


def shelf_page(lib: Library, as_of: int, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """What a page needs besides the headings: the clips of every shelf in order, and of every duplicate set."""
    clips = lib.watched()
    members = dups.duplicate_sets(clips)
    return (shelves.group_members(clips, lib.persons, lib.albums, as_of, threshold),
            shelves.duplicate_members(members, dups.keepers(members)))


def search_run(lib: Library, queries: DataFrame, index: DataFrame | None = None, grams: str | None = None) -> DataFrame:
    """Ranked hits of all general queries; routed ones are answered by ``search.route_results``.

    ``index`` and ``grams`` are the stored postings of words and of letter pieces; without them both are made now.
    """
    clips = lib.watched()
    routes = search.search_routes(queries, lib.persons)
    general = queries.join(routes.where("route = 'general'").select("query_id"), "query_id", "left_semi")
    if index is None:
        index = settle(search.postings(search.documents_index(lib.clips, lib.photos, lib.persons)), "postings")
    net = settle(search.substring_candidates(general, clips, lib.photos, grams), "net")
    docs = settle(search.memory_docs(clips, lib.photos), "scoring-documents")
    return search.search_best(general, index, net, docs, search.tie_breaks(clips, lib.photos))
