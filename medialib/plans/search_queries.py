"""Search queries over the test tables."""

import uuid

from pyspark.sql import functions as F

from medialib.operators import search
from medialib.plans.binding import AS_OF
from medialib.plans.dup_queries import watched
from medialib.plans.registry import as_long, query, r6
from medialib.session import scratch_dir, settle


@query
def clip_documents(b):
    return search.clip_documents(b.clips(), b.persons())


@query
def photo_documents(b):
    return search.photo_documents(b.photos())


@query
def memory_docs(b):
    return search.memory_docs(watched(b), b.photos())


@query
def query_terms(b):
    return search.query_terms(b.search_queries()).select("query_id", "library_id", *as_long("pos"), "term")


def _documents(b, clips=None):
    return search.documents_index(b.clips() if clips is None else clips, b.photos(), b.persons())


@query
def postings(b):
    return search.postings(_documents(b)).groupBy("library_id", "kind", "p2", "term").agg(
        F.count("*").alias("items"), F.sum("id").alias("id_sum"))


@query
def postings_reindexed(b):
    """The index after person 0 is renamed in every library: only that person's clips are redone."""
    before = search.postings(_documents(b))
    renamed = b.persons().withColumn("name", F.when(F.col("id") == 0, "Zoe").otherwise(F.col("name")))
    ids = b.clips().where("person_id = 0").select("library_id", F.lit("clip").alias("kind"), "id")
    after = search.reindex(before, ids, search.documents_index(b.clips(), b.photos(), renamed))
    return after.groupBy("library_id", "kind", "term").agg(F.count("*").alias("items"), F.sum("id").alias("id_sum"))


@query
def index_freshness(b):
    media = b.listing_new().select("library_id", F.lit("clip").alias("kind"), "id").unionByName(
        b.photos().select("library_id", F.lit("photo").alias("kind"), "id"))
    return search.index_freshness(media, _documents(b)).select(
        "library_id", "kind", *as_long("media", "indexed"), "fresh")


def _prefix(b, texts=None):
    index = settle(search.postings(_documents(b)), "postings")
    return search.prefix_candidates(search.query_terms(b.search_queries()), index, texts=texts)


@query
def prefix_candidates(b):
    return _prefix(b).select("query_id", "library_id", "kind", "id", *as_long("matched"))


@query
def substring_candidates(b):
    """Queries are the user turns, plus names and folders that do occur."""
    return search.substring_candidates(net_queries(b), b.clips(), b.photos()).select("query_id", "kind", "id")


def _gram_counts(postings):
    return postings.groupBy("library_id", "kind", "gram").agg(F.count("*").alias("items"), F.sum("id").alias("id_sum"))


@query
def gram_index(b):
    """How often each piece of letters occurs; a piece is told by the number its code points make."""
    return _gram_counts(search.gram_postings(search.haystacks(b.clips(), b.photos())))


@query
def gram_index_reindexed(b):
    """The index after every tenth clip moved to another folder and every seventh photo left: only those are redone."""
    before = search.gram_postings(search.haystacks(b.clips(), b.photos()))
    moved = b.clips().withColumn("folder_name", F.when(F.col("id") % 10 == 0, "Ärchive 7").otherwise(F.col("folder_name")))
    stay = b.photos().where("id % 7 <> 0")
    named = b.clips().where("id % 10 = 0").select("library_id", F.lit("clip").alias("kind"), "id").unionByName(
        b.photos().where("id % 7 = 0").select("library_id", F.lit("photo").alias("kind"), "id"))
    return _gram_counts(search.reindex_grams(before, named, search.haystacks(moved, stay)))


@query
def substring_indexed(b):
    """The substring hits read through a stored index of pieces."""
    path = f"{scratch_dir(b.spark)}/grams-{uuid.uuid4().hex}"
    search.write_gram_index(search.gram_postings(search.haystacks(b.clips(), b.photos())), path)
    return search.substring_candidates(net_queries(b), b.clips(), b.photos(), path).select("query_id", "kind", "id")


def net_queries(b):
    """Search texts plus, per library, every category, every folder and every word photos are tagged with."""
    extra = b.clips().select("library_id", F.explode(F.array(
        "category", F.lower("folder_name"))).alias("text")).unionByName(
        b.photos().select("library_id", F.explode(F.split("tags", ",")).alias("text"))).distinct()
    key = F.conv(F.substring(F.md5(F.concat_ws("|", "library_id", "text")), 1, 12), 16, 10).cast("bigint")
    return b.search_queries().select("query_id", "library_id", "text").unionByName(
        extra.select((key + 1_000_000_000).alias("query_id"), "library_id", "text"))


@query
def search_routes(b):
    words = F.array(*[F.lit(w) for w in (" People", "talking", "ANNA", "omar ", "Sara", "a")])
    probes = b.clips().select("library_id").distinct().select(
        "library_id", F.posexplode(words).alias("query_id", "text"))
    return search.search_routes(b.search_queries().select(
        "query_id", "library_id", "text").unionByName(
        probes.select((F.col("query_id") + 900_000_000).cast("bigint").alias("query_id"), "library_id", "text")),
        b.persons()).select("query_id", "library_id", "route", *as_long("person_id"))


@query
def route_results(b):
    words = F.array(*[F.lit(w) for w in ("people", "talking", "anna", "omar", "sara")])
    probes = b.clips().select("library_id").distinct().select(
        "library_id", F.posexplode(words).alias("query_id", "text"))
    routes = search.search_routes(probes, b.persons())
    return search.route_results(routes, b.clips()).select("library_id", "route", *as_long("person_id"), "id")


def _ranked(b):
    # One task reads the stored clips, however long their texts; dealt out, many cut them.
    clips, photos, queries = settle(watched(b).repartition("library_id", "id"), "clips"), b.photos(), settle(net_queries(b), "queries")
    index = settle(search.postings(_documents(b, clips)), "postings")
    net = search.substring_candidates(queries, clips, photos)
    docs = settle(search.memory_docs(clips, photos), "scoring-documents")
    return search.search_best(queries, index, net, docs, search.tie_breaks(clips, photos))


@query
def match_scores(b):
    queries, docs = b.search_queries().select("query_id", "text"), settle(search.memory_docs(watched(b), b.photos()), "scoring-documents")
    return search.match_scores(_prefix(b, (queries, docs)), queries, docs).select(
        "query_id", "kind", "id", r6("score").alias("score"))


@query
def search_ranked(b):
    return _ranked(b).select("query_id", "library_id", "kind", "id", *as_long("rank", "tie"),
                             r6("score").alias("score"))


def _hits(b):
    cols = ["library_id", "id", "face_count", "is_favorite", "date_added_sec", "category", "folder_name"]
    items = b.clips().select(*cols, "prosody_tags", "person_id", F.lit("clip").alias("kind")).unionByName(
        b.photos().select(*cols, F.lit("").alias("prosody_tags"), F.lit(-1).alias("person_id"),
                          F.lit("photo").alias("kind")))
    return _ranked(b).join(items, search.ITEM)


@query
def search_lens(b):
    hits = settle(_hits(b), "hits")
    people = search.lens(hits, AS_OF, "people", days=365)
    talking = search.lens(hits, AS_OF, "talking", folder="camera")
    music = search.lens(hits, AS_OF, "favorites", category="music")
    tag = lambda d, n: d.select(F.lit(n).alias("lens"), "query_id", "kind", "id")
    return tag(people, "people").unionByName(tag(talking, "talking")).unionByName(tag(music, "music"))


@query
def search_sections(b):
    return search.search_sections(_hits(b), b.persons()).select(
        "query_id", *as_long("section", "size", "first_rank"), "title")


@query
def search_section_hits(b):
    hits = settle(_hits(b), "hits")
    return search.section_hits(hits, search.search_sections(hits, b.persons())).select(
        "query_id", *as_long("section", "pos"), "kind", "id")


@query
def search_suggestions(b):
    return search.search_suggestions(b.clips()).select("library_id", *as_long("pos"), "suggestion")


@query
def recent_searches(b):
    return search.recent_searches(b.search_queries()).select("viewer_id", "text", *as_long("at", "rank"))
