"""Near-duplicate and content-match queries over the test tables."""

from pyspark.sql import functions as F

from medialib.operators import dups, simjoin, taste
from medialib.operators.fingerprints import simhash64
from medialib.functions.text import UNICODE_BREAK
from medialib.plans.registry import as_long, query


def watched(b, clips=None):
    return taste.with_engagement(b.clips() if clips is None else clips, taste.engagement(b.watch_events()))


@query
def hamming_pairs(b):
    return simjoin.fingerprint_pairs(b.clips_hashed(), 6).select(
        "library_id", "phash_a", "phash_b", *as_long("distance", "copies_a", "copies_b", "pairs"))


@query
def hamming_pairs_wide(b):
    return simjoin.fingerprint_pairs(b.clips_hashed(), 10).select(
        "library_id", "phash_a", "phash_b", *as_long("distance", "pairs"))


@query
def dup_pairs(b):
    return dups.duplicate_pairs(b.clips_hashed()).select(
        "library_id", "folder", "a", "b", *as_long("distance", "copies_a", "copies_b"))


@query
def dup_sets(b):
    clips = b.clips_hashed()
    return dups.duplicate_sets(clips).select("library_id", "set_id", "id")


@query
def dup_keepers(b):
    clips = b.clips_hashed()
    return dups.keepers(watched(b, dups.duplicate_sets(clips))).select(
        "library_id", *as_long("set_id", "keeper_id", "members", "savings_bytes"))


@query
def keeper_reason(b):
    clips = b.clips_hashed()
    sets = dups.keepers(watched(b, dups.duplicate_sets(clips)))
    return dups.keeper_reason(sets).select("library_id", *as_long("set_id", "keeper_id"), "reason")


def lookup_queries(b):
    """Every document as a clip someone sends its library (two frames), every benchmark text to 'en'."""
    docs = b.raw("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("library_id"))
    own = docs.join(b.fingerprints(), "id", "left").select(
        F.col("id").alias("query_id"), "library_id", F.explode(F.array(
            F.struct(F.lit(0).alias("frame_no"), F.coalesce("phash", F.lit(0)).alias("phash")),
            F.struct(F.lit(1).alias("frame_no"),
                     F.coalesce(F.col("phash").bitwiseXOR(F.lit(0x8001)), F.lit(0)).alias("phash")))).alias("f"))
    bench = simhash64(b.raw("benchmark"), "item_id", "text", UNICODE_BREAK, 2).select(
        (F.col("item_id") + 10_000_000).alias("query_id"), F.lit("en").alias("library_id"),
        F.struct(F.lit(0).alias("frame_no"), "phash").alias("f"))
    return own.unionByName(bench).select("query_id", "library_id", "f.frame_no", "f.phash")


@query
def content_match(b):
    library = dups.media_library(b.clips_hashed(), b.photos())
    return dups.content_match(lookup_queries(b), library).select(
        "query_id", "library_id", "kind", "id", *as_long("distance", "rank"))


@query
def content_verdict(b):
    library = dups.media_library(b.clips_hashed(), b.photos())
    queries = lookup_queries(b)
    return dups.content_verdict(queries, dups.content_match(queries, library)).select(
        "query_id", "library_id", *as_long("id", "distance"), "verdict")


@query
def suppression(b):
    return dups.suppression(b.dismissals(), b.clips_hashed())
